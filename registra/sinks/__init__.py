"""What people and other programs read: reports as lines and documents."""
