"""Registra: typed node/edge registers on Spark."""
