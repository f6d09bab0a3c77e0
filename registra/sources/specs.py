"""Specifications and the tests that cite them: capabilities hold requirements, tests verify them."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import DataFrame

from ..model import Register
from .files import Fences, Rows, register, scan

_HEAD = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*")
_CITE = re.compile(r"\s*(?:#|//+|\*)\s*Requirement:\s*(\S.*?)\s*")
_TEST = {
    ".py": re.compile(r"\s*(?:async\s+)?def\s+(test\w*)\s*\("),
    ".rs": re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    ".ts": re.compile(r"\s*(?:it|test)(?:\.\w+)?\(\s*[\"'`](.*?)[\"'`]"),
}
_MARK = re.compile(r"\s*#\[(?:\w+::)*test\b")


def _spec(rows: Rows, lines: list[str | None]) -> None:
    """Requirements of a specification: headings 'Requirement: title', with the scenarios and the text below up to the next heading of level 3 or less."""
    cap = posixpath.basename(posixpath.dirname(rows.file))
    rows.node(0, cap, "capability", {})
    fences, open_ = Fences(), None

    def close() -> None:
        nonlocal open_
        if open_:
            line, title, scenarios, body = open_
            text = "\n".join(body).strip()
            me = rows.node(line, f"{cap}/{title}", "requirement", {"title": json.dumps(title, ensure_ascii=False), "scenarios": str(scenarios), "body": json.dumps(text, ensure_ascii=False)})
            rows.edge(line, cap, f"{cap}/{title}", "contains", me)
        open_ = None

    for n, line in enumerate((x or "" for x in lines), 1):
        m = None if fences.inside(n, line) else _HEAD.fullmatch(line)
        if m and len(m[1]) <= 3:
            close()
            if m[2].startswith("Requirement:"):
                open_ = (n, m[2].removeprefix("Requirement:").strip(), 0, [])
        elif m and m[2].startswith("Scenario:"):
            if open_:
                open_ = (open_[0], open_[1], open_[2] + 1, [*open_[3], line])
            else:
                rows.finding(n, f"{rows.file}: a scenario outside any requirement", severity="warning")
        elif open_ and not line.startswith("Verified by"):
            open_[3].append(line)
    close()


def _tests(rows: Rows, lines: list[str | None], test: re.Pattern) -> None:
    """Tests: citation lines bind to the tests that follow; lines that follow one another directly stack, and after any other line a citation takes the place of those before."""
    cited: list[tuple[int, str]] = []
    last, marked = -1, test is not _TEST[".rs"]
    for n, line in enumerate((x or "" for x in lines), 1):
        if m := _CITE.fullmatch(line):
            if last != n - 1:
                cited = []
            cited.append((n, m[1]))
            last = n
        elif _MARK.match(line):
            marked = True
        elif m := test.match(line):
            if marked:
                me = rows.node(n, f"{rows.file}::{m[1]}", "test", {"file": json.dumps(rows.file), "function": json.dumps(m[1], ensure_ascii=False)})
                for at, requirement in cited:
                    rows.edge(at, f"{rows.file}::{m[1]}", requirement, "verifies", me)
            marked = test is not _TEST[".rs"]


def read_file(rows: Rows, lines: list[str | None], faults: list[tuple[int, str]]) -> None:
    for n, why in faults:
        rows.finding(n, why)
    ending = posixpath.splitext(rows.file)[1]
    if rows.file.endswith("/spec.md"):
        _spec(rows, lines)
    elif ending in _TEST:
        _tests(rows, lines, _TEST[ending])


def read_specs(files: DataFrame) -> Register:
    """files: file, content of specifications (<capability>/spec.md) and test sources."""
    return register(scan(files, read_file))
