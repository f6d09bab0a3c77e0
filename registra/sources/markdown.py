"""Registers in Markdown tables: rows are nodes, the targets in edge columns edges."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from ..model import Register
from .files import Fences, Rows, register, scan

SEPARATOR = re.compile(r":?-+:?")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
QUOTE = re.compile(r" {0,3}>[ ]?")


def unquoted(line: str) -> str:
    while m := QUOTE.match(line):
        line = line[m.end() :]
    return line


def cells(line: str) -> list[str]:
    r"""The trimmed cells of a table row; \| is a bar inside a cell."""
    parts = re.split(r"(?<!\\)\|", line.strip())
    if parts and not parts[0].strip():
        parts = parts[1:]
    if parts and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip().replace("\\|", "|") for p in parts]


def is_separator(line: str) -> bool:
    c = cells(line)
    return "-" in line and "|" in line and bool(c) and all(map(SEPARATOR.fullmatch, c))


def strip_emphasis(text: str) -> str:
    """Takes wrapping marks off, again and again; an empty pair and a pair whose mark recurs inside at its own length stay."""
    while m := re.fullmatch(r"(\*\*|__|\*|_|`+)(.+)\1", text, re.S):
        mark, inner = m[1], m[2]
        runs = [r[0] for r in re.finditer(f"{re.escape(mark[0])}+", inner)]
        if mark in runs or inner.strip(mark[0]) != inner and mark[0] != "`" and len(mark) == 1 or not inner.strip():
            break
        text = inner.strip()
    return text


def targets(cell: str) -> list[str]:
    """Parts between commas that lie outside brackets, trimmed, empty ones left out."""
    out, depth, part = [], 0, ""
    for c in cell:
        depth += (c in "[(") - (c in "])" and depth > 0)
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


def _table(rows: Rows, config: dict, header: list[str], body: list[tuple[int, str | None]], at: int) -> None:
    clean = strip_emphasis if config.get("strip_emphasis") else lambda x: x
    if config["id_column"] not in header:
        rows.finding(at, f"configured ID column '{config['id_column']}' was not found in table headers")
        return
    for want in [*config.get("column_map", {}), *config.get("edge_columns", {})]:
        if want not in header:
            rows.finding(at, f"configured column '{want}' was not found in table headers")
    for n, line in body:
        if line is None:
            continue
        c = cells(line)
        if len(c) != len(header):
            rows.finding(n, f"table row has {'fewer' if len(c) < len(header) else 'more'} columns than its header")
            continue
        row = dict(zip(header, c, strict=True))
        id_ = clean(row[config["id_column"]])
        if not id_:
            rows.finding(n, "table row has an empty ID")
            continue
        attrs = {a: json.dumps(row[h], ensure_ascii=False) for h, a in config.get("column_map", {}).items() if h in row}
        me = rows.node(n, id_, config["kind"], attrs)
        for h, kind in config.get("edge_columns", {}).items():
            for t in targets(row.get(h, "")):
                rows.edge(n, id_, clean(t), kind, me)


def reader(adapter: dict, kinds: list[str]):
    """What a profile's adapter section asks for: one schema for all tables, or the first whose heading pattern fits the heading above."""
    if ("table" in adapter) == ("tables" in adapter):
        raise ValueError("the adapter needs 'table' or 'tables'")
    if "table" in adapter and len(kinds) != 1:
        raise ValueError("the single-table form needs exactly one node kind")
    single = {**adapter["table"], "kind": kinds[0]} if "table" in adapter else None
    several = [(re.compile(t["heading"]), t) for t in adapter.get("tables", [])]

    def choose(heading: str) -> dict | None:
        return single or next((t for p, t in several if p.search(heading)), None)

    def read(rows: Rows, lines: list[str | None], faults: list[tuple[int, str]]) -> None:
        for n, why in faults:
            rows.finding(n, why)
        fences, heading, lost, i = Fences(), "", False, 0
        text = [None if x is None else unquoted(x) for x in lines]
        while i < len(text):
            line = text[i]
            if line is None:
                lost = True
                i += 1
                continue
            if fences.inside(i + 1, line):
                i += 1
                continue
            if m := HEADING.fullmatch(line):
                heading, lost = m[1] or "", False
            nxt = text[i + 1] if i + 1 < len(text) else ""
            if "|" not in line or is_separator(line) or not (nxt is None or is_separator(nxt)):
                i += 1
                continue
            end = i + 2
            while end < len(text) and (text[end] is None or "|" in text[end]):
                end += 1
            body = [(k + 1, text[k]) for k in range(i + 2, end)]
            if nxt is None:
                i += 1
                continue
            if not single and lost:
                rows.finding(i + 1, f"the heading above the table may lie on a line that was not read; its {len(body)} rows were not read")
            elif len(cells(line)) != len(cells(nxt)):
                rows.finding(i + 2, "table separator and header differ in width")
            elif (config := choose(heading)) is None:
                rows.finding(i + 1, f"no configured table fits the heading '{heading}'")
            else:
                _table(rows, config, cells(line), body, i + 1)
            i = end
        if fences.open:
            rows.finding(fences.open[2], "fenced code is not closed")

    return read


def read_markdown(files: DataFrame, adapter: dict, kinds: list[str]) -> Register:
    """files: file, content -> the register in their tables."""
    return register(scan(files, reader(adapter, kinds)))
