"""Reports as plain lines or JSON. Sorted frames are read row by row, so a report of any length needs the memory of a row (or an entry)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..model import Profile, Register
from ..shared import cut

CONTROL = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b[@-_]|[\x00-\x08\x0b-\x1f\x7f]")
COLOURS = {"error": "31", "warning": "33", "info": "36", "hint": "2"}


def clean(text: object) -> str:
    """Text without terminal control sequences."""
    return CONTROL.sub("", str(text))


def cut_to(text: str, width: int) -> str:
    return text if len(text) <= width else text[: max(width - 1, 0)] + "…"


def columns(rows: list[list[object]]) -> Iterator[str]:
    """Cells justified: numbers to the right, the rest to the left."""
    width = [max(len(str(r[i])) for r in rows) for i in range(len(rows[0]))] if rows else []
    for r in rows:
        yield "  ".join(str(x).rjust(w) if isinstance(x, int | float) else str(x).ljust(w) for x, w in zip(r, width, strict=True)).rstrip()


def to_json(value: object) -> str:
    """ASCII JSON, map keys sorted, absent values left out."""

    def plain(v):
        if isinstance(v, Row):
            v = v.asDict()
        if isinstance(v, dict):
            return {k: plain(x) for k, x in sorted(v.items()) if x is not None}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(value), ensure_ascii=True)


def json_lines(df: DataFrame) -> Iterator[str]:
    return (to_json(r) for r in df.toLocalIterator())


def finding_line(f: Row, rich: bool = False) -> str:
    severity = f.severity.upper()
    if rich:
        severity = f"\x1b[{COLOURS[f.severity]}m{severity}\x1b[0m"
    note = f" (note: {clean(f.note.text)})" if "note" in f and f.note else ""
    return f"{severity} {f.code} {clean(f.file)}:{f.line} {clean(f.message)}{note}"


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "code", F.coalesce("node_id", F.lit("")), "message")


def findings(df: DataFrame, form: str = "plain") -> Iterator[str]:
    """A line a finding in report order; suppressed ones are in JSON only."""
    if form == "json":
        return json_lines(ordered(df))
    return (finding_line(f, form == "rich") for f in ordered(df.filter("not suppressed")).toLocalIterator())


def entries(r: Register, found: DataFrame, p: Profile) -> DataFrame:
    """A trace in order, in long form: each node (by its kind's place in the profile, undeclared kinds last, then id), then its edges by kind, target, file and line, then its findings."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(p.node_kinds)), F.lit(999)) if p.node_kinds else F.lit(999)
    n = r.nodes.withColumn("rank", rank)
    own = n.select("rank", "id", F.lit(0).alias("part"), F.col("kind").alias("what"), F.lit(None).cast("string").alias("far"), "file", "line", F.to_json("attrs").alias("attrs"))
    e = r.edges.join(n.select(F.col("id").alias("src"), "rank"), "src").select("rank", F.col("src").alias("id"), F.lit(1).alias("part"), F.col("kind").alias("what"), F.col("tgt").alias("far"), "file", "line", F.to_json("attrs").alias("attrs"))
    f = found.join(n.select(F.col("id").alias("node_id"), "rank"), "node_id").select("rank", F.col("node_id").alias("id"), F.lit(2).alias("part"), F.col("code").alias("what"), F.col("message").alias("far"), "file", "line", F.col("severity").alias("attrs"))
    return own.union(e).union(f).orderBy("rank", "id", "part", "what", "far", "file", "line")


def trace(r: Register, found: DataFrame, p: Profile, form: str = "plain") -> Iterator[str]:
    """Nodes with their edges and findings, then the findings that fit no node, then the pathways."""
    rows = entries(r, found, p).toLocalIterator()
    lost = found.join(r.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(*found.columns)
    for id_, group in groupby(rows, key=lambda x: x.id):
        first = next(group)
        if form == "json":
            entry = {"id": id_, "kind": first.what, "attrs": {k: json.loads(v) for k, v in json.loads(first.attrs).items()}, "file": first.file, "line": first.line, "edges": [], "findings": []}
            for x in group:
                entry["edges" if x.part == 1 else "findings"].append({"kind": x.what, "tgt": x.far, "file": x.file, "line": x.line} if x.part == 1 else {"code": x.what, "message": x.far, "severity": x.attrs})
            yield to_json(entry)
        else:
            yield f"{clean(id_)} ({first.what}) {clean(first.file)}:{first.line}"
            for x in group:
                yield f"  {x.what} -> {clean(x.far)}" if x.part == 1 else f"  {x.attrs.upper()} {x.what} {clean(x.far)}"
    yield from (to_json({"unattachable": f}) if form == "json" else finding_line(f) for f in ordered(lost).toLocalIterator())
    for name, (order, current) in r.pathways.items():
        yield to_json({"pathway": name, "order": order, "current": current}) if form == "json" else f"pathway {name}: " + ", ".join(f"[{x}]" if x == current else x for x in order)


def trace_lines(r: Register, found: DataFrame, p: Profile) -> DataFrame:
    """The JSON lines of trace() as a frame (line, text) that executors make, for traces that no driver should hold: an entry a node, then findings that fit no node, then pathways.

    Keys may stand in another order than trace()'s, and an attribute that is null is written as such. A node's edges and findings are one row. The lines are written once, to the shared folder, and numbered from 0 there."""
    kinds = {k: i for i, k in enumerate(p.node_kinds)}
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for k, i in kinds.items()), F.lit(999)) if kinds else F.lit(999)
    attrs = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.to_json(F.array(e.key)).substr(F.lit(2), F.length(F.to_json(F.array(e.key))) - 2), F.lit(":"), e.value)), ","), F.lit("}"))
    e = r.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", "tgt", "file", "line"))).alias("edges"))
    f = found.filter("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("code", "message", "severity"))).alias("findings"))
    n = r.nodes.select("id", "kind", "attrs", "file", "line", rank.alias("rank")).join(e, "id", "left").join(f, "id", "left").orderBy("rank", "id")  # texts after the sort, which computes its input twice
    none = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    rest = F.to_json(F.struct("file", "id", "kind", "line"))
    text = F.concat(F.lit('{"attrs":'), attrs, F.lit(',"edges":'), none("edges"), F.lit(',"findings":'), none("findings"), F.lit(","), rest.substr(F.lit(2), F.length(rest) - 1))
    lost = ordered(found.join(r.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(*found.columns))
    lost = lost.select(F.to_json(F.struct(F.struct(*(F.col(c) for c in sorted(found.columns))).alias("unattachable"))).alias("text"))
    placed = lambda df, part: df.select(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("m"), "text")
    ways = [(2, i, to_json({"pathway": name, "order": order, "current": current})) for i, (name, (order, current)) in enumerate(r.pathways.items())]
    out = placed(n.select(text.alias("text")), 0).unionByName(placed(lost, 1))
    out = cut(out.unionByName(r.nodes.sparkSession.createDataFrame(ways, "part int, m long, text string"))).withColumn("task", F.shiftright("m", 33))
    before = F.sum("n").over(Window.orderBy("part", "task")) - F.col("n")  # a row for each task
    starts = out.groupBy("part", "task").agg(F.count("*").alias("n")).select("part", "task", before.alias("start"))
    return out.join(F.broadcast(starts), ["part", "task"]).select((F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("line"), "text")


def table(df: DataFrame, form: str = "plain", order: list[str] | None = None) -> Iterator[str]:
    """Any report: a line a row with a header. Cells are justified by widths that a first pass measures."""
    df = df.orderBy(*(order or df.columns))
    if form == "json":
        yield from json_lines(df)
        return
    wide = df.agg(*(F.max(F.char_length(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns)).first()
    width = {c: max(len(c), wide[c] or 0) for c in df.columns}
    yield "  ".join(c.ljust(width[c]) for c in df.columns).rstrip()
    for r in df.toLocalIterator():
        yield "  ".join(clean("" if r[c] is None else r[c]).rjust(width[c]) if isinstance(r[c], int | float) and not isinstance(r[c], bool) else clean("" if r[c] is None else r[c]).ljust(width[c]) for c in df.columns).rstrip()


def scope_line(scope: DataFrame, r: Register) -> str:
    """scope: N files; nodes kind n ...; edges kind n ...; the rows of scope are kinds that a profile declares."""
    n_files = r.nodes.select("file").union(r.edges.select("file")).distinct().count()
    rows = scope.collect()
    part = lambda what: " ".join(f"{r.kind} {r.n}" for r in sorted(rows, key=lambda r: r.kind) if r.what == what)
    return f"scope: {n_files} files; nodes {part('node')}; edges {part('edge')}"


def node_order(nodes: DataFrame, worst: DataFrame, p: Profile, by: str = "kind") -> DataFrame:
    """A node list: by declared kind and id, or by severity: nodes with findings first, the gravest, then the most, then id."""
    n = nodes.join(worst, "id", "left")
    if by == "kind":
        rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(p.node_kinds)), F.lit(999))
        return n.orderBy(rank, "id")
    grave = F.array_position(F.array(*map(F.lit, COLOURS)), F.col("worst"))
    return n.orderBy(F.col("n").isNull(), grave, F.desc("n"), "id")


def finding_order(df: DataFrame, by: str = "location") -> DataFrame:
    """A findings list: those on a node first, by place or by severity."""
    grave = F.array_position(F.array(*map(F.lit, COLOURS)), F.col("severity"))
    return df.orderBy(F.col("node_id").isNull(), *([] if by == "location" else [grave]), "file", "line", "code", "message")


def search(rows: DataFrame, pattern: str, after: str | None = None, backward: bool = False) -> DataFrame:
    """Rows (id, ...) whose id or summary a pattern fits, in the order in which a search from an id meets them, around the end; column hit counts from 1."""
    fits = F.col("id").rlike(f"(?U){pattern}")
    if "summary" in rows.columns:
        fits = fits | F.col("summary").rlike(f"(?U){pattern}")
    ahead = F.lit(True) if after is None else (F.col("id") < after if backward else F.col("id") > after)
    order = [F.when(ahead, 0).otherwise(1), F.desc("id") if backward else F.asc("id")]
    return rows.filter(fits).select("*", F.row_number().over(Window.orderBy(*order)).alias("hit"))


FORMS: dict[str, Callable[..., Iterator[str]]] = {"findings": findings, "trace": trace, "table": table}
