"""Traces that another run wrote, as JSON lines: entries with their edges and findings, findings that fit no entry, pathways. What a fuse reads where sources aren't frames already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Register
from ..shared import cut
from .document import SEVERITIES, ContractError, _list, _object, _text, attrs_of, type_name


def fault(m: Column) -> Column:
    """What is wrong with a line that no trace has, of its object; null for a line in order."""
    entry = F.map_contains_key(m, "id")
    severities = F.transform(F.coalesce(_list(m["findings"]), F.array()), lambda x: _text(_object(x)["severity"]))
    lost = _object(m["unattachable"])
    order = F.transform(_list(m["order"]), _text)
    return F.coalesce(
        F.when(m.isNull(), F.lit("not a JSON object")),
        F.when(entry & ~F.coalesce(F.length(_text(m["id"])) > 0, F.lit(False)), F.lit("an entry's id must be a string that isn't empty")),
        F.when(entry & (F.coalesce(type_name(m["kind"]), F.lit("")) != "string"), F.lit("an entry's kind must be a string")),
        F.when(entry & F.exists(severities, lambda s: ~F.coalesce(s.isin(*SEVERITIES), F.lit(False))), F.lit("unknown severity")),
        F.when(lost.isNotNull() & ~F.coalesce(_text(lost["severity"]).isin(*SEVERITIES), F.lit(False)), F.lit("unknown severity")),
        F.when(F.map_contains_key(m, "pathway") & (F.coalesce(F.size(order), F.lit(0)) > F.size(F.array_distinct(order))), F.lit("a pathway repeats a position")),
        F.when(F.map_contains_key(m, "pathway") & ~F.coalesce(F.array_contains(order, _text(m["current"])), F.lit(False)), F.lit("a pathway's current position isn't in it")),
    )


def read_trace(lines: DataFrame) -> Register:
    """lines: line (long, their order), text -> the register that was traced, with its findings. A malformed line or an entry that repeats an id raises.

    Each line is parsed once, into a table in the shared folder; all else reads that."""
    m = F.col("m")
    at = lambda m: F.try_variant_get(m["line"], "$", "bigint").alias("at")
    texts = lambda m, *keys: [_text(m[k]).alias(k) for k in keys]
    say = ("severity", "code", "message")
    each = lambda key, *parts: F.transform(F.transform(_list(m[key]), _object), lambda x: F.struct(*(c for f in parts for c in f(x)))).alias(key)
    lost, way = _object(m["unattachable"]), F.struct(_text(m["pathway"]).alias("name"), F.transform(_list(m["order"]), _text).alias("positions"), _text(m["current"]).alias("current"))
    t = cut(
        lines.select("line", _object(F.try_parse_json("text")).alias("m")).select(
            F.col("line").alias("ord"), fault(m).alias("fault"), F.map_contains_key(m, "id").alias("entry"), *texts(m, "id", "kind", "file"), at(m), attrs_of(m["attrs"]).alias("attrs"),
            each("edges", lambda x: texts(x, "tgt", "kind", "file"), lambda x: [at(x)]), each("findings", lambda x: texts(x, *say)),
            F.when(F.map_contains_key(m, "unattachable"), F.struct(*texts(lost, *say, "node_id", "file"), at(lost))).alias("lost"), F.when(F.map_contains_key(m, "pathway"), way).alias("way"),
        )
    )
    if bad := t.filter("fault is not null").orderBy("ord").limit(1).collect():
        raise ContractError(f"trace line {bad[0].ord}: {bad[0].fault}")
    e = t.filter("entry")
    if twice := e.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise ContractError(f"trace: '{twice[0].id}' has {twice[0]['count']} entries")
    nodes = e.select("id", "kind", "attrs", "file", F.col("at").alias("line"), "ord")
    none = F.create_map().cast("map<string,string>").alias("attrs")
    edges = e.select("ord", "id", F.posexplode("edges").alias("n", "x")).select(F.col("id").alias("src"), "x.tgt", "x.kind", none, "x.file", F.col("x.at").alias("line"), (F.shiftleft("ord", 24) + F.col("n")).alias("ord"))
    own = e.select("id", "file", "at", F.explode("findings").alias("x")).select(*(f"x.{k}" for k in say), F.col("id").alias("node_id"), "file", F.col("at").alias("line"))
    rest = t.filter("lost is not null").select(*(f"lost.{k}" for k in (*say, "node_id", "file")), F.col("lost.at").alias("line"))
    ways = t.filter("way is not null").select("ord", "way.*").orderBy("ord").collect()
    return Register(nodes, edges, {w["name"]: (w["positions"], w["current"]) for w in ways}, own.unionByName(rest))
