"""Reports over a register and its findings, in long form: no group is gathered into one row, so a node with very many edges costs no more than its share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import text_of
from ..model import Profile, Register
from . import graph
from . import relations as rel

SEVERITIES = ("error", "warning", "info", "hint")


def _kinds(r: Register) -> DataFrame:
    part = lambda df, what: df.select(F.lit(what).alias("what"), "kind", "file")
    return part(r.nodes, "node").union(part(r.edges, "edge"))


def _declared(r: Register, p: Profile) -> DataFrame:
    return r.nodes.sparkSession.createDataFrame([("node", k) for k in p.node_kinds] + [("edge", k) for k in p.edge_kinds], "what string, kind string")


def triples(r: Register, p: Profile) -> DataFrame:
    """The allowed (kind, src_kind, tgt_kind), as many as the profile has."""
    return r.nodes.sparkSession.createDataFrame([(k, s, t) for k, v in p.edge_kinds.items() for s, t in v], "kind string, src_kind string, tgt_kind string").distinct()


def scope(r: Register, p: Profile) -> DataFrame:
    """Rows and distinct files of each declared kind, 0 included."""
    g = _kinds(r).groupBy("what", "kind").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    return _declared(r, p).join(g, ["what", "kind"], "left").na.fill(0, ["n", "files"])


def described(r: Register) -> DataFrame:
    """How many rows of each kind stand in each file."""
    return _kinds(r).groupBy("what", "kind", "file").agg(F.count("*").alias("n"))


def schema_counts(r: Register, p: Profile) -> DataFrame:
    """Edges between declared ends by allowed triple, 0 included."""
    keys = ["kind", "src_kind", "tgt_kind"]
    g = rel.with_ends(r).filter("src_kind is not null and tgt_kind is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    return triples(r, p).join(g, keys, "left").na.fill(0, ["n"])


def expected_missing(r: Register, p: Profile) -> DataFrame:
    """(id, side, kind, far_kind): allowed triples of a node's kind of which the node has no edge to a declared end, for each side it may be on. Kinds with orphan_ok expect none."""
    both = F.explode(F.array(
        F.struct(F.lit("out").alias("side"), F.col("src_kind").alias("own"), F.col("tgt_kind").alias("far_kind"), F.col("src").alias("id")),
        F.struct(F.lit("in").alias("side"), F.col("tgt_kind").alias("own"), F.col("src_kind").alias("far_kind"), F.col("tgt").alias("id")),
    ))
    split = lambda df: df.select("kind", both.alias("e")).select("kind", "e.*")
    wanted = split(triples(r, p).withColumns({"src": F.lit(""), "tgt": F.lit("")})).drop("id")
    have = split(rel.with_ends(r).filter("src_kind is not null and tgt_kind is not null")).drop("own").distinct()
    expecting = [k for k, v in p.node_kinds.items() if not v.orphan_ok]
    every = r.nodes.filter(F.col("kind").isin(*expecting)).select("id", F.col("kind").alias("own")).join(F.broadcast(wanted), "own").drop("own")
    return every.join(have, ["id", "side", "kind", "far_kind"], "left_anti").select("id", "side", "kind", "far_kind")


def summary(r: Register, p: Profile, findings: DataFrame) -> DataFrame:
    """Counts by kind, then findings that aren't suppressed by code and severity."""
    n = rel.counts(r, p).select("what", "kind", F.lit(None).cast("string").alias("severity"), "n")
    f = findings.filter("not suppressed").groupBy(F.col("code").alias("kind"), "severity").agg(F.count("*").alias("n"))
    return n.unionByName(f.withColumn("what", F.lit("finding")))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings that aren't suppressed by severity, 0 included."""
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(findings.filter("not suppressed").groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").na.fill(0, ["n"])


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def worst(findings: DataFrame) -> DataFrame:
    """(id, worst, n): the gravest severity of each node that has findings, and how many it has."""
    g = findings.filter("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.min(rank(F.col("severity"))).alias("at"), F.count("*").alias("n"))
    return g.select("id", F.array(*map(F.lit, SEVERITIES))[F.col("at").cast("int")].alias("worst"), "n")


def trace(r: Register, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each edge at a declared node, from its side, and each finding on one: (id, part, what, far, file, line). And the findings that fit no node."""
    side = lambda part, near, far: F.struct(F.col(near).alias("id"), F.lit(part).alias("part"), F.col("kind").alias("what"), F.col(far).alias("far"), "file", "line")
    e = r.edges.select(F.explode(F.array(side("outgoing", "src", "tgt"), side("incoming", "tgt", "src"))).alias("e")).select("e.*")
    f = findings.select(F.col("node_id").alias("id"), F.lit("finding").alias("part"), F.col("code").alias("what"), F.col("severity").alias("far"), "file", "line")
    ids = r.nodes.select("id").distinct()
    return e.union(f).join(ids, "id", "left_semi"), findings.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_anti")


def at(rows: DataFrame, path: str) -> DataFrame:
    """Rows of a file or of all below a folder; '.' holds every relative path."""
    path = path.removeprefix("./").rstrip("/")
    return rows.filter(~F.col("file").startswith("/")) if path in ("", ".") else rows.filter((F.col("file") == path) | F.col("file").startswith(path + "/"))


def absent_attrs(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Which of the names no node has, in one pass."""
    g = nodes.agg(*(F.coalesce(F.bool_or(F.map_contains_key("attrs", n)), F.lit(False)).alias(f"_{i}") for i, n in enumerate(names)))
    return g.select(F.explode(F.array(*(F.struct(F.lit(n).alias("attr"), F.col(f"_{i}").alias("there")) for i, n in enumerate(names)))).alias("a")).select("a.*").filter("not there").select("attr")


def summaries(nodes: DataFrame, p: Profile) -> DataFrame:
    """(id, kind, summary): the summary attribute of the node's kind as text, empty if it has none."""
    c = F.lit(None).cast("string")
    for kind, k in p.node_kinds.items():
        if k.summary:
            v = F.col("attrs")[k.summary]
            c = F.when(F.col("kind") == kind, F.coalesce(text_of(v), v)).otherwise(c)
    return nodes.select("id", "kind", F.coalesce(c, F.lit("")).alias("summary"))


def components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The condensation: (component, size, cyclic, self_loop) and links between components (src, tgt, n). A node without edges is a component of its own."""
    of = nodes.select("id").union(edges.select("src")).union(edges.select("tgt")).distinct().join(graph.sccs(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    loops = edges.filter("src = tgt").select(F.col("src").alias("id"), F.lit(True).alias("loop")).distinct()
    g = of.join(loops, "id", "left").groupBy("component").agg(F.count("*").alias("size"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("self_loop"))
    ends = edges.select("src", "tgt").join(of.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("id").alias("tgt"), F.col("component").alias("b")), "tgt")
    links = ends.filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("tgt")).agg(F.count("*").alias("n"))
    return g.select("component", "size", (F.col("self_loop") | (F.col("size") > 1)).alias("cyclic"), "self_loop"), links


def attach_notes(findings: DataFrame, notes: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Findings with the note of their (code, node_id), if any, and whether its day is past; and a finding for each note unused or past. notes: code, node_id, text, until."""
    n = notes.select("code", "node_id", F.col("text").alias("note"), "until", F.coalesce(F.col("until") < today, F.lit(False)).alias("expired")).dropDuplicates(["code", "node_id"])
    out = findings.join(n, ["code", "node_id"], "left")
    used = findings.select("code", "node_id").distinct()
    say = lambda df, code, severity: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat(F.lit("note on "), "code").alias("message"), "node_id")
    return out, say(n.join(used, ["code", "node_id"], "left_anti"), "NOTE_UNUSED", "info").union(say(n.filter("expired").join(used, ["code", "node_id"], "left_semi"), "NOTE_EXPIRED", "warning"))


def suggestion_findings(r: Register, suggestions: DataFrame) -> DataFrame:
    """A hint for each suggestion (src, tgt, kind, score) between declared nodes, another for those that name an undeclared one."""
    ids = r.nodes.select("id").distinct()
    s = suggestions.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(ids.select(F.col("id").alias("tgt"), F.lit(True).alias("has_tgt")), "tgt", "left")
    whole = F.col("has_src").isNotNull() & F.col("has_tgt").isNotNull()
    message = F.concat(F.col("kind"), F.lit(" to "), F.col("tgt"), F.lit(", score "), F.format_string("%.4f", F.col("score")))
    return s.select(F.lit("hint").alias("severity"), F.when(whole, "SUGGESTED_EDGE").otherwise("SUGGESTION_UNRESOLVED").alias("code"), message.alias("message"), F.col("src").alias("node_id"))


def stale_config(findings: DataFrame, r: Register, p: Profile, shipped: set[str]) -> DataFrame:
    """(severity, code, message): bindings to pathways that the register lacks, if a finding has their code; overrides of codes that aren't shipped and no finding has."""
    bound = [("warning", "PATHWAY_UNRESOLVED", c, f"no pathway {name}", True) for c, (name, _) in p.pathway_bindings.items() if name not in r.pathways]
    over = [("info", "OVERRIDE_UNUSED", c, f"nothing has the code {c}", False) for c in p.overrides if c not in shipped]
    rules = findings.sparkSession.createDataFrame(bound + over, "severity string, code string, on string, message string, wants boolean")
    seen = findings.select(F.col("code").alias("on"), F.lit(True).alias("seen")).distinct()
    return rules.join(seen, "on", "left").filter(F.col("wants") == F.coalesce("seen", F.lit(False))).select("severity", "code", "message")
