"""Joins, counts and set operations over a register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import text_of
from ..model import Profile, Register


def first_declarations(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first declaration of each id by ord, and the repeats."""
    n = nodes.withColumn("_at", F.row_number().over(Window.partitionBy("id").orderBy("ord")))
    return n.filter("_at = 1").drop("_at"), n.filter("_at > 1").drop("_at")


def with_ends(r: Register) -> DataFrame:
    """Edges with the nodes at both ends; null where an end isn't declared. Which side is small is left to adaptive execution."""
    n = r.nodes.select("id", "kind", "attrs")
    s = n.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"), F.col("attrs").alias("src_attrs"))
    t = n.select(F.col("id").alias("tgt"), F.col("kind").alias("tgt_kind"), F.col("attrs").alias("tgt_attrs"))
    return r.edges.join(s, "src", "left").join(t, "tgt", "left")


def dangling(r: Register, end: str = "tgt") -> DataFrame:
    return r.edges.join(r.nodes.select(F.col("id").alias(end)), end, "left_anti")


def degrees(r: Register) -> DataFrame:
    """Nodes with whether an edge names them as target or source; a far end need not be declared."""
    e = r.edges.select(F.explode(F.array(F.struct(F.col("tgt").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    e = e.groupBy("id").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    return r.nodes.join(e, "id", "left").select(r.nodes["*"], (F.coalesce("i", F.lit(0)) == 1).alias("has_incoming"), (F.coalesce("o", F.lit(0)) == 1).alias("has_outgoing"))


def orphans(r: Register, where: Column | None = None) -> DataFrame:
    d = degrees(r).filter("not has_incoming and not has_outgoing")
    return d.filter(where) if where is not None else d


def counts(r: Register, p: Profile, where: Column | None = None) -> DataFrame:
    """Nodes (filtered) and edges (not filtered) by kind; declared kinds are there with 0."""
    spark = r.nodes.sparkSession
    declared = spark.createDataFrame([("node", k) for k in p.node_kinds] + [("edge", k) for k in p.edge_kinds], "what string, kind string")
    n = (r.nodes.filter(where) if where is not None else r.nodes).groupBy("kind").count().withColumn("what", F.lit("node"))
    e = r.edges.groupBy("kind").count().withColumn("what", F.lit("edge"))
    return n.unionByName(e).join(declared, ["what", "kind"], "full_outer").select("what", "kind", F.coalesce("count", F.lit(0)).alias("n"))


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.round(part * 1000.0 / total) / 10)


def coverage_report(r: Register) -> DataFrame:
    g = degrees(r).groupBy("kind").agg(F.count("*").alias("total"), F.sum(F.col("has_incoming").cast("int")).alias("incoming"), F.sum(F.col("has_outgoing").cast("int")).alias("outgoing"))
    return g.select("*", percent(F.col("incoming"), F.col("total")).alias("incoming_pct"), percent(F.col("outgoing"), F.col("total")).alias("outgoing_pct"))


def uncovered(r: Register, target_kind: str, edge_kind: str, where: Column | None = None, source_where: Column | None = None) -> DataFrame:
    """Targets without an edge of the kind from a declared, admitted source."""
    sources = r.nodes.filter(source_where) if source_where is not None else r.nodes
    covered = r.edges.filter(F.col("kind") == edge_kind).select("src", "tgt").join(sources.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("tgt").alias("id"))
    targets = r.nodes.filter(F.col("kind") == target_kind)
    return (targets.filter(where) if where is not None else targets).join(covered, "id", "left_anti")


def unattributed(r: Register, p: Profile, edge_kind: str, source_where: Column | None = None, target_kind: str | None = None) -> DataFrame:
    """How many admitted sources (of target_kind, if given) there are and how many of them have no edge of the kind: one row (total, unattributed, pct, state)."""
    kinds = sorted({s for s, t in p.edge_kinds[edge_kind] if target_kind in (None, t)})
    s = r.nodes.filter(F.col("kind").isin(*kinds))
    s = s.filter(source_where) if source_where is not None else s
    used = r.edges.filter(F.col("kind") == edge_kind).select(F.col("src").alias("id")).distinct().withColumn("used", F.lit(True))
    g = s.join(used, "id", "left").agg(F.count("*").alias("total"), F.count_if(F.col("used").isNull()).alias("unattributed"))
    return g.select("*", percent(F.col("unattributed"), F.col("total")).alias("pct"), F.when(F.col("unattributed") == 0, "unverified").otherwise("unknown").alias("state"))


def edge_ends(r: Register, node_kind: str, edge_kind: str, direction: str = "out", group_by: str | None = None, where: Column | None = None) -> DataFrame:
    """Edges of a kind at nodes of a kind, both ends declared: id, far, value, src, tgt, file, line, ord. value: the far end's attribute; null where it is absent or null, and without group_by."""
    near, far = ("src", "tgt") if direction == "out" else ("tgt", "src")
    n = r.nodes.filter(F.col("kind") == node_kind)
    n = n.filter(where) if where is not None else n
    e = r.edges.filter(F.col("kind") == edge_kind).select(F.col(near).alias("id"), F.col(far).alias("far"), "src", "tgt", "file", "line", "ord")
    e = e.join(n.select("id"), "id").join(r.nodes.select(F.col("id").alias("far"), F.col("attrs").alias("far_attrs")), "far")
    value = F.col("far_attrs")[group_by] if group_by else F.lit(None).cast("string")
    return e.select("id", "far", F.when(value != "null", value).alias("value"), "src", "tgt", "file", "line", "ord")


def edge_counts(r: Register, node_kind: str, edge_kind: str, direction: str = "out", group_by: str | None = None, where: Column | None = None) -> DataFrame:
    """Edges of a kind at each node of a kind, 0 included; with group_by, for each value of the far end's attribute that is reached: edges without a value are in no group, and a node has 0 only if it has no edge. Both ends must be declared."""
    g = edge_ends(r, node_kind, edge_kind, direction, group_by, where).groupBy("id", "value").agg(F.count("*").alias("n"))
    n = r.nodes.filter(F.col("kind") == node_kind)
    n = n.filter(where) if where is not None else n
    n = n.select("id").join(g, "id", "left")
    if group_by:
        n = n.filter("n is null or value is not null")
    return n.select("id", "value", F.coalesce("n", F.lit(0)).alias("n"))


def _statuses(r: Register, kind: str, status: str, group_by: str) -> DataFrame:
    name = lambda a: F.coalesce(text_of(F.col("attrs")[a]), F.col("attrs")[a], F.lit("unknown"))
    return r.nodes.filter(F.col("kind") == kind).select(name(group_by).alias("grp"), name(status).alias("status"))


def rollup_long(r: Register, kind: str, status: str, group_by: str, values: list[str] | None = None) -> DataFrame:
    """The status table in long form, whatever the number of statuses: grp, status, n, total. total: all of the group; declared values are there with 0, others where they occur."""
    g = _statuses(r, kind, status, group_by)
    n = g.groupBy("grp", "status").agg(F.count("*").alias("n"))
    total = n.groupBy("grp").agg(F.sum("n").alias("total"))
    if values:
        blank = total.select("grp", F.explode(F.array(*(F.lit(v) for v in sorted(set(values))))).alias("status"))
        n = n.join(blank, ["grp", "status"], "full_outer").select("grp", "status", F.coalesce("n", F.lit(0)).alias("n"))
    return n.join(total, "grp").select("grp", "status", "n", "total")


#: The greatest number of columns of rollup().
WIDEST = 10_000


def rollup(r: Register, kind: str, status: str, group_by: str, values: list[str] | None = None) -> DataFrame:
    """Wide form of the status table: a row for each group, a column for each status, declared values included; it has no total. More statuses than WIDEST are an error: rollup_long has room for them."""
    g = _statuses(r, kind, status, group_by)
    seen = g.select("status").distinct()
    if values:
        seen = seen.union(r.nodes.sparkSession.createDataFrame([(v,) for v in values], "status string")).distinct()
    found = sorted(x[0] for x in seen.limit(WIDEST + 1).collect())
    if "total" in found:
        raise ValueError("'total' is the name of a column")
    if len(found) > WIDEST:
        raise ValueError(f"'{status}' has more than {WIDEST} values, too many for columns: use rollup_long")
    return g.groupBy("grp").pivot("status", found).count().na.fill(0)


def diff(a: Register, b: Register) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that two snapshots don't share: id or (src, tgt, kind, ordinal) with added, removed or changed. Parallel edges pair in order."""
    x = a.nodes.select("id", F.col("kind").alias("k1"), F.array_sort(F.map_entries("attrs")).alias("a1"))
    y = b.nodes.select("id", F.col("kind").alias("k2"), F.array_sort(F.map_entries("attrs")).alias("a2"))
    change = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "removed").when((F.col("k1") != F.col("k2")) | (F.col("a1") != F.col("a2")), "changed")
    nodes = x.join(y, "id", "full_outer").select("id", change.alias("change")).filter("change is not null")
    key = ["src", "tgt", "kind"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    x, y = (r.edges.select(*key, nth.alias("nth"), F.array_sort(F.map_entries("attrs")).alias(n), F.lit(True).alias(f"has_{n}")) for r, n in ((a, "a1"), (b, "a2")))
    change = F.when(F.col("has_a1").isNull(), "added").when(F.col("has_a2").isNull(), "removed").when(F.col("a1") != F.col("a2"), "changed")
    edges = x.join(y, [*key, "nth"], "full_outer").select(*key, "nth", change.alias("change")).filter("change is not null")
    return nodes, edges


def parallel(edges: DataFrame) -> DataFrame:
    """Edges with their place among those of the same ends, and how many there are."""
    w = Window.partitionBy("src", "tgt")
    return edges.select("*", (F.row_number().over(w.orderBy("kind", "ord")) - 1).alias("ordinal"), F.count("*").over(w).alias("parallel"))


def fuse(sources: dict[str, Register], allowed: dict[str, list[tuple[str, str, str, str]]]) -> tuple[Register, DataFrame]:
    """Composes registers: ids and kinds get their source's name; an edge of an allowed kind ('source:kind' -> pairs of (source, kind) ends) finds its target
    by raw id among the allowed kinds of all sources, any other in its own source. Returns the register and edges without a unique candidate (src, raw, kind, candidates)."""
    q = lambda s, c: F.concat_ws(":", F.lit(s), F.col(c))
    parts_n, parts_e = [], []
    for s, r in sources.items():
        parts_n.append(r.nodes.withColumn("raw", F.col("id")).withColumn("source", F.lit(s)).withColumn("id", q(s, "id")).withColumn("kind", q(s, "kind")))
        parts_e.append(r.edges.withColumn("raw", F.col("tgt")).withColumn("source", F.lit(s)).withColumn("src", q(s, "src")).withColumn("kind", q(s, "kind")))
    nodes, edges = (_union(x) for x in (parts_n, parts_e))
    spark = nodes.sparkSession
    rules = spark.createDataFrame([(k, f"{ts}:{tk}") for k, ends in allowed.items() for _, _, ts, tk in ends], "kind string, tgt_kind string").distinct()
    own = edges.join(rules.select("kind").distinct(), "kind", "left_anti").withColumn("tgt", F.concat_ws(":", "source", "raw"))
    cross = edges.join(rules, "kind").join(nodes.select(F.col("raw"), F.col("kind").alias("tgt_kind"), F.col("id").alias("found")), ["raw", "tgt_kind"], "left")
    keys = [c for c in edges.columns if c != "attrs"]
    cross = cross.groupBy(*keys).agg(F.first("attrs").alias("attrs"), F.count("found").alias("candidates"), F.min("found").alias("found"))
    fine = cross.filter("candidates = 1").withColumn("tgt", F.col("found")).select(*edges.columns)
    return Register(nodes.drop("raw", "source"), own.select(*edges.columns).unionByName(fine).drop("raw", "source")), cross.filter("candidates <> 1").select("src", "raw", "kind", "candidates")


def duplicates_across(sources: dict[str, Register]) -> DataFrame:
    every = _union([r.nodes.select("id", F.lit(s).alias("source")).distinct() for s, r in sources.items()])
    return every.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).filter("n > 1")


def suggest(sources: DataFrame, targets: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """The k nearest targets of each source by cosine among those of its kind pair. sources, targets: id, block, vec; block is the allowed kind pair, so only allowed pairs meet. Zero norms score 0; a score below least isn't suggested."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    s = sources.select("block", F.col("id").alias("src"), F.col("vec").alias("a"), norm(F.col("vec")).alias("na"))
    t = targets.select("block", F.col("id").alias("tgt"), F.col("vec").alias("b"), norm(F.col("vec")).alias("nb"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    p = s.join(t, "block").filter("src <> tgt").select("src", "tgt", F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(dot / (F.col("na") * F.col("nb"))).alias("score")).filter(F.col("score") >= least)
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "tgt"))).filter(F.col("rank") <= k)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
