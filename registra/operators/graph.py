"""Walks, fixed points and components over an edge table (src, tgt), as loops of joins with a written table each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def layers(edges: DataFrame, origin: str, max_depth: int | None = None, reverse: bool = False, enter: DataFrame | None = None) -> DataFrame:
    """(id, depth): what the origin reaches, by first hop, itself left out. enter: ids that may be entered; others neither appear nor lead on. The visited table grows by the new frontier alone."""
    near, far = ("tgt", "src") if reverse else ("src", "tgt")
    step = edges.select(F.col(near).alias("id"), F.col(far).alias("to")).filter(F.col("to") != origin).distinct()
    if enter is not None:
        step = step.join(enter.select(F.col("id").alias("to")), "to", "left_semi")
    step = cut(step)
    spark = edges.sparkSession
    frontier, seen, depth = spark.createDataFrame([(origin, 0)], "id string, depth int"), None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.select("id").join(step, "id").select(F.col("to").alias("id")).distinct()
        if seen is not None:
            new = new.join(seen.select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = frontier if seen is None else seen.union(frontier)
    return seen if seen is not None else frontier.filter("false")


def reach(nodes: DataFrame, edges: DataFrame, origin: str, reverse: bool = False, check_resolved: bool = False) -> DataFrame:
    """Declared nodes that the origin reaches; walks pass through undeclared ends. With check_resolved also tainted: reached only through such an end."""
    declared = nodes.select("id")
    out = layers(edges, origin, reverse=reverse).join(declared, "id", "left_semi")
    if not check_resolved:
        return out
    clean = layers(edges, origin, reverse=reverse, enter=declared).select("id", F.lit(False).alias("tainted"))
    return out.join(clean, "id", "left").select("id", "depth", F.coalesce("tainted", F.lit(True)).alias("tainted"))


def path(edges: DataFrame, origin: str, goal: str, max_depth: int | None = None) -> DataFrame:
    """One shortest path, ties to the least sequence of ids, then kinds: (nodes, kinds), or no row. Each round keeps one best path for each new id."""
    spark = edges.sparkSession
    best = spark.createDataFrame([(origin, [origin], [])], "id string, nodes array<string>, kinds array<string>")
    step = cut(edges.groupBy(F.col("src").alias("id"), F.col("tgt").alias("to")).agg(F.min("kind").alias("kind")))
    seen, depth = best.select("id"), 0
    while not best.filter(F.col("id") == goal).limit(1).count():
        depth += 1
        if max_depth is not None and depth > max_depth or not best.limit(1).count():
            return best.filter("false").select("nodes", "kinds")
        more = best.join(step, "id").select(F.col("to").alias("id"), F.struct(F.concat("nodes", F.array("to")).alias("nodes"), F.concat("kinds", F.array("kind")).alias("kinds")).alias("p"))
        best = cut(more.join(seen, "id", "left_anti").groupBy("id").agg(F.min("p").alias("p")).select("id", "p.nodes", "p.kinds"))
        seen = seen.union(best.select("id"))
    return best.filter(F.col("id") == goal).select("nodes", "kinds")


def deep_uncovered(targets: DataFrame, via: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Targets (id) outside the least fixed point of: evidenced, or with at least one via child (child src -> parent tgt) and all of them covered. Cycles without evidence stay out."""
    links = cut(via.select(F.col("src").alias("child"), F.col("tgt").alias("id")).distinct())
    need = links.groupBy("id").agg(F.count("*").alias("need"))
    covered = cut(evidenced.select("id").distinct())
    new = covered
    left = cut(need.join(covered, "id", "left_anti"))
    while new.limit(1).count():
        done = links.join(new.select(F.col("id").alias("child")), "child", "left_semi").groupBy("id").agg(F.count("*").alias("done"))
        left = cut(left.join(done, "id", "left").select("id", (F.col("need") - F.coalesce("done", F.lit(0))).alias("need")))
        new = cut(left.filter("need = 0").select("id"))
        left = left.filter("need > 0")
        covered = covered.union(new)
    return targets.select("id").distinct().join(covered, "id", "left_anti")


def uncovered_causes(uncovered: DataFrame, via: DataFrame) -> DataFrame:
    """(id, members, children) for each of deep_uncovered's targets: the sorted members of its cycle of uncovered targets, if it is on one, and its sorted uncovered children; null where there are none. Each member of a cycle names all of them."""
    ids = cut(uncovered.select("id"))
    within = lambda e, n: e.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    bad = cut(within(via.select("src", "tgt").distinct(), ids))
    core = bad
    of = cut(sccs(core))
    loops = bad.filter("src = tgt").select(F.col("src").alias("id"))
    rings = of.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
    rings = of.join(rings, "component").join(loops.withColumn("loop", F.lit(True)), "id", "left").filter("size(members) > 1 or loop").select("id", "members")
    kids = bad.groupBy(F.col("tgt").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("children"))
    return ids.join(rings, "id", "left").join(kids, "id", "left")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that lie on cycles or between cycles: what is peeled from either end is a component of its own."""
    core = edges.select("src", "tgt").filter("src <> tgt").distinct()
    for turn in (False, True):
        e = core.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")) if turn else core
        tree = topological(e).select("id")
        core = cut(core.join(tree.select(F.col("id").alias("src")), "src", "left_anti").join(tree.select(F.col("id").alias("tgt")), "tgt", "left_anti"))
    return core


def sccs_all(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """sccs() with the given ids that have no edges too, each a component of its own."""
    return ids.select("id").union(edges.select("src")).union(edges.select("tgt")).distinct().join(sccs(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def sccs(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of nodes with edges, named by their greatest id.

    What isn't on or between cycles is peeled off first, layer by layer, each node a component of its own. In the rest greatest labels flow forward to a
    fixed point; whoever reaches the label's owner within its colour is its component, and the rest goes round again."""
    every = cut(edges.select(F.col("src").alias("id")).union(edges.select("tgt")).distinct())
    e = trimmed(edges)
    ids = cut(e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct())
    found = cut(every.join(ids, "id", "left_anti").select("id", F.col("id").alias("component")))
    while ids.limit(1).count():
        lab = ids.withColumn("c", F.col("id"))
        state = None
        while True:
            into = e.join(lab.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("tgt").alias("id")).agg(F.max("c").alias("m"))
            lab = cut(lab.join(into, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c")))
            now = lab.agg(F.bit_xor(F.xxhash64("id", "c"))).first()[0]
            if now == state:
                break
            state = now
        inner = cut(e.join(lab.select(F.col("id").alias("src"), F.col("c").alias("c")), "src").join(lab.select(F.col("id").alias("tgt"), F.col("c").alias("d")), "tgt").filter("c = d").select("src", "tgt", "c"))
        members = front = cut(lab.filter("id = c").select("id"))
        while front.limit(1).count():
            front = cut(inner.join(front.select(F.col("id").alias("tgt")), "tgt").select(F.col("src").alias("id")).distinct().join(members, "id", "left_anti"))
            members = members.union(front)
        part = cut(lab.join(members, "id", "left_semi").select("id", F.col("c").alias("component")))
        found = found.union(part)
        ids = cut(ids.join(part, "id", "left_anti"))
        e = cut(e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("tgt")), "tgt", "left_semi"))
    return found


def topological(edges: DataFrame) -> DataFrame:
    """(id, layer): nodes with edges by the length of the longest way to them, peeled layer by layer; what lies on or behind a cycle has none and is left out. Each round reads the links that the last layer uncovers."""
    e = cut(edges.select("src", "tgt").distinct())
    need = cut(e.groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("need")))
    front = out = cut(e.select(F.col("src").alias("id")).distinct().join(need, "id", "left_anti").withColumn("layer", F.lit(0)))
    layer = 0
    while front.limit(1).count():
        layer += 1
        done = e.join(front.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("done"))
        need = cut(need.join(done, "id", "left").select("id", (F.col("need") - F.coalesce("done", F.lit(0))).alias("need")))
        front = cut(need.filter("need = 0").select("id", F.lit(layer).alias("layer")))
        need = need.filter("need > 0")
        out = out.union(front)
    return out
