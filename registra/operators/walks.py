"""Checked queries on the graph: refusals, adjacency, depth-first steps, betweenness, and orders for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import filters
from ..model import Profile, Register
from ..shared import cut
from . import graph

#: Edges of a cone that depth-first steps may bring to the driver; a larger cone is refused, never cut.
CONE = 2_000_000
STEP = "step long, depth int, id string, edge_kind string, visit string, endpoint string, ordinal int, parallel int, tainted boolean"


class QueryError(ValueError):
    """A question that can't be answered as asked; a register's faults are findings, never this."""


def check_edge_kinds(p: Profile, kinds: list[str]) -> None:
    """Refuses kinds that the profile doesn't declare, naming the least."""
    if unknown := sorted(k for k in kinds if k not in p.edge_kinds):
        raise QueryError(f"unknown edge kind '{unknown[0]}'")


def check_kind(p: Profile, kind: str) -> None:
    if kind not in p.node_kinds:
        raise QueryError(f"unknown kind '{kind}'; declared: {', '.join(p.node_kinds)}")


def check_node(r: Register, id_: str) -> None:
    if not r.nodes.filter(F.col("id") == id_).limit(1).count():
        raise QueryError(f"unknown node '{id_}'")


def adjacency(edges: DataFrame, kinds: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(near, far, kind, ord) in one direction. kinds: None for all, an empty list for no edges. order_by() gives the order of walks."""
    near, far = ("tgt", "src") if reverse else ("src", "tgt")
    e = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds)) if kinds else edges.filter(F.lit(False))
    return e.select(F.col(near).alias("near"), F.col(far).alias("far"), "kind", "ord")


def order_by(adjacent: DataFrame) -> DataFrame:
    return adjacent.orderBy("near", "far", "kind", "ord")


def reach(r: Register, p: Profile, origin: str, kinds: list[str], reverse: bool = False, where: list[str] = (), check_resolved: bool = False) -> DataFrame:
    """Declared nodes behind the origin, by id; filters select from the answer and never cut the walk. Refuses unknown nodes and edge kinds."""
    check_node(r, origin)
    check_edge_kinds(p, kinds)
    e = adjacency(r.edges, kinds).select(F.col("near").alias("src"), F.col("far").alias("tgt"))
    got = graph.reach(r.nodes, e, origin, reverse, check_resolved).join(r.nodes.select("id", "kind", "attrs"), "id")
    got = got.filter(filters(list(where))) if where else got
    return got.select("id", "kind", *(["tainted"] if check_resolved else [])).orderBy("id")


def traverse(r: Register, root: str, kinds: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Depth-first steps in order: each edge leads to a step, and a node that was met before isn't entered again.

    visit: first, cycle (the node is on the way from the root) or reconvergence; endpoint: declared or vacancy; ordinal, parallel: place among the
    edges with the same two ends; tainted: no way to the node runs over declared nodes alone. The cone is found by distributed
    rounds; its edges, sorted, then come to the driver, up to CONE of them, since the order of steps is sequential."""
    check_node(r, root)
    a = adjacency(r.edges, kinds, reverse)
    e = a.select(F.col("near").alias("src"), F.col("far").alias("tgt"))
    inside = graph.layers(e, root).select("id").union(r.nodes.sparkSession.createDataFrame([(root,)], "id string")).distinct()
    clean = graph.layers(e, root, enter=r.nodes.select("id")).select("id", F.lit(True).alias("clean"))
    rows = a.join(inside.select(F.col("id").alias("near")), "near", "left_semi")
    rows = rows.join(r.nodes.select(F.col("id").alias("far"), F.lit(True).alias("declared")), "far", "left").join(clean.withColumnRenamed("id", "far"), "far", "left")
    rows = cut(rows)
    if rows.limit(CONE + 1).count() > CONE:
        raise QueryError(f"the cone of '{root}' has more than {CONE} edges, too many for steps in order")
    out_of: dict[str, list] = {}
    for x in rows.orderBy("near", "far", "kind", "ord").toLocalIterator():
        out_of.setdefault(x.near, []).append((x.far, x.kind, bool(x.declared), bool(x.clean)))
    steps, met, way = [(0, 0, root, None, "first", "declared", 0, 1, False)], {root}, {root}
    stack = [(root, iter(_groups(out_of.get(root, ()))))]
    while stack:
        near, todo = stack[-1]
        nxt = next(todo, None)
        if nxt is None:
            stack.pop()
            way.discard(near)
            continue
        (far, kind, declared, is_clean), nth, n = nxt
        visit = "cycle" if far in way else "reconvergence" if far in met else "first"
        steps.append((len(steps), len(stack), far, kind, visit, "declared" if declared else "vacancy", nth, n, far != root and not is_clean))
        if visit == "first":
            met.add(far)
            way.add(far)
            stack.append((far, iter(_groups(out_of.get(far, ())))))
    return r.nodes.sparkSession.createDataFrame(steps, STEP)


def _groups(edges):
    """(edge, place among those with the same far end, how many they are)."""
    count: dict[str, int] = {}
    for e in edges:
        count[e[0]] = count.get(e[0], 0) + 1
    seen: dict[str, int] = {}
    for e in edges:
        nth = seen.get(e[0], 0)
        seen[e[0]] = nth + 1
        yield e, nth, count[e[0]]


def betweenness(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): the share of shortest ways between others that a node lies on, scaled so that the greatest is 1.

    Ways start at every one of ids and run forward; parallel edges count once and self-loops not. All sources go side by side, level by level, so the tables have
    a row for each pair of a source and a node that it reaches: for bounded subgraphs, such as a cone."""
    e = cut(edges.filter("src <> tgt").select("src", "tgt").distinct())
    front = cut(ids.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("ways")).distinct())
    levels, seen = [front], front.select("s", "v")
    while True:
        new = front.join(e.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("tgt").alias("v")).agg(F.sum("ways").alias("ways"))
        front = cut(new.join(seen, ["s", "v"], "left_anti"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.union(front.select("s", "v"))
    share, total = None, None
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        low = lower.withColumn("d", F.lit(0.0)) if share is None else lower.join(share, ["s", "v"], "left").na.fill(0.0, ["d"])
        pull = low.select("s", F.col("v").alias("tgt"), ((1 + F.col("d")) / F.col("ways")).alias("pull")).join(e, "tgt").withColumnRenamed("src", "v")
        share = cut(upper.join(pull, ["s", "v"]).groupBy("s", "v").agg(F.sum(F.col("ways") * F.col("pull")).alias("d")))
        part = share.filter("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("d").alias("d"))
        total = part if total is None else total.union(part)
    every = ids.select("id").distinct()
    if total is None:
        return every.withColumn("score", F.lit(0.0))
    got = every.join(total.groupBy("id").agg(F.sum("d").alias("d")), "id", "left").na.fill(0.0, ["d"])
    most = F.max("d").over(Window.partitionBy())  # one number a node of a bounded subgraph
    return got.select("id", F.when(most > 0, F.col("d") / most).otherwise(0.0).alias("score"))


def component_order(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, layer): strongly connected components, each one's layer the longest way to it in the condensed graph, which is acyclic, so every node has one."""
    of = cut(graph.sccs_all(ids, edges))
    a, b = (of.select(F.col("id").alias(n), F.col("component").alias(f"c_{n}")) for n in ("src", "tgt"))
    links = edges.select("src", "tgt").join(a, "src").join(b, "tgt").filter("c_src <> c_tgt").select(F.col("c_src").alias("src"), F.col("c_tgt").alias("tgt")).distinct()
    layer = graph.topological(links).select(F.col("id").alias("component"), "layer")
    return of.join(layer, "component", "left").select("id", "component", F.coalesce("layer", F.lit(0)).alias("layer"))


def lanes(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, row, lane) for a drawing of a bounded cone: components in topological order, least name first among those that may come,
    one a row; a component takes the lane of the first row that waits for it, else the first free one, and its other waiting lanes become free."""
    of = cut(graph.sccs_all(ids, edges))
    pairs = edges.select("src", "tgt").join(of.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("id").alias("tgt"), F.col("component").alias("b")), "tgt").filter("a <> b").select("a", "b").distinct()
    if pairs.limit(CONE + 1).count() > CONE:
        raise QueryError(f"more than {CONE} links between components, too many to draw")
    import heapq

    after: dict[str, list[str]] = {}
    need: dict[str, int] = {r[0]: 0 for r in of.select("component").distinct().toLocalIterator()}
    for a, b in sorted((r.a, r.b) for r in pairs.toLocalIterator()):
        after.setdefault(a, []).append(b)
        need[b] += 1
    ready = [c for c, n in need.items() if n == 0]
    heapq.heapify(ready)
    waiting: list[str | None] = []  # by lane: the component that the lane's line runs to
    placed = []
    while ready:
        c = heapq.heappop(ready)
        mine = [i for i, x in enumerate(waiting) if x == c]
        lane = mine[0] if mine else next((i for i, x in enumerate(waiting) if x is None), len(waiting))
        if lane == len(waiting):
            waiting.append(None)
        for i in mine:
            waiting[i] = None
        placed.append((c, len(placed), lane))
        for k, b in enumerate(after.get(c, ())):
            if b not in waiting:
                at = lane if k == 0 and waiting[lane] is None else next((i for i, x in enumerate(waiting) if x is None and i != lane), len(waiting))
                waiting[at:at + 1] = [b]
            need[b] -= 1
            if not need[b]:
                heapq.heappush(ready, b)
    return of.join(F.broadcast(of.sparkSession.createDataFrame(placed, "component string, row long, lane int")), "component").select("id", "component", "row", "lane")
