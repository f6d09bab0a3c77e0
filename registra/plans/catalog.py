"""The queries over the driver's tables, seen as a register, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import condition, filters
from ..model import NodeKind, Profile, Register, attrs, edge, literal, node
from ..operators import graph
from ..operators import relations as rel
from ..operators import reports
from . import validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def key(prefix: str, *columns: str):
    return F.concat(F.lit(prefix), F.concat_ws("-", *columns))


def shop(spark: SparkSession, d: str, line_nodes: bool = True, open_orders: bool = True) -> Register:
    """Regions to line items as nodes, foreign keys as edges. open_orders: declare orders of status P too."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    o = t["orders"] if open_orders else t["orders"].filter("o_orderstatus <> 'P'")
    oa = attrs(status=literal(F.col("o_orderstatus"), "string"), priority=literal(F.col("o_orderpriority"), "string"), cust=literal(F.col("o_custkey"), "int"))
    nodes = [
        node(t["region"], key("R-", "r_regionkey"), "region"), node(t["nation"], key("N-", "n_nationkey"), "nation"),
        node(t["customer"], key("C-", "c_custkey"), "customer", attrs(segment=literal(F.col("c_mktsegment"), "string"))),
        node(t["supplier"], key("S-", "s_suppkey"), "supplier"), node(t["part"], key("P-", "p_partkey"), "part", attrs(size=literal(F.col("p_size"), "int"), brand=literal(F.col("p_brand"), "string"))),
        node(o, key("O-", "o_orderkey"), "order", oa),
    ]
    edges = [
        edge(t["nation"], key("N-", "n_nationkey"), key("R-", "n_regionkey"), "in_region"), edge(t["customer"], key("C-", "c_custkey"), key("N-", "c_nationkey"), "in_nation"),
        edge(t["supplier"], key("S-", "s_suppkey"), key("N-", "s_nationkey"), "in_nation"), edge(t["orders"], key("O-", "o_orderkey"), key("C-", "o_custkey"), "placed_by"),
        edge(t["lineitem"], key("L-", "l_orderkey", "l_linenumber"), key("O-", "l_orderkey"), "of_order"), edge(t["lineitem"], key("L-", "l_orderkey", "l_linenumber"), key("P-", "l_partkey"), "of_part"),
    ]
    if line_nodes:
        nodes.append(node(t["lineitem"].select("l_orderkey", "l_linenumber").distinct(), key("L-", "l_orderkey", "l_linenumber"), "line"))
    return Register(rel._union(nodes), rel._union(edges), {"priority": (["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "3-MEDIUM")})


SHOP = Profile(
    {"region": NodeKind("R-[0-9]+"), "nation": NodeKind("N-[0-9]+"), "customer": NodeKind("C-[0-9]+"), "supplier": NodeKind("S-[0-9]+"), "part": NodeKind("P-[0-9]+"), "order": NodeKind("O-[0-9]+"), "line": NodeKind("L-[0-9]+-[0-9]+"), "ghost": NodeKind()},
    {"in_region": [("nation", "region")], "in_nation": [("customer", "nation")], "placed_by": [("order", "customer")], "of_order": [("line", "order")], "of_part": [("line", "part")]},
)


@query("V12_coverage", "SELECT 'O-' || o_orderkey AS node_id, 'COVERAGE' AS code FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def _coverage(spark, d):
    return rel.uncovered(shop(spark, d), "order", "of_order").select(F.col("id").alias("node_id"), F.lit("COVERAGE").alias("code"))


@query("J2_vacancy", "SELECT 'L-' || l_orderkey || '-' || l_linenumber AS src, 'O-' || l_orderkey AS tgt, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY ALL")
def _vacancy(spark, d):
    r = shop(spark, d, open_orders=False)
    return rel.dangling(Register(r.nodes, r.edges.filter("kind = 'of_order'"))).groupBy("src", "tgt").agg(F.count("*").alias("n"))


@query("A1_counts", """
SELECT 'node' AS what, kind, n FROM (SELECT 'region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'line', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT 'ghost', 0)
UNION ALL SELECT 'edge', kind, n FROM (SELECT 'in_region' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'in_nation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'placed_by', count(*) FROM orders UNION ALL SELECT 'of_order', count(*) FROM lineitem UNION ALL SELECT 'of_part', count(*) FROM lineitem)""")
def _counts(spark, d):
    return rel.counts(shop(spark, d), SHOP)


@query("A2_coverage_report", """
WITH l AS (SELECT count(DISTINCT l_orderkey || '-' || l_linenumber) AS n FROM lineitem),
t AS (SELECT 'region' AS kind, count(*) AS total, count(*) FILTER (r_regionkey IN (SELECT n_regionkey FROM nation)) AS incoming, 0 AS outgoing FROM region
UNION ALL SELECT 'nation', count(*), count(*) FILTER (n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)), count(*) FROM nation
UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)), count(*) FROM customer
UNION ALL SELECT 'supplier', count(*), 0, count(*) FROM supplier
UNION ALL SELECT 'part', count(*), count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)), 0 FROM part
UNION ALL SELECT 'order', count(*), count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)), count(*) FROM orders
UNION ALL SELECT 'line', n, 0, n FROM l)
SELECT kind, total, incoming::BIGINT AS incoming, outgoing::BIGINT AS outgoing, round(incoming * 1000.0 / total) / 10 AS incoming_pct, round(outgoing * 1000.0 / total) / 10 AS outgoing_pct FROM t""")
def _coverage_report(spark, d):
    return rel.coverage_report(shop(spark, d))


@query("J5_edge_constraint", "SELECT 'supplier' AS src_kind, 'in_nation' AS kind, count(*) AS n FROM supplier")
def _constraint(spark, d):
    r = shop(spark, d)
    allowed = spark.createDataFrame([(k, s, t) for k, v in SHOP.edge_kinds.items() for s, t in v], "kind string, src_kind string, tgt_kind string")
    return rel.with_ends(r).join(F.broadcast(allowed), ["kind", "src_kind", "tgt_kind"], "left_anti").groupBy("src_kind", "kind").agg(F.count("*").alias("n"))


def _flawed_parts(spark, d) -> DataFrame:
    """Parts whose size is absent, null or mistyped by the key's remainders."""
    k = F.col("p_partkey")
    size = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, "null").when(k % 11 == 0, literal(F.col("p_size").cast("string"), "string")).otherwise(literal(F.col("p_size"), "int"))
    return node(table(spark, d, "part"), key("P-", "p_partkey"), "part", attrs(size=size, brand=literal(F.col("p_brand"), "string")), order=k)


_FLAWED = "WITH f AS (SELECT 'P-' || p_partkey AS id, p_brand, CASE WHEN p_partkey % 5 = 0 THEN 'absent' WHEN p_partkey % 7 = 0 THEN 'null' WHEN p_partkey % 11 = 0 THEN 'text' ELSE 'int' END AS t, p_size AS v FROM part)"


@query("P1_P9_conditions", _FLAWED + """
SELECT 'eq' AS op, count(*) AS n FROM f WHERE t = 'int' AND v = 10 UNION ALL SELECT 'ne', count(*) FROM f WHERE NOT (t = 'int' AND v = 10) UNION ALL SELECT 'in', count(*) FROM f WHERE t = 'int' AND v IN (1, 2, 3)
UNION ALL SELECT 'lt', count(*) FROM f WHERE t = 'int' AND v < 10 UNION ALL SELECT 'gt', count(*) FROM f WHERE t = 'int' AND v > 10 UNION ALL SELECT 'lte', count(*) FROM f WHERE t = 'int' AND v <= 10 UNION ALL SELECT 'gte', count(*) FROM f WHERE t = 'int' AND v >= 10
UNION ALL SELECT 'matches', count(*) FROM f WHERE t IN ('int', 'text') AND regexp_matches(v::VARCHAR, '^1') UNION ALL SELECT 'present', count(*) FROM f WHERE t <> 'absent' UNION ALL SELECT 'eq_text', count(*) FROM f WHERE t = 'text' AND v = 10""")
def _conditions(spark, d):
    n = _flawed_parts(spark, d)
    ops = {"eq": 10, "ne": 10, "in": [1, 2, 3], "lt": 10, "gt": 10, "lte": 10, "gte": 10, "matches": "^1", "present": True}
    tests = {op: condition("size", op, v) for op, v in ops.items()} | {"eq_text": condition("size", "eq", "10")}
    one = n.agg(*(F.count_if(c).alias(op) for op, c in tests.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(op).alias("op"), F.col(op).alias("n")) for op in tests))).alias("r")).select("r.*")


@query("P12_filter_grammar", "SELECT 'P-' || p_partkey AS id FROM part WHERE p_size >= 40 AND p_brand <> 'Brand#11' AND regexp_matches(p_brand, '#1')")
def _filter(spark, d):
    return shop(spark, d).nodes.filter("kind = 'part'").filter(filters(["size>=40", "brand!=Brand#11", "brand~=#1"])).select("id")


@query("V6_V9_attributes", _FLAWED + " SELECT CASE t WHEN 'absent' THEN 'ATTR_REQUIRED' ELSE 'ATTR_TYPE' END AS code, id AS node_id FROM f WHERE t <> 'int' UNION ALL SELECT 'ATTR_ENUM', id FROM f WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')")
def _attributes(spark, d):
    p = Profile({"part": NodeKind("P-[0-9]+", {"size": {"type": "int", "required": True}, "brand": {"type": "enum", "values": ["Brand#11", "Brand#12", "Brand#13"]}}, orphan_ok=True)}, {"x": [("part", "part")]})
    r = Register(_flawed_parts(spark, d), shop(spark, d).edges.filter("false"))
    return rel._union(validate.node_checks(r, p)).filter("code like 'ATTR%'").select("code", "node_id")


@query("V10_V11_referenced", "SELECT 'UNREFERENCED' AS code, 'P-' || p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'UNREFERENCED', 'O-' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'UNREFERENCED', 'C-' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'UNREFERENCED', 'N-' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'UNREFERENCED', 'R-' || r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)")
def _referenced(spark, d):
    return rel._union(validate.node_checks(shop(spark, d), SHOP)).filter("code in ('UNREFERENCED', 'UNTRACED')").select("code", "node_id")


@query("V15_constraint", "SELECT 'O-' || o_orderkey AS node_id FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderstatus <> 'F' OR o_custkey < 100)")
def _node_constraint(spark, d):
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, validations=({"code": "CONSTRAINT", "node_kind": "order", "when": {"priority": {"eq": "1-URGENT"}}, "expect": {"status": {"eq": "F"}}, "reject": {"cust": {"lt": 100}}},))
    return rel._union(validate.rule_checks(shop(spark, d), p)).select("node_id")


@query("V16_edge_where", "SELECT 'O-' || o_orderkey AS node_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def _edge_where(spark, d):
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, validations=({"code": "EDGE_WHERE", "edge_kind": "placed_by", "when": {"source": {"status": {"eq": "F"}}}, "reject": {"target": {"segment": {"eq": "BUILDING"}}}},))
    return rel._union(validate.edge_checks(shop(spark, d), p)).filter("code = 'EDGE_WHERE'").select("node_id")


@query("A5_edge_count", "SELECT 'C-' || c_custkey AS node_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) NOT BETWEEN 5 AND 15")
def _edge_count(spark, d):
    return rel.edge_counts(shop(spark, d), "customer", "placed_by", "in").filter("n < 5 or n > 15").select(F.col("id").alias("node_id"), "n")


@query("A6_edge_count_grouped", "SELECT 'C-' || c_custkey AS node_id, CASE WHEN o_orderstatus IS NULL THEN NULL ELSE '\"' || o_orderstatus || '\"' END AS value, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, o_orderstatus")
def _edge_count_grouped(spark, d):
    return rel.edge_counts(shop(spark, d), "customer", "placed_by", "in", "status").select(F.col("id").alias("node_id"), "value", "n")


@query("V17_edge_count_grouped", "SELECT 'C-' || c_custkey AS node_id, CASE WHEN o_orderstatus <> 'P' THEN count(*) ELSE 0 END AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_orderkey END HAVING o_orderstatus = 'P' OR count(*) > 5")
def _edge_count_rule(spark, d):
    """Orders of status P have no status here, so each of them is a finding of its own, with 0 for its count."""
    r = shop(spark, d)
    n = r.nodes.withColumn("attrs", F.when(condition("status", "eq", "P"), F.map_filter("attrs", lambda k, _: k != "status")).otherwise(F.col("attrs")))
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, validations=({"code": "EDGE_COUNT", "node_kind": "customer", "edge_kind": "placed_by", "direction": "in", "group_by": "status", "max": 5},))
    f = rel._union(validate.rule_checks(Register(n, r.edges), p))
    return f.select("node_id", F.expr("coalesce(try_cast(regexp_extract(message, 'has ([0-9]+) incoming', 1) as bigint), 0)").alias("n"))


@query("A7_rollup", "SELECT o_orderpriority AS grp, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, 0::BIGINT AS X FROM orders GROUP BY 1")
def _rollup(spark, d):
    return rel.rollup(shop(spark, d, line_nodes=False), "order", "status", "priority", ["F", "O", "P", "X"])


@query("A7_rollup_long", "WITH v AS (SELECT unnest(['F', 'O', 'P', 'X']) AS status), g AS (SELECT o_orderpriority AS grp, count(*) AS total FROM orders GROUP BY 1) SELECT grp, v.status, count(o_orderkey) AS n, total FROM g CROSS JOIN v LEFT JOIN orders ON o_orderpriority = grp AND o_orderstatus = v.status GROUP BY ALL")
def _rollup_long(spark, d):
    return rel.rollup_long(shop(spark, d, line_nodes=False), "order", "status", "priority", ["F", "O", "P", "X"])


@query("A12_unattributed", "SELECT count(*) AS total, count(*) FILTER (l IS NULL) AS unattributed, round(count(*) FILTER (l IS NULL) * 1000.0 / count(*)) / 10 AS pct, CASE WHEN count(*) FILTER (l IS NULL) = 0 THEN 'unverified' ELSE 'unknown' END AS state FROM (SELECT c_custkey, max(o_orderkey) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def _unattributed(spark, d):
    r = shop(spark, d)
    back = Register(r.nodes, r.edges.filter("kind = 'placed_by'").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "kind", "attrs", "file", "line", "ord"))
    return rel.unattributed(back, Profile(SHOP.node_kinds, {"placed_by": [("customer", "order")]}), "placed_by")


@query("S6_first_declaration", "SELECT 'L-' || l_orderkey || '-' || l_linenumber AS id, count(*) - 1 AS repeats FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _declarations(spark, d):
    t = table(spark, d, "lineitem")
    _, again = rel.first_declarations(node(t, key("L-", "l_orderkey", "l_linenumber"), "line", order=F.col("l_partkey")))
    return again.groupBy("id").agg(F.count("*").alias("repeats"))


@query("W2_parallel_edges", "SELECT src, tgt, row_number() OVER (PARTITION BY src, tgt ORDER BY ord) - 1 AS ordinal, count(*) OVER (PARTITION BY src, tgt) AS parallel FROM (SELECT 'O-' || l_orderkey AS src, 'P-' || l_partkey AS tgt, l_linenumber AS ord FROM lineitem)")
def _parallel(spark, d):
    e = edge(table(spark, d, "lineitem"), key("O-", "l_orderkey"), key("P-", "l_partkey"), "holds", order=F.col("l_linenumber"))
    return rel.parallel(e).select("src", "tgt", "ordinal", "parallel")


@query("J10_diff", "WITH a AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 1) SELECT 'O-' || coalesce(a.o_orderkey, b.o_orderkey) AS id, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE a.s IS DISTINCT FROM b.s")
def _diff(spark, d):
    o = table(spark, d, "orders")
    none = edge(o.filter("false"), key("O-", "o_orderkey"), key("C-", "o_custkey"), "placed_by")
    status = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    a = node(o.filter("o_orderkey % 10 <> 0"), key("O-", "o_orderkey"), "order", attrs(status=literal(F.col("o_orderstatus"), "string")))
    b = node(o.filter("o_orderkey % 10 <> 1"), key("O-", "o_orderkey"), "order", attrs(status=literal(status, "string")))
    return rel.diff(Register(a, none), Register(b, none))[0]


@query("J10_diff_all", f"""
WITH pa AS (SELECT 'O-' || o_orderkey AS src, 'C-' || o_custkey AS tgt, o_orderpriority AS v FROM orders WHERE o_orderkey % 10 <> 0), pb AS (SELECT 'O-' || o_orderkey AS src, 'C-' || o_custkey AS tgt, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 10 <> 1),
l AS (SELECT 'L-' || l_orderkey || '-' || l_linenumber AS src, 'O-' || l_orderkey AS tgt, l_partkey % 10 AS m FROM lineitem), la AS (SELECT src, tgt, row_number() OVER (PARTITION BY src, tgt) AS nth, 1 AS v FROM l WHERE m <> 0), lb AS (SELECT src, tgt, row_number() OVER (PARTITION BY src, tgt) AS nth, 1 AS v FROM l WHERE m <> 1)
SELECT 'node' AS what, id AS src, '' AS tgt, 'order' AS kind, 0 AS nth, change FROM ({SQL["J10_diff"]})
UNION ALL SELECT 'edge', src, tgt, 'placed_by', 1, CASE WHEN pa.v IS NULL THEN 'added' WHEN pb.v IS NULL THEN 'removed' ELSE 'changed' END FROM pa FULL JOIN pb USING (src, tgt) WHERE pa.v IS DISTINCT FROM pb.v
UNION ALL SELECT 'edge', src, tgt, 'of_order', nth, CASE WHEN la.v IS NULL THEN 'added' ELSE 'removed' END FROM la FULL JOIN lb USING (src, tgt, nth) WHERE la.v IS DISTINCT FROM lb.v""")
def _diff_all(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    k = F.col("o_orderkey")

    def snapshot(keep: int, part: str, status, priority) -> Register:
        mine = o.filter(k % 10 != keep)
        n = node(mine, key("O-", "o_orderkey"), "order", attrs(status=literal(status, "string")))
        e = edge(mine, key("O-", "o_orderkey"), key("C-", "o_custkey"), "placed_by", attrs(priority=literal(priority, "string")))
        return Register(n, e.unionByName(edge(l.filter(part), key("L-", "l_orderkey", "l_linenumber"), key("O-", "l_orderkey"), "of_order")))

    a = snapshot(0, "l_partkey % 10 <> 0", F.col("o_orderstatus"), F.col("o_orderpriority"))
    b = snapshot(1, "l_partkey % 10 <> 1", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(k % 11 == 0, "X").otherwise(F.col("o_orderpriority")))
    n, e = rel.diff(a, b)
    return n.select(F.lit("node").alias("what"), F.col("id").alias("src"), F.lit("").alias("tgt"), F.lit("order").alias("kind"), F.lit(0).alias("nth"), "change").unionByName(e.select(F.lit("edge").alias("what"), "src", "tgt", "kind", "nth", "change"))


def _tree(spark, d) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey > 1").select(key("P-", "p_partkey").alias("src"), F.concat(F.lit("P-"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("tgt"), F.lit("derives").alias("kind"))


@query("G1_reach", "WITH RECURSIVE r AS (SELECT 1::BIGINT AS k, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = k AND p_partkey > 1 WHERE depth < 4) SELECT 'P-' || k AS id, depth FROM r WHERE depth > 0")
def _reach(spark, d):
    return graph.layers(_tree(spark, d), "P-1", max_depth=4, reverse=True)


@query("G3_layers", SQL["G1_reach"])
def _layers(spark, d):
    return graph.layers(_tree(spark, d), "P-1", max_depth=4, reverse=True)


@query("G1_reach_all", "WITH RECURSIVE r AS (SELECT 1::BIGINT AS k, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = k AND p_partkey > 1) SELECT 'P-' || k AS id, depth FROM r WHERE depth > 0")
def _reach_all(spark, d):
    return graph.reach(table(spark, d, "part").select(key("P-", "p_partkey").alias("id")), _tree(spark, d), "P-1", reverse=True)


@query("G2_taint", "WITH RECURSIVE r AS (SELECT 'C-1' AS id UNION SELECT 'O-' || o_orderkey FROM r JOIN orders ON 'C-' || o_custkey = r.id UNION SELECT 'L-' || l_orderkey || '-' || l_linenumber FROM r JOIN lineitem ON 'O-' || l_orderkey = r.id), c AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 1) SELECT DISTINCT 'L-' || l_orderkey || '-' || l_linenumber AS id, o_orderstatus = 'P' AS tainted FROM c JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'O-' || o_orderkey, false FROM c WHERE o_orderstatus <> 'P'")
def _taint(spark, d):
    r = shop(spark, d, open_orders=False)
    return graph.reach(r.nodes, r.edges.filter("kind in ('placed_by', 'of_order')"), "C-1", reverse=True, check_resolved=True).select("id", "tainted")


@query("G5_path", "WITH RECURSIVE w AS (SELECT 13::BIGINT AS k, 'P-13' AS nodes, []::VARCHAR[] AS kinds FROM part WHERE p_partkey = 13 UNION ALL SELECT k // 2, nodes || '>P-' || (k // 2), list_append(kinds, 'derives') FROM w WHERE k > 1) SELECT nodes, array_to_string(kinds, ',') AS kinds FROM w WHERE k = 1")
def _path(spark, d):
    return graph.path(_tree(spark, d), "P-13", "P-1").select(F.array_join("nodes", ">").alias("nodes"), F.array_join("kinds", ",").alias("kinds"))


@query("G5_path_all", "WITH RECURSIVE w AS (SELECT max(p_partkey) AS k, 'P-' || max(p_partkey) AS nodes, '' AS kinds FROM part UNION ALL SELECT k // 2, nodes || '>P-' || (k // 2), kinds || CASE WHEN kinds = '' THEN '' ELSE ',' END || 'derives' FROM w WHERE k > 1) SELECT nodes, kinds FROM w WHERE k = 1")
def _path_all(spark, d):
    last = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return graph.path(_tree(spark, d), f"P-{last}", "P-1").select(F.array_join("nodes", ">").alias("nodes"), F.array_join("kinds", ",").alias("kinds"))


@query("G7_scc", "SELECT 'P-' || lpad(p_partkey::VARCHAR, 9, '0') AS id, 'P-' || lpad(max(p_partkey) OVER (PARTITION BY p_partkey // 4)::VARCHAR, 9, '0') AS component FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part) // 4 * 4 AND p_partkey >= 4")
def _scc(spark, d):
    p = table(spark, d, "part")
    last = F.lit(p.agg(F.max("p_partkey")).first()[0] // 4 * 4)
    p = p.filter((F.col("p_partkey") < last) & (F.col("p_partkey") >= 4)).select(F.col("p_partkey").alias("k"))
    name = lambda c: F.concat(F.lit("P-"), F.lpad(c.cast("string"), 9, "0"))
    ring = F.col("k") - F.pmod("k", F.lit(4)) + F.pmod(F.col("k") + 1, F.lit(4))
    return graph.sccs(p.select(name(F.col("k")).alias("src"), name(ring).alias("tgt")))


@query("G10_deep_coverage", """
WITH RECURSIVE m AS (SELECT max(p_partkey) AS n FROM part), ev AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 3 = 0),
bad AS (SELECT p_partkey AS k FROM part, m WHERE 2 * p_partkey > n AND p_partkey NOT IN (SELECT k FROM ev) UNION SELECT k // 2 FROM bad WHERE k > 1 AND k // 2 NOT IN (SELECT k FROM ev))
SELECT 'P-' || k AS id FROM bad WHERE k IN (SELECT p_partkey FROM part)""")
def _deep(spark, d):
    proof = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_partkey % 3 = 0").select(key("P-", "l_partkey").alias("id"))
    return graph.deep_uncovered(table(spark, d, "part").select(key("P-", "p_partkey").alias("id")), _tree(spark, d), proof)


@query("V14_coverage_deep", """
WITH RECURSIVE m AS (SELECT max(p_partkey) AS n FROM part), ev AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 9 <> 0),
bad AS (SELECT p_partkey AS k FROM part, m WHERE (2 * p_partkey > n OR p_partkey = 0) AND p_partkey NOT IN (SELECT k FROM ev) UNION SELECT k // 2 FROM bad WHERE k > 1 AND k // 2 NOT IN (SELECT k FROM ev)),
kids AS (SELECT k // 2 AS k, string_agg('''P-' || k || '''', ', ' ORDER BY 'P-' || k) AS list FROM bad WHERE k > 1 GROUP BY 1)
SELECT 'COVERAGE_DEEP' AS code, 'P-' || p_partkey AS node_id, 'node ''P-' || p_partkey || ''' (kind ''part'') is not deep-covered: ' || coalesce('uncovered children: ' || list, 'no evidence and no children') AS message FROM part JOIN bad ON bad.k = p_partkey LEFT JOIN kids ON kids.k = p_partkey WHERE p_size >= 10
UNION ALL SELECT 'COVERAGE_UNKNOWN', '', count(*) FILTER (o_orderkey % 9 = 0) || ' of ' || count(*) || ' sources have no tests edge; deep coverage of part is unknown' FROM orders WHERE o_orderstatus = 'F' HAVING count(*) FILTER (o_orderkey % 9 = 0) > 0""")
def _deep_rule(spark, d):
    """Orders test the part of their own number. Part 0 is nobody's parent."""
    r = shop(spark, d)
    tests = edge(table(spark, d, "orders").filter("o_orderkey % 9 <> 0"), key("O-", "o_orderkey"), key("P-", "o_orderkey"), "tests")
    t = _tree(spark, d)
    r = Register(r.nodes.filter("kind in ('part', 'order')"), tests.unionByName(edge(t, F.col("src"), F.col("tgt"), "derives")))
    p = Profile(SHOP.node_kinds, {"tests": [("order", "part")], "derives": [("part", "part")]}, validations=({"code": "COVERAGE_DEEP", "target_kind": "part", "via": "derives", "evidence": "tests", "where": {"size": {"gte": 10}}, "source_where": {"status": {"eq": "F"}}},))
    return rel._union(validate.rule_checks(r, p)).select("code", F.coalesce("node_id", F.lit("")).alias("node_id"), "message")


@query("J8_fuse", "SELECT count(*) FILTER (c_custkey IS NOT NULL) AS resolved, count(*) FILTER (c_custkey IS NULL) AS unresolved FROM events LEFT JOIN customer ON c_custkey = user_id")
def _fuse(spark, d):
    c = table(spark, d, "customer")
    e = table(spark, d, "events")
    users = Register(node(e, F.col("event_id").cast("string"), "event"), edge(e, F.col("event_id").cast("string"), F.col("user_id").cast("string"), "by", order=F.col("event_id")))
    shop_ = Register(node(c, F.col("c_custkey").cast("string"), "customer"), users.edges.filter("false"))
    whole, unresolved = rel.fuse({"events": users, "tpch": shop_}, {"events:by": [("events", "event", "tpch", "customer")]})
    return whole.edges.agg(F.count("*").alias("resolved")).join(unresolved.agg(F.count("*").alias("unresolved")), F.lit(True))


@query("J9_duplicates_across", "SELECT p_partkey::VARCHAR AS id, 2::BIGINT AS n, 'parts,suppliers' AS sources FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def _duplicates(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    none = edge(p.filter("false"), key("", "p_partkey"), key("", "p_partkey"), "x")
    return rel.duplicates_across({"parts": Register(node(p, key("", "p_partkey"), "part"), none), "suppliers": Register(node(s, key("", "s_suppkey"), "supplier"), none)})


@query("J16_suggestions", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS tgt, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
SELECT src, tgt, rank FROM (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rank FROM s WHERE score >= 0) WHERE rank <= 5""")
def _suggest(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("vec"))
    return rel.suggest(v.filter("id % 2 = 0"), v.filter("id % 2 = 1")).select("src", "tgt", "rank")


@query("X3_pathway_demotion", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def _demotion(spark, d):
    r = shop(spark, d)
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, validations=({"code": "COVERAGE", "target_kind": "order", "edge_kind": "of_order"},), pathway_bindings={"COVERAGE": ("priority", "priority")})
    f = validate.demote(rel._union(validate.rule_checks(r, p)).filter("code = 'COVERAGE'"), r, p.pathway_bindings)
    return f.groupBy("severity").agg(F.count("*").alias("n"))


@query("R1_validate", """
SELECT 'COVERAGE' AS code, 'error' AS severity, true AS suppressed, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0
UNION ALL SELECT 'EDGE_CONSTRAINT', 'error', false, count(*) FROM supplier
UNION ALL SELECT 'EMPTY_KIND', 'info', false, 1
UNION ALL SELECT 'UNREFERENCED', 'info', false, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) + (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) + (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) + (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation))
UNION ALL SELECT 'SUPPRESS_UNUSED', 'info', false, 1""")
def _validate(spark, d):
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, validations=({"code": "COVERAGE", "target_kind": "order", "edge_kind": "of_order"},), overrides={"UNREFERENCED": "info"}, suppressions=(("COVERAGE", None), ("ID_FORMAT", None)))
    return validate.validate(shop(spark, d), p, strict=True).groupBy("code", "severity", "suppressed").agg(F.count("*").alias("n"))


_KINDS, _FINDINGS = SQL["A1_counts"], SQL["R1_validate"]


@query("A3_scope", f"SELECT what, kind, n, (n > 0)::BIGINT AS files FROM ({_KINDS})")
def _scope(spark, d):
    return reports.scope(shop(spark, d), SHOP)


@query("R6_describe", f"SELECT what, kind, 'table' AS file, n FROM ({_KINDS}) WHERE n > 0")
def _describe(spark, d):
    return reports.described(shop(spark, d))


@query("J14_schema_counts", """
SELECT 'in_region' AS kind, 'nation' AS src_kind, 'region' AS tgt_kind, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'in_nation', 'customer', 'nation', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'placed_by', 'order', 'customer', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'of_order', 'line', 'order', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'of_part', 'line', 'part', count(*) FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _schema_counts(spark, d):
    return reports.schema_counts(shop(spark, d, open_orders=False), SHOP)


@query("J15_expected_missing", """
SELECT 'N-' || n_nationkey AS id, 'out' AS side, 'in_region' AS kind, 'region' AS far_kind FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey)
UNION ALL SELECT 'R-' || r_regionkey, 'in', 'in_region', 'nation' FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)
UNION ALL SELECT 'C-' || c_custkey, 'out', 'in_nation', 'nation' FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)
UNION ALL SELECT 'N-' || n_nationkey, 'in', 'in_nation', 'customer' FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)
UNION ALL SELECT 'O-' || o_orderkey, 'out', 'placed_by', 'customer' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'C-' || c_custkey, 'in', 'placed_by', 'order' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT DISTINCT 'L-' || l_orderkey || '-' || l_linenumber, 'out', 'of_order', 'order' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'O-' || o_orderkey, 'in', 'of_order', 'line' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT DISTINCT 'L-' || l_orderkey || '-' || l_linenumber, 'out', 'of_part', 'part' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'P-' || p_partkey, 'in', 'of_part', 'line' FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)""")
def _expected_missing(spark, d):
    return reports.expected_missing(shop(spark, d), SHOP)


def _suppliers_off(spark, d) -> tuple[Register, DataFrame]:
    r = shop(spark, d)
    return r, rel._union(validate.edge_checks(r, SHOP)).filter("code = 'EDGE_CONSTRAINT'").withColumn("suppressed", F.lit(False))


@query("A9_structural_summary", f"SELECT what, kind, NULL::VARCHAR AS severity, n FROM ({_KINDS}) UNION ALL SELECT 'finding', 'EDGE_CONSTRAINT', 'error', count(*) FROM supplier")
def _summary(spark, d):
    r, f = _suppliers_off(spark, d)
    return reports.summary(r, SHOP, f)


@query("A10_by_severity", "SELECT 'error' AS severity, count(*) AS n FROM supplier UNION ALL SELECT unnest(['warning', 'info', 'hint']), 0::BIGINT")
def _by_severity(spark, d):
    return reports.by_severity(_suppliers_off(spark, d)[1])


@query("A11_worst", f"""
WITH f AS (SELECT 'O-' || o_orderkey AS id, 0 AS r FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT node_id, 1 FROM ({SQL["V10_V11_referenced"]}))
SELECT id, CASE min(r) WHEN 0 THEN 'error' ELSE 'warning' END AS worst, count(*) AS n FROM f GROUP BY id""")
def _worst(spark, d):
    r = shop(spark, d)
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, validations=({"code": "CONSTRAINT", "node_kind": "order", "reject": {"status": {"eq": "P"}}, "severity": "error"},))
    return reports.worst(rel._union([*validate.rule_checks(r, p), *validate.node_checks(r, p)]).filter("code in ('CONSTRAINT', 'UNREFERENCED', 'UNTRACED')"))


@query("R2_trace", """
SELECT 'O-' || o_orderkey AS id, 'outgoing' AS part, 'placed_by' AS what, 'C-' || o_custkey AS far FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'C-' || c_custkey, 'incoming', 'placed_by', 'O-' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'S-' || s_suppkey, 'finding', 'EDGE_CONSTRAINT', 'error' FROM supplier""")
def _trace(spark, d):
    _, f = _suppliers_off(spark, d)
    r = shop(spark, d, open_orders=False)
    return reports.trace(Register(r.nodes, r.edges.filter("kind = 'placed_by'")), f)[0].select("id", "part", "what", "far")


@query("P19_at", "SELECT event_id::VARCHAR AS id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id::VARCHAR FROM events WHERE event_type = 'click' AND user_id % 3 = 1")
def _at(spark, d):
    e = table(spark, d, "events")
    n = e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("log/"), "event_type", F.lit("/"), (F.col("user_id") % 3).cast("string")).alias("file"))
    return reports.at(n, "log/view").union(reports.at(n, "./log/click/1")).select("id")


@query("P16_absent_attrs", "SELECT attr FROM (SELECT 'status' AS attr, (SELECT count(o_orderstatus) FROM orders) AS n UNION ALL SELECT 'nosuch', 0 UNION ALL SELECT 'brand', (SELECT count(p_brand) FROM part)) WHERE n = 0")
def _absent(spark, d):
    return reports.absent_attrs(shop(spark, d).nodes, ["status", "nosuch", "brand"])


@query("P20_summaries", "SELECT 'P-' || p_partkey AS id, p_brand AS summary FROM part UNION ALL SELECT 'S-' || s_suppkey, '' FROM supplier")
def _summaries(spark, d):
    p = Profile({"part": NodeKind(summary="brand"), "supplier": NodeKind()}, {})
    return reports.summaries(shop(spark, d).nodes.filter("kind in ('part', 'supplier')"), p).select("id", "summary")


def _rings(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts in rings of four, and every second ring linked to the next; part 0 to 3 and the last, unfilled ring stay single."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    last = F.lit(p.agg(F.max("k")).first()[0] // 4 * 4)
    name = lambda c: F.concat(F.lit("P-"), F.lpad(c.cast("string"), 9, "0"))
    full = p.filter((F.col("k") >= 4) & (F.col("k") < last))
    ring = full.select(name(F.col("k")).alias("src"), name(F.col("k") - F.pmod("k", F.lit(4)) + F.pmod(F.col("k") + 1, F.lit(4))).alias("tgt"))
    link = full.filter((F.col("k") % 8 == 0) & (F.col("k") + 4 < last)).select(name(F.col("k")).alias("src"), name(F.col("k") + 4).alias("tgt"))
    return p.select(name(F.col("k")).alias("id")), ring.union(link)


_RINGS = "WITH p AS (SELECT p_partkey AS k, (SELECT max(p_partkey) FROM part) // 4 * 4 AS z FROM part), o AS (SELECT k, CASE WHEN k >= 4 AND k < z THEN k // 4 * 4 + 3 ELSE k END AS c, z FROM p)"


@query("G8_components", _RINGS + " SELECT 'P-' || lpad(c::VARCHAR, 9, '0') AS component, count(*) AS size, count(*) > 1 AS cyclic, false AS self_loop FROM o GROUP BY c")
def _components(spark, d):
    return reports.components(*_rings(spark, d))[0]


@query("G8_component_links", _RINGS + " SELECT 'P-' || lpad((k + 3)::VARCHAR, 9, '0') AS src, 'P-' || lpad((k + 7)::VARCHAR, 9, '0') AS tgt, 1::BIGINT AS n FROM o WHERE k % 8 = 0 AND k >= 4 AND k + 4 < z")
def _component_links(spark, d):
    return reports.components(*_rings(spark, d))[1]


@query("G19_topological", "SELECT 'P-' || p_partkey AS id, (length(bin((SELECT max(p_partkey) FROM part) // p_partkey)) - 1)::INTEGER AS layer FROM part WHERE p_partkey > 0")
def _topological(spark, d):
    return graph.topological(_tree(spark, d))


@query("J12_V23_notes", """
SELECT 'EDGE_CONSTRAINT' AS code, 'S-' || s_suppkey AS node_id, CASE WHEN s_suppkey % 10 = 0 THEN 'known' END AS note, CASE WHEN s_suppkey % 10 = 0 THEN (s_suppkey % 20 = 0)::VARCHAR END AS expired FROM supplier
UNION ALL SELECT 'NOTE_EXPIRED', 'S-' || s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 20 = 0 UNION ALL SELECT 'NOTE_UNUSED', 'S-' || s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 1""")
def _notes(spark, d):
    s = table(spark, d, "supplier").filter("s_suppkey % 10 < 2")
    code = F.when(F.col("s_suppkey") % 10 == 0, "EDGE_CONSTRAINT").otherwise("VACANCY")
    until = F.when(F.col("s_suppkey") % 20 == 0, F.lit("2023-12-31")).otherwise(F.lit("2024-01-01")).cast("date")
    notes = s.select(code.alias("code"), key("S-", "s_suppkey").alias("node_id"), F.lit("known").alias("text"), until.alias("until"))
    f, more = reports.attach_notes(_suppliers_off(spark, d)[1], notes, F.lit("2024-01-01").cast("date"))
    return f.select("code", "node_id", "note", F.col("expired").cast("string").alias("expired")).unionByName(more.select("code", "node_id"), allowMissingColumns=True)


@query("V20_V22_stale_config", "WITH f AS (SELECT DISTINCT 'EDGE_CONSTRAINT' AS code FROM supplier), b AS (SELECT unnest(['EDGE_CONSTRAINT', 'VACANCY']) AS code) SELECT 'warning' AS severity, 'PATHWAY_UNRESOLVED' AS code, 'no pathway gone' AS message FROM b JOIN f USING (code) UNION ALL SELECT 'info', 'OVERRIDE_UNUSED', 'nothing has the code ' || c FROM (SELECT 'NOT_SHIPPED' AS c) WHERE c NOT IN (SELECT code FROM f)")
def _stale(spark, d):
    r, f = _suppliers_off(spark, d)
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, overrides={"NOT_SHIPPED": "info", "COVERAGE": "error"}, pathway_bindings={"EDGE_CONSTRAINT": ("gone", "status"), "VACANCY": ("gone", "status"), "COVERAGE": ("priority", "priority")})
    return reports.stale_config(f, r, p, set(validate.SEVERITY))


@query("V24_suggested_edges", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'SUGGESTION_UNRESOLVED' ELSE 'SUGGESTED_EDGE' END AS code, 'O-' || o_orderkey AS node_id, 'placed_by to C-' || o_custkey || ', score ' || printf('%.4f', (o_orderkey % 1000) / 1000.0) AS message FROM orders")
def _suggested(spark, d):
    s = table(spark, d, "orders").select(key("O-", "o_orderkey").alias("src"), key("C-", "o_custkey").alias("tgt"), F.lit("placed_by").alias("kind"), ((F.col("o_orderkey") % 1000) / 1000.0).alias("score"))
    return reports.suggestion_findings(shop(spark, d, open_orders=False), s).select("code", "node_id", "message")
