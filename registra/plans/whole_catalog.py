"""Queries of profiles read from text, the whole validation pipeline, fusing, walks, ranking and reports, and the same in SQL."""

from __future__ import annotations

import dataclasses
import json
import os
import uuid
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.predicates import condition
from ..model import NodeKind, Profile, Register, attrs, edge, literal, node
from ..operators import graph, ranking, reports, walks
from ..operators import relations as rel
from ..shared import shared_folder
from ..sinks import render
from ..sources import profiles, trace
from . import fuse, service, validate
from .catalog import SHOP, SQL, _tree, key, query, shop, table

#: A profile as it stands in a file: a parent's kinds, and a child that adds rules.
PARENT = """
name: shop
profile_version: "1.0.0"
node_kinds:
  customer:
    id_pattern: 'C-\\d+'
    attrs: {segment: {type: enum, values: [BUILDING, "AUTO\\"MOBILE", MACHINERY]}}
  order:
    id_pattern: 'O-\\d+'
    orphan_ok: true
    attrs: {status: string, priority: string, cust: int}
  ghost: {id_pattern: '.*'}
edge_kinds:
  placed_by: {allowed: [[order, customer]]}
validations:
  - UNREFERENCED: {severity: info, message: "{kind} {id} of {attrs.segment} ({attrs.none}): {message} {{{severity}}}"}
  - SUGGESTED_EDGE: {severity: error}
"""
CHILD = """
profile_version: "1.2.0"
extends: parent.yaml
annotations: notes.yaml
pathways: {priority: {}, gone: {}}
validations:
  - UNREFERENCED: {severity: info, message: "{kind} {id} of {attrs.segment} ({attrs.none}): {message} {{{severity}}}"}
  - SUGGESTED_EDGE: {severity: error}
  - CONSTRAINT: {kind: order, reject: {status: P}, severity: error, message: "{id} is open"}
  - CONSTRAINT: {kind: order, expect: {cust: {lt: 100}}, pathway: priority, position_attr: priority}
  - EDGE_COUNT: {node_kind: customer, edge_kind: placed_by, direction: in, max: 12, pathway: gone, position_attr: segment}
  - NOT_SHIPPED: {severity: error}
  - SUPPRESS: {code: ATTR_ENUM}
  - SUPPRESS: {code: ID_FORMAT}
"""


def _folder(spark, **texts: str) -> str:
    """A folder on the driver with the given files: profiles and notes are read there."""
    base = shared_folder(spark).removeprefix("file://")
    path = os.path.join(base, f"profile-{uuid.uuid4().hex}")
    os.makedirs(path)
    for name, text in texts.items():
        with open(os.path.join(path, f"{name}.yaml"), "w", encoding="utf-8") as f:
            f.write(text)
    return path


def _loaded(spark, notes: list | None = None) -> Profile:
    texts = {"parent": PARENT, "child": CHILD} | ({} if notes is None else {"notes": json.dumps(notes, indent=1)})
    return profiles.load(os.path.join(_folder(spark, **texts), "child.yaml"))


def _orders(spark, d) -> Register:
    r = shop(spark, d)
    return Register(r.nodes.filter("kind in ('customer', 'order')"), r.edges.filter("kind = 'placed_by'"), r.pathways)


_LOADED = """
SELECT 'UNREFERENCED' AS code, 'info' AS severity, false AS suppressed, 'C-' || c_custkey AS node_id, 'customer C-' || c_custkey || ' of ' || c_mktsegment || ' (<absent>): nothing refers to it {info}' AS message FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'ATTR_ENUM', 'error', true, 'C-' || c_custkey, NULL FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'CONSTRAINT', 'error', false, 'O-' || o_orderkey, 'O-' || o_orderkey || ' is open' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'CONSTRAINT', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'error' ELSE 'info' END, false, 'O-' || o_orderkey, NULL FROM orders WHERE o_custkey >= 100
UNION ALL SELECT 'EDGE_COUNT', 'error', false, 'C-' || o_custkey, NULL FROM orders GROUP BY o_custkey HAVING count(*) > 12
UNION ALL SELECT 'EMPTY_KIND', 'info', false, NULL, NULL UNION ALL SELECT 'SUPPRESS_UNUSED', 'info', false, NULL, NULL UNION ALL SELECT 'OVERRIDE_UNUSED', 'info', false, NULL, NULL UNION ALL SELECT 'CONFIG_ERROR', 'error', false, NULL, NULL
UNION ALL SELECT 'NOTE_FILE_MISSING', 'error', false, NULL, NULL UNION ALL SELECT 'PATHWAY_UNRESOLVED', 'error', false, NULL, NULL WHERE EXISTS (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 12)"""


@query("S39_profile_validate", f"SELECT code, CASE WHEN code = 'CONSTRAINT' AND message LIKE '%open' AND o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'info' ELSE severity END AS severity, suppressed, node_id, message FROM ({_LOADED}) f LEFT JOIN orders o ON 'O-' || o.o_orderkey = f.node_id")
def _profile_validate(spark, d):
    """The whole pipeline by a profile with a parent, strict. A constraint's code is bound to a pathway, so late orders' findings become info whatever their entry says."""
    f = validate.validate(_orders(spark, d), _loaded(spark), strict=True, today="2024-01-01")
    own = F.col("code").isin("UNREFERENCED") | F.col("message").endswith(" is open")
    return f.select("code", "severity", "suppressed", "node_id", F.when(own, F.col("message")).alias("message"))


@query("S40_notes_file", """
SELECT 'CONSTRAINT' AS code, 'O-' || o_orderkey AS node_id, CASE WHEN o_orderkey IN (1, 2) THEN 'known' END AS note, CASE WHEN o_orderkey IN (1, 2) THEN (o_orderkey = 1)::VARCHAR END AS expired FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'NOTE_EXPIRED', NULL, NULL, NULL FROM orders WHERE o_orderkey = 1 AND o_orderstatus = 'F' UNION ALL SELECT 'NOTE_UNUSED', NULL, NULL, NULL FROM orders WHERE o_orderkey IN (1, 2) AND o_orderstatus <> 'F'
UNION ALL SELECT 'NOTE_UNUSED', NULL, NULL, NULL UNION ALL SELECT unnest(['NOTE_INVALID', 'NOTE_INVALID', 'NOTE_INVALID', 'NOTE_INVALID']), NULL, NULL, NULL""")
def _notes_file(spark, d):
    of = lambda n, **more: {"finding": {"code": "CONSTRAINT", "node": n}, "note": "known", **more}
    notes = [of("O-1", until="2023-12-31"), of("O-2", until={"pathway": "priority", "position": "5-LOW"}), of("O-none", by="x", at="2023-01-01"), of("O-1"), of("O-7", until="soon"), of("O-7", until={"pathway": "none", "position": "x"}), {"note": "x"}]
    p = _loaded(spark, notes)
    p = dataclasses.replace(p, validations=({"code": "CONSTRAINT", "node_kind": "order", "reject": {"status": {"eq": "F"}}},), overrides={}, suppressions=(), pathway_bindings={}, templates={})
    f = validate.validate(_orders(spark, d), p, today="2024-01-01").filter("code in ('CONSTRAINT') or code like 'NOTE%'")
    return f.select("code", "node_id", F.col("note.text").alias("note"), F.col("note.expired").cast("string").alias("expired"))


@query("X1_severity_precedence", "SELECT 'O-' || o_orderkey AS node_id, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'info' END AS severity FROM orders")
def _precedence(spark, d):
    """An entry's own severity against the override of its code."""
    rules = ({"code": "CONSTRAINT", "node_kind": "order", "reject": {"status": {"eq": "F"}}, "severity": "error"}, {"code": "CONSTRAINT", "node_kind": "order", "expect": {"status": {"eq": "F"}}})
    p = Profile(SHOP.node_kinds, SHOP.edge_kinds, validations=rules, overrides={"CONSTRAINT": "info"})
    f = validate.finish(rel._union(validate.rule_checks(shop(spark, d, line_nodes=False), p)), shop(spark, d, line_nodes=False), p)
    return f.select("node_id", "severity")


@query("V9_list_items", "SELECT 'P-' || p_partkey AS node_id, CASE WHEN p_partkey % 3 = 0 THEN 'xs[1]' ELSE 'xs[2]' END AS place FROM part WHERE p_partkey % 3 < 2")
def _list_items(spark, d):
    x = F.when(F.col("p_partkey") % 3 == 0, F.lit('[1,"2",3]')).when(F.col("p_partkey") % 3 == 1, F.lit("[1,2,true]")).otherwise(F.lit("[1,2,3]"))
    n = node(table(spark, d, "part"), key("P-", "p_partkey"), "part", attrs(xs=x))
    p = Profile({"part": NodeKind("P-[0-9]+", {"xs": {"type": "list", "items": "int"}}, orphan_ok=True)}, {"x": [("part", "part")]})
    return rel._union(validate.node_checks(Register(n, shop(spark, d).edges.filter("false")), p)).select("node_id", F.regexp_extract("message", r"xs\[\d+\]", 0).alias("place"))


@query("V1_id_format", "SELECT 'ID_FORMAT' AS code, 'P-' || p_partkey AS node_id FROM part WHERE length(p_partkey::VARCHAR) <> 2 UNION ALL SELECT 'UNKNOWN_KIND', 'S-' || s_suppkey FROM supplier")
def _id_format(spark, d):
    r = shop(spark, d)
    p = Profile({"part": NodeKind(r"P-\d\d", orphan_ok=True)}, {"x": [("part", "part")]})
    return rel._union(validate.node_checks(Register(r.nodes.filter("kind in ('part', 'supplier')"), r.edges.filter("false")), p)).select("code", "node_id")


@query("V11_untraced", "SELECT 'O-' || o_orderkey AS node_id FROM orders WHERE o_orderkey % 5 = 0")
def _untraced(spark, d):
    """Orders whose edge to a customer is left out."""
    r = _orders(spark, d)
    r = Register(r.nodes, r.edges.filter("cast(substring(src, 3) as bigint) % 5 <> 0"))
    return rel._union(validate.node_checks(r, Profile(SHOP.node_kinds, {"placed_by": [("order", "customer")]}))).filter("code = 'UNTRACED'").select("node_id")


@query("V5_vacancy_ends", """
SELECT 'src' AS part, 'hint' AS severity, count(*) AS n FROM orders WHERE false HAVING count(*) > 0
UNION ALL SELECT 'tgt', 'hint', count(*) FROM orders WHERE o_custkey % 4 = 0 UNION ALL SELECT 'src', 'error', count(*) FROM orders WHERE o_orderstatus = 'P'""")
def _vacancy_ends(spark, d):
    """Open orders and every fourth customer aren't declared; the kind may cross sources, so a missing target is a hint and a missing source an error."""
    r = _orders(spark, d)
    n = r.nodes.filter(~condition("status", "eq", "P") & ~((F.col("kind") == "customer") & F.expr("cast(substring(id, 3) as bigint) % 4 = 0")))
    f = rel._union(validate.edge_checks(Register(n, r.edges), Profile(SHOP.node_kinds, {"placed_by": [("order", "customer")]}, cross_source=frozenset(["placed_by"])))).filter("code = 'VACANCY'")
    return f.groupBy(F.substring("message", 1, 3).alias("part"), "severity").agg(F.count("*").alias("n"))


@query("J4_orphans", "SELECT 'P-' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 20) UNION ALL SELECT 'C-' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _orphans_all(spark, d):
    """Parts without a small line, and customers without an open order."""
    o, l = table(spark, d, "orders").filter("o_orderstatus = 'P'"), table(spark, d, "lineitem").filter("l_quantity < 20")  # noqa: E741
    n = shop(spark, d).nodes.filter("kind in ('part', 'customer')")
    e = edge(o, key("O-", "o_orderkey"), key("C-", "o_custkey"), "placed_by").unionByName(edge(l, key("L-", "l_orderkey", "l_linenumber"), key("P-", "l_partkey"), "of_part"))
    return rel.orphans(Register(n, e)).select("id")


@query("P16_absent_attrs_counted", "SELECT attr FROM (SELECT 'status' AS attr, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'size', (SELECT count(*) FROM part WHERE p_size > 1000) UNION ALL SELECT 'segment', (SELECT count(*) FROM customer)) WHERE n = 0")
def _absent_counted(spark, d):
    n = shop(spark, d, line_nodes=False).nodes.filter("kind <> 'part'").unionByName(node(table(spark, d, "part").filter("p_size > 1000"), key("P-", "p_partkey"), "part", attrs(size=literal(F.col("p_size"), "int"))))
    return reports.absent_attrs(n, ["status", "size", "segment"])


@query("P11_first_failing", "SELECT 'P-' || p_partkey AS id, CASE WHEN p_size < 10 THEN 'size gte 10' WHEN p_brand <> 'Brand#11' THEN 'brand eq \"Brand#11\"' END AS why FROM part")
def _first_failing(spark, d):
    from ..functions.predicates import first_failing, parse_block

    block = parse_block({"size": {"gte": 10}, "brand": "Brand#11"})
    return shop(spark, d).nodes.filter("kind = 'part'").select("id", first_failing(block).alias("why"))


@query("A8_rollup_totals", "SELECT o_orderpriority AS grp, o_orderstatus AS status, count(*) AS n, false AS is_total FROM orders GROUP BY 1, 2 UNION ALL SELECT NULL, o_orderstatus, count(*), true FROM orders GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*), true FROM orders")
def _totals(spark, d):
    return service.rollup_with_totals(shop(spark, d, line_nodes=False), "order", "status", "priority").filter("n > 0")


@query("P21_unknown_values", "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 7 = 0 THEN 'null' ELSE p_size::VARCHAR END AS status, count(*) AS n FROM part GROUP BY 1")
def _unknown_values(spark, d):
    from .catalog import _flawed_parts

    g = rel.rollup_long(Register(_flawed_parts(spark, d), shop(spark, d).edges.filter("false")), "part", "size", "brand")
    return g.groupBy("status").agg(F.sum("n").alias("n"))


@query("G6_traverse", """
WITH RECURSIVE w AS (SELECT 1::BIGINT AS k, 0 AS depth, '' AS way UNION ALL SELECT p_partkey, depth + 1, way || '/' || 'P-' || p_partkey FROM w JOIN part ON p_partkey // 2 = k AND p_partkey > 1)
SELECT row_number() OVER (ORDER BY way) - 1 AS step, depth, 'P-' || k AS id, 'first' AS visit FROM w""")
def _traverse(spark, d):
    n = table(spark, d, "part").select(key("P-", "p_partkey").alias("id"))
    e = _tree(spark, d).withColumn("ord", F.lit(0))
    return walks.traverse(Register(n, e), "P-1", reverse=True).select("step", "depth", "id", "visit")


@query("G6_traverse_visits", "SELECT visit, count(*) AS n FROM (SELECT unnest(CASE WHEN p_partkey % 4 = 3 THEN ['first', 'cycle', 'reconvergence'] ELSE ['first'] END) AS visit FROM part WHERE p_partkey >= 4 AND p_partkey < (SELECT max(p_partkey) FROM part) // 4 * 4) GROUP BY visit UNION ALL SELECT 'first', 1 WHERE false")
def _visits(spark, d):
    """Rings of four parts, entered from a root at their first parts: each ends with a step back, and a second way to the last part meets it again."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    last = F.lit(p.agg(F.max("k")).first()[0] // 4 * 4)
    p = p.filter((F.col("k") >= 4) & (F.col("k") < last))
    name = lambda c: F.concat(F.lit("P-"), c.cast("string"))
    ring = p.select(name(F.col("k")).alias("src"), name(F.col("k") - F.pmod("k", F.lit(4)) + F.pmod(F.col("k") + 1, F.lit(4))).alias("tgt"))
    root = p.filter("k % 4 = 0").select(F.lit("root").alias("src"), name(F.col("k")).alias("tgt"))
    again = p.filter("k % 4 = 0").select(F.lit("zoot").alias("src"), name(F.col("k") + 3).alias("tgt"))
    e = ring.union(root).union(again).unionByName(spark.createDataFrame([("root", "zoot")], "src string, tgt string")).select("src", "tgt", F.lit("e").alias("kind"), F.lit(0).alias("ord"))
    n = e.select(F.col("src").alias("id")).distinct()
    steps = walks.traverse(Register(n, e), "root").filter("id not in ('root', 'zoot')")
    return steps.groupBy("visit").agg(F.count("*").alias("n"))


@query("G9_betweenness", """
WITH RECURSIVE up AS (SELECT p_partkey AS s, p_partkey AS v, 0 AS dist FROM part WHERE p_partkey BETWEEN 1 AND 255 UNION ALL SELECT s, v // 2, dist + 1 FROM up WHERE v > 1),
c AS (SELECT v, (SELECT count(*) FROM up u WHERE u.v = p.p_partkey AND dist > 0) * (floor(log2(p.p_partkey))) AS b, p.p_partkey FROM part p JOIN (SELECT DISTINCT v FROM up) t ON t.v = p.p_partkey)
SELECT 'P-' || p_partkey AS id, round(b / (SELECT max(b) FROM c), 6) AS score FROM c""")
def _betweenness(spark, d):
    """The tree's upper 255 parts, each linked to its parent: a part lies between all below it and all above it."""
    few = table(spark, d, "part").filter("p_partkey between 1 and 255")
    e = _tree(spark, d).join(few.select(key("P-", "p_partkey").alias("src")), "src", "left_semi").filter("tgt <> 'P-0'")
    return walks.betweenness(few.select(key("P-", "p_partkey").alias("id")), e).select("id", F.round("score", 6).alias("score"))


@query("G16_layers", "WITH p AS (SELECT p_partkey AS k, (SELECT max(p_partkey) FROM part) // 4 * 4 AS z FROM part) SELECT 'P-' || lpad(k::VARCHAR, 9, '0') AS id, CASE WHEN k >= 8 AND k < z AND (k // 4) % 2 = 1 THEN 1 WHEN k >= 4 AND k < 8 AND k < z THEN 1 ELSE 0 END - CASE WHEN k BETWEEN 4 AND 7 THEN 1 ELSE 0 END AS layer FROM p")
def _layers(spark, d):
    from .catalog import _rings

    ids, e = _rings(spark, d)
    return walks.component_order(ids, e).select("id", "layer")


@query("G17_refusals", "SELECT 'unknown edge kind ''a_kind''' AS refusal UNION ALL SELECT 'unknown node ''O-none''' UNION ALL SELECT 'unknown kind ''thing''; declared: region, nation, customer, supplier, part, order, line, ghost' UNION ALL SELECT 'the register could not be read; its errors say why'")
def _refusals(spark, d):
    r = shop(spark, d, line_nodes=False)
    v = service.View(r, SHOP)
    off = Register(r.nodes.filter("false"), r.edges.filter("false"), {}, spark.createDataFrame([("error", "PARSE_ERROR", "x", None, "f", 1)], "severity string, code string, message string, node_id string, file string, line long"))
    out = []
    for view, request, arguments in ((v, "reach", {"origin": "C-1", "edge_kinds": ["z_kind", "a_kind"]}), (v, "path", {"src": "O-none", "tgt": "C-1", "kinds": []}), (v, "orphans", {"kind": "thing"}), (service.View(off, SHOP), "counts", {})):
        try:
            service.execute(view, request, **arguments)
        except walks.QueryError as e:
            out.append((str(e),))
    return spark.createDataFrame(out, "refusal string")


@query("R3_at", "SELECT 'entry' AS part, event_id::VARCHAR AS id FROM events WHERE event_type = 'click' UNION ALL SELECT 'finding', event_id::VARCHAR FROM events WHERE event_type = 'click' AND user_id % 2 = 0")
def _at(spark, d):
    e = table(spark, d, "events")
    n = e.select(F.col("event_id").cast("string").alias("id"), F.lit("event").alias("kind"), attrs(user=literal(F.col("user_id") % 2, "int")).alias("attrs"), F.concat(F.lit("log/"), "event_type", F.lit(".md")).alias("file"), F.lit(1).cast("long").alias("line"), F.col("event_id").alias("ord"))
    p = Profile({"event": NodeKind(orphan_ok=True)}, {"e": [("event", "event")]}, validations=({"code": "CONSTRAINT", "node_kind": "event", "reject": {"user": {"eq": 0}}},))
    none = edge(e.filter("false"), F.col("event_type"), F.col("event_type"), "e")
    r = service.execute(service.View(Register(n, none), p), "at", target="/repo/log/..", path="x/../log/click.md").payload
    return r["entries"].select(F.lit("entry").alias("part"), "id").unionByName(r["findings"].select(F.lit("finding").alias("part"), F.col("node_id").alias("id")))


@query("R4_pathway_diff", "SELECT unnest(['gone', 'moved', 'new']) AS name, unnest(['removed', 'changed', 'added']) AS change, unnest(['[a]', '[a] b', NULL]) AS before, unnest([NULL, 'a [b]', 'a [c]']) AS after WHERE EXISTS (SELECT 1 FROM region)")
def _pathway_diff(spark, d):
    r = shop(spark, d, line_nodes=False)
    a = Register(r.nodes, r.edges, {"same": (["x"], "x"), "gone": (["a"], "a"), "moved": (["a", "b"], "a")})
    b = Register(r.nodes, r.edges, {"same": (["x"], "x"), "moved": (["a", "b"], "b"), "new": (["a", "c"], "c")})
    return service.pathway_diff(a, b)


@query("F8_chunks", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n(?:the|The) ', chr(10) || chr(1), 'g'), chr(1))) AS part FROM documents) WHERE regexp_replace(part, '\\s+', '', 'g') <> '' GROUP BY 1")
def _chunks(spark, d):
    """Parts of texts before lines that start with a word; each text is the parts joined."""
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\n(?:the|The) ", "\nthe ").alias("text"))
    parts = ranking.chunks_of(F.col("text"), "the ")
    return t.filter("text is not null and regexp_replace(text, '\\\\s+', '') <> ''").select("doc_id", F.size(parts).cast("long").alias("n"))


@query("A15_ranking", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id // 2 * 2 + 1 AS tgt, max(round(list_cosine_similarity(a.e, b.e), 6)) AS score FROM v a JOIN v b ON a.vec_id % 4 = 0 AND b.vec_id % 4 IN (1, 2, 3) AND b.vec_id // 4 * 4 <> -1 AND a.label <> b.label GROUP BY ALL)
SELECT 's' || src AS src, 't' || tgt AS tgt, rank FROM (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY score DESC, 't' || tgt) AS rank FROM s) WHERE rank <= 3""")
def _ranking(spark, d):
    """Vectors in fours: the first is a source, the others chunks of two targets; a pair of kinds is allowed if the labels differ."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    s = v.filter("vec_id % 4 = 0").select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("s"), "label").alias("kind"), "vec")
    t = v.filter("vec_id % 4 > 0").select(F.concat(F.lit("t"), (F.floor(F.col("vec_id") / 2) * 2 + 1).cast("string")).alias("id"), F.concat(F.lit("t"), "label").alias("kind"), "vec")
    labels = sorted(r[0] for r in v.select("label").distinct().collect())
    p = Profile({}, {"near": [(f"s{a}", f"t{b}") for a in labels for b in labels if a != b]})
    return ranking.rank(s, t, p, "near", 3).select("src", "tgt", "rank")


@query("A17_candidates", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipmode FROM (SELECT *, 'x' AS l_shipmode FROM lineitem))
SELECT 'P-' || p_partkey AS id, p_brand || ' ' || chr(10) || p_name || ' ' || chr(10) || p_brand || ' ' || chr(10) || p_name AS text FROM part WHERE p_partkey % 3 = 0""")
def _candidates(spark, d):
    """Parts are declared twice; two thirds of them have an edge already."""
    p = table(spark, d, "part")
    one = lambda at: node(p, key("P-", "p_partkey"), "part", attrs(brand=literal(F.col("p_brand"), "string"), name=literal(F.col("p_name"), "string"), blank=F.lit('" "')), order=F.lit(at))
    e = edge(p.filter("p_partkey % 3 > 0"), key("P-", "p_partkey"), F.lit("x"), "near")
    prof = Profile({"part": NodeKind(texts=("brand", "blank", "name"))}, {"near": [("part", "part")]})
    return ranking.candidates(one(0).unionByName(one(1)), e, prof, "near")[0].select("id", "text")


@query("A16_unranked", "SELECT count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 10 <> 0")
def _unranked(spark, d):
    v = table(spark, d, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("id"))
    return ranking.unranked(v.union(v), v.filter("cast(id as bigint) % 10 = 0").select(F.col("id").alias("src")))


@query("S43_suggestions_document", "SELECT 'O-' || o_orderkey AS src, 'C-' || o_custkey AS tgt, 'placed_by' AS kind, 0.5::DOUBLE AS score FROM orders")
def _suggestions(spark, d):
    """Documents of one priority and 10,000 order keys: people review them, so none is longer, however many orders there are."""
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.floor(F.col("o_orderkey") / 10_000)).agg(F.collect_list(F.struct(key("O-", "o_orderkey").alias("src"), key("C-", "o_custkey").alias("tgt"), F.lit("placed_by").alias("kind"), F.lit(0.5).alias("score"))).alias("suggestions"))
    docs = o.select(F.to_json(F.struct(F.lit("1.1").alias("version"), "suggestions")).alias("text"))
    return ranking.read_suggestions(docs).select("src", "tgt", "kind", "score")


def _sources(spark, d):
    """Two registers: customers and their orders, and users' events, whose edges name customers by number. Every tenth customer is known to both."""
    c, o, e = (table(spark, d, t) for t in ("customer", "orders", "events"))
    a = Register(node(c, F.col("c_custkey").cast("string"), "customer").unionByName(node(o, key("O-", "o_orderkey"), "order")), edge(o, key("O-", "o_orderkey"), F.col("o_custkey").cast("string"), "placed_by"))
    n = node(e, key("E-", "event_id"), "event").unionByName(node(c.filter("c_custkey % 10 = 0"), F.col("c_custkey").cast("string"), "user"))
    b = Register(n, edge(e, key("E-", "event_id"), F.col("user_id").cast("string"), "by"))
    pa = Profile({"customer": NodeKind("[0-9]+"), "order": NodeKind("O-[0-9]+")}, {"placed_by": [("order", "customer")]})
    pb = Profile({"event": NodeKind("E-[0-9]+"), "user": NodeKind("[0-9]+", orphan_ok=True)}, {"by": [("event", "user")]})
    f = fuse.FuseProfile({"by": [("log:event", "shop:customer"), ("log:event", "log:user")]}, ({"code": "COVERAGE", "target_kind": "shop:customer", "edge_kind": "by"},))
    return {"shop": (a, pa), "log": (b, pb)}, f


@query("R7_fuse_edges", """
SELECT 'shop:O-' || o_orderkey AS src, 'shop:' || o_custkey AS tgt, 'placed_by' AS kind, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
UNION ALL SELECT 'log:E-' || event_id, 'shop:' || user_id, 'by', count(*) FROM events JOIN customer ON c_custkey = user_id WHERE user_id % 10 <> 0 GROUP BY ALL""")
def _fuse_edges(spark, d):
    s, f = _sources(spark, d)
    r, _ = fuse.fuse(s, f)
    return r.edges.groupBy("src", "tgt", "kind").agg(F.count("*").alias("n"))


@query("R7_fuse_findings", """
WITH c AS (SELECT c_custkey AS k FROM customer), hit AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id % 10 <> 0)
SELECT 'CROSS_SOURCE_DUPLICATE_ID' AS code, NULL AS source, NULL AS node_id, count(*) AS n FROM c WHERE k % 10 = 0 HAVING count(*) > 0
UNION ALL SELECT 'AMBIGUOUS_CROSS_REF', 'log', 'log:E-' || event_id, count(*) FROM events JOIN c ON k = user_id WHERE user_id % 10 = 0 GROUP BY event_id
UNION ALL SELECT 'VACANCY', 'log', 'log:E-' || event_id, count(*) FROM events LEFT JOIN c ON k = user_id WHERE k IS NULL GROUP BY event_id
UNION ALL SELECT 'COVERAGE', 'shop', 'shop:' || k, 1 FROM c WHERE k NOT IN (SELECT k FROM hit)
UNION ALL SELECT 'COVERAGE_UNKNOWN', NULL, NULL, 1 FROM (SELECT count(*) AS n FROM events WHERE user_id % 10 = 0 OR user_id NOT IN (SELECT k FROM c)) WHERE n > 0
UNION ALL SELECT 'UNREFERENCED', 'shop', 'shop:' || k, 1 FROM c WHERE k NOT IN (SELECT k FROM hit) AND k NOT IN (SELECT o_custkey FROM orders)""")
def _fuse_findings(spark, d):
    s, f = _sources(spark, d)
    return fuse.fuse(s, f)[1].groupBy("code", "source", "node_id").agg(F.count("*").alias("n"))


@query("K3_trace_entries", """
SELECT 'C-' || c_custkey AS id, 0 AS part, 'customer' AS what, NULL AS far FROM customer UNION ALL SELECT 'O-' || o_orderkey, 0, 'order', NULL FROM orders
UNION ALL SELECT 'O-' || o_orderkey, 1, 'placed_by', 'C-' || o_custkey FROM orders UNION ALL SELECT 'O-' || o_orderkey, 2, 'CONSTRAINT', NULL FROM orders WHERE o_orderstatus = 'P'""")
def _trace_entries(spark, d):
    r = _orders(spark, d)
    p = Profile(SHOP.node_kinds, {"placed_by": [("order", "customer")]}, validations=({"code": "CONSTRAINT", "node_kind": "order", "reject": {"status": {"eq": "P"}}},))
    f = validate.finish(rel._union(validate.rule_checks(r, p)), r, p)
    return render.entries(r, f, p).select("id", "part", "what", F.when(F.col("part") == 1, F.col("far")).alias("far"))


@query("K2_findings_lines", "SELECT 'ERROR CONSTRAINT table:0 status eq \"P\"' AS line, count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def _lines(spark, d):
    """Plain lines of findings, each different one counted as they stream by."""
    r = _orders(spark, d)
    p = Profile(SHOP.node_kinds, {"placed_by": [("order", "customer")]}, validations=({"code": "CONSTRAINT", "node_kind": "order", "reject": {"status": {"eq": "P"}}, "severity": "error"},))
    lines = Counter(render.findings(validate.finish(rel._union(validate.rule_checks(r, p)), r, p)))
    return spark.createDataFrame(list(lines.items()), "line string, n long")


@query("O5_node_list", f"""
WITH w AS ({SQL["A11_worst"]}), a AS (SELECT 'C-' || c_custkey AS id FROM customer UNION ALL SELECT 'O-' || o_orderkey FROM orders)
SELECT row_number() OVER (ORDER BY worst IS NULL, CASE worst WHEN 'error' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END, n DESC, id) AS place, id FROM a LEFT JOIN w USING (id)""")
def _node_list(spark, d):
    from .catalog import QUERIES

    w = QUERIES["A11_worst"](spark, d)
    out = render.node_order(_orders(spark, d).nodes, w, SHOP, "severity").select("id").withColumn("m", F.monotonically_increasing_id())
    return out.select(F.row_number().over(Window.orderBy("m")).alias("place"), "id")


@query("P22_search", "WITH p AS (SELECT 'P-' || p_partkey AS id FROM part WHERE regexp_matches('P-' || p_partkey, '7$')) SELECT id, row_number() OVER (ORDER BY id <= 'P-17', id) AS hit FROM p")
def _search(spark, d):
    return render.search(table(spark, d, "part").select(key("P-", "p_partkey").alias("id")), "7$", "P-17")


@query("K9_exit_codes", "SELECT unnest(['clean', 'gating', 'broken', 'query']) AS what, unnest([0, 1, 2, 0]) AS code")
def _exit_codes(spark, d):
    r = shop(spark, d, line_nodes=False)
    f = lambda severity: validate.finish(spark.createDataFrame([(severity, "X", "m", None, "f", 1)], "severity string, code string, message string, node_id string, file string, line long"), r, Profile({}, {}))

    def broken():
        raise profiles.ProfileError("x")

    runs = [("clean", lambda: f("warning"), True), ("gating", lambda: f("error"), True), ("broken", broken, True), ("query", lambda: f("error"), False)]
    return spark.createDataFrame([(n, service.exit_code(run, gating)) for n, run, gating in runs], "what string, code int")


@query("G7_scc_chain", "SELECT 'P-' || p_partkey AS id, 'P-' || p_partkey AS component FROM part WHERE p_partkey > 0 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey > 1)")
def _scc_chain(spark, d):
    """A tree has no cycle: each part is a component of its own, whatever the order of names."""
    return graph.sccs(_tree(spark, d).filter("tgt <> 'P-0'"))


@query("S42_trace_round_trip", """
SELECT 'node' AS what, 'C-' || c_custkey AS id, 'customer' AS kind, NULL AS far FROM customer UNION ALL SELECT 'node', 'O-' || o_orderkey, 'order', NULL FROM orders
UNION ALL SELECT 'edge', 'O-' || o_orderkey, 'placed_by', 'C-' || o_custkey FROM orders UNION ALL SELECT 'finding', 'O-' || o_orderkey, 'CONSTRAINT', 'warning' FROM orders WHERE o_orderstatus = 'P'""")
def _trace_round_trip(spark, d):
    """A trace written as JSON lines and read again, pathways included."""
    r = _orders(spark, d)
    p = Profile(SHOP.node_kinds, {"placed_by": [("order", "customer")]}, validations=({"code": "CONSTRAINT", "node_kind": "order", "reject": {"status": {"eq": "P"}}},))
    f = validate.finish(rel._union(validate.rule_checks(r, p)), r, p)
    back = trace.read_trace(render.trace_lines(r, f, p))
    assert back.pathways == r.pathways
    n = back.nodes.select(F.lit("node").alias("what"), "id", "kind", F.lit(None).cast("string").alias("far"))
    e = back.edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), "kind", F.col("tgt").alias("far"))
    return n.unionByName(e).unionByName(back.findings.select(F.lit("finding").alias("what"), F.col("node_id").alias("id"), F.col("code").alias("kind"), F.col("severity").alias("far")))


@query("K10_scope_line", """
SELECT 'scope: 1 files; nodes customer ' || (SELECT count(*) FROM customer) || ' ghost 0 line 0 nation 0 order ' || (SELECT count(*) FROM orders) || ' part 0 region 0 supplier 0; edges in_nation 0 in_region 0 of_order 0 of_part 0 placed_by ' || (SELECT count(*) FROM orders) AS line""")
def _scope_line(spark, d):
    r = _orders(spark, d)
    return spark.createDataFrame([(render.scope_line(reports.scope(r, SHOP), r),)], "line string")
