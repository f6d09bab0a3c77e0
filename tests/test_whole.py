"""Whole answers where the code once gave a part."""

import pytest

from registra.model import EDGE, NODE, NodeKind, Profile, Register
from registra.operators import relations as rel
from registra.plans import validate
from registra.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, k, a, "f", n, n) for n, (i, k, a) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(s, t, k, {}, "g", n, n) for n, (s, t, k) in enumerate(rows)], EDGE)


def test_reach_has_no_depth_limit(spark):
    n = spark.read.parquet(f"{DATA}/part.parquet").filter("p_partkey > 1").count()
    got = QUERIES["G1_reach_all"](spark, DATA)
    assert got.count() == n > 30 and got.agg({"depth": "max"}).first()[0] > 4


def test_edge_count_reports_edges_without_a_group(spark):
    p = Profile({"x": NodeKind(), "y": NodeKind()}, {"k": [("x", "y")]}, validations=({"code": "EDGE_COUNT", "node_kind": "x", "edge_kind": "k", "group_by": "v", "min": 1, "max": 1},))
    n = nodes(spark, ("a", "x", {}), ("b", "x", {}), ("c", "x", {}), ("n", "y", {"v": "null"}), ("o", "y", {}), ("p", "y", {"v": "1"}), ("q", "y", {"v": "1"}), ("z", "odd", {}))
    e = edges(spark, ("a", "n", "k"), ("a", "o", "k"), ("b", "q", "k"), ("b", "p", "k"), ("b", "o", "k"), ("b", "z", "k"), ("b", "gone", "k"))
    got = sorted((r.node_id, r.message, r.file, r.line) for r in validate.rule_checks(Register(n, e), p)[0].union(validate.rule_checks(Register(n, e), p)[1]).collect())
    lacks = lambda s, t: f"edge '{s}'->'{t}' (kind 'k'): target '{t}' has no 'v' attr to group by"
    assert got == [
        ("a", lacks("a", "n"), "g", 0), ("a", lacks("a", "o"), "g", 1), ("b", lacks("b", "o"), "g", 4),
        ("b", "node 'b' has 2 outgoing 'k' edge(s) to a target with 'v' = 1, expected exactly 1: 'q' (g:2), 'p' (g:3)", "f", 1),
        ("c", "node 'c' has 0 outgoing 'k' edge(s), expected exactly 1", "f", 2),
    ]


def test_deep_coverage_heeds_where_and_source_where_and_names_causes(spark):
    v = {"code": "COVERAGE_DEEP", "target_kind": "x", "via": "v", "evidence": "e", "where": {"skip": {"ne": True}}, "source_where": {"old": {"ne": True}}}
    p = Profile({"x": NodeKind(), "s": NodeKind()}, {"v": [("x", "x")], "e": [("s", "x")]}, validations=(v,))
    n = nodes(spark, *((i, "x", {"skip": "true"} if i == "h" else {}) for i in "abcdefghi"), ("s", "s", {}), ("t", "s", {"old": "true"}), ("u", "s", {}))
    e = edges(spark, ("b", "a", "v"), ("c", "a", "v"), ("h", "a", "v"), ("d", "e", "v"), ("e", "d", "v"), ("e", "g", "v"), ("f", "f", "v"), ("c", "i", "v"), ("s", "c", "e"), ("t", "b", "e"), ("t", "h", "e"))
    got = {(r.code, r.node_id, r.message.split(": ", 1)[-1]) for r in validate.rule_checks(Register(n, e), p)[0].union(validate.rule_checks(Register(n, e), p)[1]).collect()}
    assert got == {
        ("COVERAGE_DEEP", "a", "uncovered children: 'b', 'h'"), ("COVERAGE_DEEP", "b", "no evidence and no children"), ("COVERAGE_DEEP", "d", "in an uncovered 'v' cycle: d, e"),
        ("COVERAGE_DEEP", "e", "in an uncovered 'v' cycle: d, e"), ("COVERAGE_DEEP", "f", "in an uncovered 'v' cycle: f"), ("COVERAGE_DEEP", "g", "uncovered children: 'e'"),
        ("COVERAGE_UNKNOWN", None, "1 of 2 sources have no e edge; deep coverage of x is unknown"),
    }


def test_an_entrys_severity_wins_over_the_codes(spark):
    v = {"code": "CONSTRAINT", "node_kind": "x", "expect": {"a": {"present": True}}}
    p = Profile({"x": NodeKind()}, {"k": [("x", "x")]}, validations=({**v, "severity": "error"}, v), overrides={"CONSTRAINT": "info"})
    f = validate.validate(Register(nodes(spark, ("a", "x", {})), edges(spark)), p)
    assert sorted(r.severity for r in f.filter("code = 'CONSTRAINT'").collect()) == ["error", "info"] and validate.gate(f) == 1


def test_suppressions_are_judged_by_node(spark):
    p = Profile({"x": NodeKind("[a-z]")}, {"k": [("x", "x")]}, suppressions=(("ID_FORMAT", ["AA", "gone"]), ("ID_FORMAT", ["AA"]), ("UNTRACED", None), ("VACANCY", None), ("SUPPRESS_UNUSED", ["x"])))
    f = validate.validate(Register(nodes(spark, ("AA", "x", {})), edges(spark)), p)
    assert sorted(r.message for r in f.filter("code = 'SUPPRESS_UNUSED'").collect()) == ["nothing to suppress: ID_FORMAT at gone", "nothing to suppress: SUPPRESS_UNUSED at x", "nothing to suppress: VACANCY"]
    assert {r.code for r in f.filter("suppressed").collect()} == {"ID_FORMAT", "UNTRACED"}


def test_rollup_drops_no_status(spark):
    n = spark.range(10_001).selectExpr("cast(id as string) as id", "'x' as kind", "map('s', concat('\"s', id, '\"'), 'g', '\"g\"') as attrs", "'f' as file", "id as line", "id as ord")
    r = Register(n, edges(spark))
    with pytest.raises(ValueError, match="rollup_long"):
        rel.rollup(r, "x", "s", "g")
    assert rel.rollup_long(r, "x", "s", "g", ["none"]).selectExpr("count(*)", "sum(n)", "min(n)", "max(total)").first()[:] == (10_002, 10_001, 0, 10_001)


def test_diff_has_edges_too(spark):
    got = {(r.what, r.kind) for r in QUERIES["J10_diff_all"](spark, DATA).select("what", "kind").distinct().collect()}
    assert got == {("node", "order"), ("edge", "placed_by"), ("edge", "of_order")}
