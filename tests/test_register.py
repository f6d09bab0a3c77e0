"""Semantics on small hand-made registers."""

import pytest
from pyspark.sql import functions as F

from registra.functions.predicates import block, condition, first_failing, has_type, parse_block, parse_filter
from registra.model import EDGE, NODE, NodeKind, Profile, Register
from registra.operators import graph
from registra.operators import relations as rel
from registra.plans import validate


def nodes(spark, *rows):
    return spark.createDataFrame([(i, k, a, "f", n, n) for n, (i, k, a) in enumerate(rows)], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(s, t, k, {}, "f", n, n) for n, (s, t, k) in enumerate(rows)], EDGE)


def test_conditions_are_type_aware_and_never_null(spark):
    n = nodes(spark, ("a", "x", {"v": "42"}), ("b", "x", {"v": '"42"'}), ("c", "x", {"v": "null"}), ("d", "x", {}))
    holds = lambda c: {r.id for r in n.filter(c).select("id").collect()}
    assert holds(condition("v", "eq", 42)) == {"a"}
    assert holds(condition("v", "eq", "42")) == {"b"}
    assert holds(condition("v", "ne", 42)) == {"b", "c", "d"}
    assert holds(condition("v", "present", True)) == {"a", "b", "c"}
    assert holds(condition("v", "lt", 50)) == {"a"}
    assert holds(~condition("v", "lt", 3)) == {"a", "b", "c", "d"}
    assert holds(condition("v", "matches", "^4")) == {"a", "b"}
    assert holds(condition("v", "in", [])) == set()
    assert holds(block({"v": {"eq": 42}}, expect=False)) == {"b", "c", "d"}
    assert n.filter("id = 'a'").select(first_failing({"v": {"gt": 50}})).first()[0] == "v gt 50"


def test_types(spark):
    n = nodes(spark, ("a", "x", {"v": '"2024-02-29"'}), ("b", "x", {"v": '"2023-02-29"'}), ("c", "x", {"v": "18446744073709551615"}), ("d", "x", {"v": "18446744073709551616"}), ("e", "x", {"v": "1.0"}))
    got = lambda t: {r.id for r in n.filter(has_type(F.col("attrs")["v"], t)).collect()}
    assert got("date") == {"a"}
    assert got("int") == {"c"}
    assert got("float") == {"e"}


def test_filter_grammar():
    assert parse_filter("a>=3") == ("a", "gte", 3)
    assert parse_filter("a=true") == ("a", "eq", True)
    assert parse_filter("a~=x=y") == ("a", "matches", "x=y")
    with pytest.raises(ValueError):
        parse_filter("nothing")
    with pytest.raises(ValueError, match="a.*b"):
        parse_block({"a": {"not": 1}, "b": {"lt": True}})


def test_walks_on_cycles_and_undeclared_ends(spark):
    n = nodes(spark, ("a", "x", {}), ("b", "x", {}), ("d", "x", {}))
    e = edges(spark, ("a", "b", "k"), ("b", "a", "k"), ("b", "c", "k"), ("c", "d", "k"), ("a", "a", "k"))
    got = {(r.id, r.depth, r.tainted) for r in graph.reach(n, e, "a", check_resolved=True).collect()}
    assert got == {("b", 1, False), ("d", 3, True)}
    p = graph.path(e, "a", "d").first()
    assert p.nodes == ["a", "b", "c", "d"]
    assert graph.path(e, "d", "a").count() == 0
    assert {(r.id, r.component) for r in graph.sccs(e).collect()} == {("a", "b"), ("b", "b"), ("c", "c"), ("d", "d")}


def test_deep_coverage_leaves_cycles_and_childless_targets_out(spark):
    t = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    via = edges(spark, ("b", "a", "v"), ("b", "a", "v"), ("c", "a", "v"), ("d", "e", "v"), ("e", "d", "v"))
    proof = spark.createDataFrame([("b",), ("c",)], "id string")
    assert {r.id for r in graph.deep_uncovered(t, via, proof).collect()} == {"d", "e", "f"}


def test_diff_pairs_parallel_edges(spark):
    n = nodes(spark, ("a", "x", {"p": "1"}))
    a = Register(n, edges(spark, ("a", "b", "k"), ("a", "b", "k")))
    b = Register(nodes(spark, ("a", "x", {"p": "2"}), ("b", "x", {})), edges(spark, ("a", "b", "k")))
    dn, de = rel.diff(a, b)
    assert {(r.id, r.change) for r in dn.collect()} == {("a", "changed"), ("b", "added")}
    assert [(r.nth, r.change) for r in de.collect()] == [(2, "removed")]


def test_validate_pipeline(spark):
    p = Profile({"req": NodeKind("R-[0-9]+", {"tags": {"type": "list", "items": "int"}}), "test": NodeKind(orphan_ok=True)}, {"verifies": [("test", "req")]}, validations=({"code": "EDGE_COUNT", "node_kind": "req", "edge_kind": "verifies", "direction": "in", "max": 1},), suppressions=(("ID_FORMAT", ["bad"]),))
    n = nodes(spark, ("R-1", "req", {"tags": '[1,"x"]'}), ("bad", "req", {}), ("t", "test", {}), ("t", "test", {}), ("z", "odd", {}))
    e = edges(spark, ("t", "R-1", "verifies"), ("t", "R-1", "verifies"), ("t", "gone", "verifies"), ("t", "R-1", "jumps"), ("bad", "R-1", "verifies"))
    f = validate.validate(Register(n, e), p)
    got = sorted((r.code, r.node_id or "", r.suppressed) for r in f.collect())
    assert ("ATTR_LIST_ITEMS", "R-1", False) in got and ("ID_FORMAT", "bad", True) in got and ("PARSE_ERROR", "t", False) in got
    assert ("EDGE_COUNT", "R-1", False) in got and ("EDGE_CONSTRAINT", "bad", False) in got and ("VACANCY", "t", False) in got
    assert sum(c == "UNKNOWN_KIND" for c, _, _ in got) == 2
    assert ("UNREFERENCED", "bad", False) in got and not any(i == "z" and c != "UNKNOWN_KIND" for c, i, _ in got)
    assert validate.gate(f) == 1


def test_pathways_are_checked(spark):
    with pytest.raises(ValueError):
        Register(nodes(spark), edges(spark), {"p": (["a", "a"], "a")})
