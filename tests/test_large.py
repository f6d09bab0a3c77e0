"""Queries that once held a whole table in one row or on the driver."""

import json

import pytest

from registra.model import EDGE, NODE, NodeKind, Profile, Register
from registra.operators import ranking
from registra.plans import whole_catalog  # noqa: F401
from registra.plans.catalog import QUERIES, SQL
from registra.sinks import render
from registra.sources import trace

DATA = "/root/testdata/sf0.001"


def test_suggestion_documents_stay_small(spark, tmp_path, monkeypatch):
    spark.range(25_000).selectExpr("id as o_orderkey", "id as o_custkey", "'5-LOW' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    seen, read = [], ranking.read_suggestions
    monkeypatch.setattr(ranking, "read_suggestions", lambda docs: seen.append(docs) or read(docs))
    assert QUERIES["S43_suggestions_document"](spark, str(tmp_path)).distinct().count() == 25_000
    assert seen[0].selectExpr("max(json_array_length(get_json_object(text, '$.suggestions')))").first()[0] <= 10_000


def test_trace_lines_are_those_of_trace(spark):
    n = spark.createDataFrame([("b", "y", {"s": '"q\\"x"', "n": "1.0"}, "f", 1, 1), ("c", "x", {}, "g", 2, 2), ("a", "z", {}, "f", 3, 3)], NODE)
    e = spark.createDataFrame([("b", "c", "k", {}, "f", 5, 1), ("b", "a", "k", {}, "f", 4, 2), ("gone", "a", "k", {}, "f", 4, 3)], EDGE)
    f = spark.createDataFrame([("error", "C", "m", "b", "f", 1), ("hint", "D", "n", None, "f", 2), ("hint", "B", "n", "none", "f", 1)], "severity string, code string, message string, node_id string, file string, line long")
    r, p = Register(n, e, {"w": (["1", "2"], "2")}, None), Profile({"x": NodeKind(), "y": NodeKind()}, {"k": [("x", "y")]})
    lines = render.trace_lines(r, f, p).orderBy("line").collect()
    assert [x.line for x in lines] == list(range(6)) and [json.loads(x.text) for x in lines] == [json.loads(x) for x in render.trace(r, f, p, "json")]


def test_no_trace_passes_through_the_driver(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("lines on the driver")

    monkeypatch.setattr(render, "trace", refuse)
    assert QUERIES["S42_trace_round_trip"](spark, DATA).filter("what = 'edge'").count() == spark.read.parquet(f"{DATA}/orders.parquet").filter("o_orderkey % 5 = 0").count()


def test_a_trace_has_every_order(spark, tmp_path):
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    keys = (1, 5, 7, 11)
    spark.createDataFrame([(k, 3, "P", "5-LOW") for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.what, r.id) for r in QUERIES["S42_trace_round_trip"](spark, str(tmp_path)).filter("kind <> 'customer'").collect()}
    assert got == {(what, f"O-{k}") for k in keys for what in ("node", "edge", "finding")}
    assert "%" not in SQL["S42_trace_round_trip"]


def test_a_trace_is_parsed_once_and_keeps_odd_parts(spark):
    texts = [
        '{"id":"a","kind":"x","attrs":{"f":2.0,"z":null},"file":"f","line":3,"edges":[{"kind":"k","tgt":"b","file":"g","line":4},5],"findings":[{"severity":"hint","code":"C","message":"m"}]}',
        '{"id":"b","kind":"","edges":null}', '{"unattachable":5}', '{"pathway":"p","order":["1","2"],"current":"2"}',
    ]
    of = lambda *texts: trace.read_trace(spark.createDataFrame(list(enumerate(texts)), "line long, text string"))
    r = of(*texts)
    assert [tuple(x) for x in r.nodes.orderBy("ord").collect()] == [("a", "x", {"f": "2.0", "z": "null"}, "f", 3, 0), ("b", "", None, None, None, 1)]
    assert [tuple(x) for x in r.edges.orderBy("ord").collect()] == [("a", "b", "k", {}, "g", 4, 0), ("a", None, None, {}, None, None, 1)]
    assert {tuple(x) for x in r.findings.collect()} == {("hint", "C", "m", "a", "f", 3), (None,) * 6} and r.pathways == {"p": (["1", "2"], "2")}
    assert not any("parsejson" in df._jdf.queryExecution().optimizedPlan().toString().lower() for df in (r.nodes, r.edges, r.findings))
    for bad, why in (("[1]", "trace line 4: not a JSON object"), ('{"id":"a","kind":"y"}', "trace: 'a' has 2 entries")):
        with pytest.raises(trace.ContractError, match=why):
            of(*texts, bad)


def test_ranking_compares_blocks_not_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", (3, 4))
    vecs = [(f"{'st'[i % 2]}{i}", "xyz"[i % 3], [float(i % 5), 1.0, float(i % 7)] if i % 11 else [0.0, 0.0, 0.0]) for i in range(40)] + [("t1", "y", [9.0, 0.0, 1.0]), ("s0", "x", [1.0, 2.0]), ("t3", "x", None), ("s4", "z", [1.0, 1.0, 1.0])]
    of = lambda side: [v for v in vecs if v[0][0] in side]
    p = Profile({}, {"near": [("x", "x"), ("x", "y"), ("y", "z"), ("z", "x")]})
    got = ranking.rank(*(spark.createDataFrame(of(x), "id string, kind string, vec array<float>") for x in ("s", "st")), p, "near", 3)
    norm = lambda v: sum(x * x for x in v) ** 0.5
    score = lambda a, b: None if a is None or b is None or len(a) != len(b) else 0.0 if not norm(a) or not norm(b) else round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6)
    best = {}
    for s, ks, a in of("s"):
        for t, kt, b in of("st"):
            if s != t and (ks, kt) in p.edge_kinds["near"]:
                best.setdefault(s, {}).setdefault(t, []).append(score(a, b))
    low = lambda xs: max((x for x in xs if x is not None), default=None)
    want = {(s, t, i) for s, ts in best.items() for i, (t, _) in enumerate(sorted(((t, low(x)) for t, x in ts.items()), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:3], 1)}
    assert {(r.src, r.tgt, r["rank"]) for r in got.collect()} == want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
