"""Walks, fusing and the service on small graphs against plain versions."""

import random
import sys

import pytest

from registra.model import NodeKind, Profile, Register
from registra.operators import walks
from registra.plans import fuse, service, validate
from registra.sources.document import ContractError

NODE = "id string, kind string, attrs map<string,string>, file string, line long, ord long"
EDGE = "src string, tgt string, kind string, attrs map<string,string>, file string, line long, ord long"


def made(spark, nodes, edges):
    n = spark.createDataFrame([(i, "k", {}, "f", 1, k) for k, i in enumerate(nodes)], NODE)
    return Register(n, spark.createDataFrame([(a, b, "e", {}, "f", 1, k) for k, (a, b) in enumerate(edges)], EDGE))


def graph(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    return names[:8], [(rng.choice(names), rng.choice(names)) for _ in range(16)]


def plain_steps(nodes, edges, root):
    out, met, way = [], set(), []

    def enter(x, depth, nth, n):
        out.append((depth, x, "cycle" if x in way else "reconvergence" if x in met else "first", "declared" if x in nodes else "vacancy", nth, n))
        if x in met:
            return
        met.add(x)
        way.append(x)
        far = sorted(b for a, b in edges if a == x)
        seen = {}
        for b in far:
            enter(b, depth + 1, seen.get(b, 0), far.count(b))
            seen[b] = seen.get(b, 0) + 1
        way.pop()

    enter(root, 0, 0, 1)
    return out


def test_traverse_equals_plain(spark):
    nodes, edges = graph(5)
    root = max(nodes, key=lambda n: len(plain_steps(nodes, edges, n)))
    got = walks.traverse(made(spark, nodes, edges), root).orderBy("step").collect()
    assert [(r.depth, r.id, r.visit, r.endpoint, r.ordinal, r.parallel) for r in got] == plain_steps(nodes, edges, root)
    assert {"first", "reconvergence"} <= {r.visit for r in got}


def test_betweenness_equals_plain(spark):
    nodes, edges = graph(7)
    out = {n: {b for a, b in edges if a == n and a != b} for n in {x for e in edges for x in e} | set(nodes)}
    score = dict.fromkeys(out, 0.0)
    for s in nodes:
        ways, dist, order = {s: 1.0}, {s: 0}, [s]
        for x in order:
            for y in sorted(out[x]):
                if y not in dist:
                    dist[y] = dist[x] + 1
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    ways[y] = ways.get(y, 0) + ways[x]
        share = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in order:
                if y in out[x] and dist[y] == dist[x] + 1:
                    share[x] += ways[x] / ways[y] * (1 + share[y])
            if y != s:
                score[y] += share[y]
    r = made(spark, nodes, edges)
    got = {x.id: x.score for x in walks.betweenness(r.nodes.select("id"), r.edges).collect()}
    most = max(score[n] for n in nodes)
    assert got == pytest.approx({n: score[n] / most if most else 0 for n in nodes})


def test_lanes(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d")]
    r = made(spark, list("abcdex"), edges)
    got = {x.id: (x.row, x.lane) for x in walks.lanes(r.nodes.select("id"), r.edges).collect()}
    assert set(got) == set("abcdex") and got["d"] == got["e"]
    assert all(got[a][0] < got[b][0] for a, b in edges if {a, b} != {"d", "e"})
    assert len({got["b"][1], got["c"][1]}) == 2


def test_service_refuses_and_compares(spark):
    p = Profile({"k": NodeKind()}, {"e": [("k", "k")]})
    r = made(spark, ["a", "b"], [("a", "b"), ("a", "gone")])
    with pytest.raises(walks.QueryError, match="declared scope"):
        service.execute(service.View(r, p, service.Context(complete=True)), "counts")
    with pytest.raises(walks.QueryError, match="unknown request"):
        service.execute(service.View(r, p), "nothing")
    with pytest.raises(walks.QueryError, match="nothing was read"):
        service.execute(service.View(r, p), "at", target="/t", path="nowhere")
    got = service.execute(service.View(r, p, service.Context("snap", "all", True)), "reach", origin="a", edge_kinds=["e"], check_resolved=True)
    assert got.inputs[0][1].identity == "snap" and [(x.id, x.tainted) for x in got.payload.collect()] == [("b", False)]
    after = made(spark, ["a", "c"], [("a", "b")])
    both = service.compare(service.View(r, p), service.View(after, p)).payload
    assert {(x.id, x.change) for x in both["nodes"].collect()} == {("b", "removed"), ("c", "added")}
    assert {(x.tgt, x.change) for x in both["edges"].collect()} == {("gone", "removed")}
    assert validate.gate(service.execute(service.View(r, p), "validate").payload) == 1


def test_external_adapter(spark):
    text = '{"interface_version":"1.4","nodes":[{"id":"a","kind":"k","attrs":{"x":1.0,"y":"1"},"provenance":{"file":"f","line":0}}]}'
    r = service.run_program(spark, [sys.executable, "-c", f"print({text!r})"])
    assert [(x.id, x.attrs) for x in r.nodes.collect()] == [("a", {"x": "1.0", "y": '"1"'})]
    for code, why in (("raise SystemExit(3)", "ended with 3"), ("", "not JSON"), ("import time; time.sleep(9)", "timed out")):
        with pytest.raises(ContractError, match=why):
            service.run_program(spark, [sys.executable, "-c", code], timeout=3)


def test_fuse_refuses(tmp_path):
    path = tmp_path / "m.yaml"
    path.write_text("manifest_version: 1.0.0\nname: m\nversion: '1'\nfuse_profile: f.yaml\nsources:\n  - {name: a, profile: p.yaml, adapter: md, target: .}\n")
    assert fuse.load_manifest(str(path))["sources"][0]["profile"] == str(tmp_path / "p.yaml")
    path.write_text(path.read_text().replace("name: a,", "name: 'a:b',"))
    with pytest.raises(fuse.FuseError, match="contain ':'"):
        fuse.load_manifest(str(path))
    with pytest.raises(fuse.FuseError, match="node_kinds.*source:kind"):
        fuse.compile_fuse_profile({"node_kinds": {}, "edge_kinds": {"e": {"allowed": [["a:x", "y"]]}}})
    f = fuse.compile_fuse_profile({"edge_kinds": {"e": {"allowed": [["a:x", "b:y"]]}}, "validations": [{"COVERAGE": {"target_kind": "b:y", "edge_kind": "e"}}]})
    with pytest.raises(fuse.FuseError, match="b:y"):
        fuse.check_endpoints(f, {"a": Profile({"x": NodeKind()}, {})})


def test_loop_tables_are_deleted(spark):
    import os

    from registra import shared

    shared.clean(spark)
    r = made(spark, ["a", "b"], [("a", "b")])
    assert walks.component_order(r.nodes.select("id"), r.edges).count() == 2
    written = list(shared._written)
    assert written and all(os.path.exists(w.removeprefix("file:")) for w in written)
    assert shared.clean(spark) == len(written) and not any(os.path.exists(w.removeprefix("file:")) for w in written)
