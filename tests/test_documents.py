"""Documents of many entries, and odd ones."""

import json

from registra.model import EDGE, NODE, Register
from registra.sources import document


def entry(i):
    return {"id": i, "kind": "k", "attrs": {"n": 1.0}, "provenance": {"file": "f", "line": 0}}


def test_entries_do_not_carry_their_document(spark):
    """What needs the text is worked out once a document, not once an entry, which took time with the square of a document's length."""
    docs = spark.createDataFrame([(0, "{}")], "doc long, text string")
    for frame in (document.read(docs, checked=False).edges, document.declared_nodes(docs), document._entries(docs, "edges"), document._entries(docs, "findings")):
        above = frame._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert "text" not in above and "from_json" not in above and "parse_json" not in above


def test_odd_documents(spark):
    sound = json.dumps({"interface_version": "1.4", "nodes": [entry("a")]})
    texts = [sound, sound[:-1] + ',"nodes":[]}', sound.replace('"', "'"), sound.replace("1.0", "NaN"), "[" + sound + "]", sound.replace('"id": "a"', '"id": "a", "id": "b"'), sound.replace('[{"id"', '[null, {"id"'), json.dumps({"interface_version": "1.4", "nodes": {}}), "", None, "{}", sound.replace('"1.4"', "1.4")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = sorted((r.doc, r.place, r.fault) for r in document.faults(docs).collect())
    nothing = "not JSON, or nothing at all"
    old = [(1, "document", nothing), (2, "document", nothing), (3, "document", nothing), (4, "document", "must be an object"), (5, "document", nothing), (6, "node 0", "must be an object"), (7, "document", "'nodes' must be list, got object"), (8, "document", nothing), (9, "document", nothing)]
    assert [g for g in got if g[0] < 6] == old[:5] and old[5] in got and [g for g in got if g[0] in (7, 8, 9)] == old[6:]
    assert [g[0] for g in got if "unsupported interface version" in g[2]] == [10, 11]


def test_a_register_dealt_over_documents_is_read_in_order(spark):
    n = spark.createDataFrame([(f"n{i:03}", "k", {"at": str(i)}, "f", i, i) for i in reversed(range(100))], NODE)
    e = spark.createDataFrame([(f"n{i:03}", "n000", "e", {}, "f", i, i) for i in range(50)], EDGE)
    docs = document.write_many(Register(n, e, {"p": (["a", "b"], "b")}), most=7)
    assert docs.count() >= 1 + 15 + 8 and docs.count() == docs.select("doc").distinct().count()
    r = document.read(docs)
    assert [x.id for x in r.nodes.orderBy("ord").collect()] == [f"n{i:03}" for i in range(100)] and [x.src for x in r.edges.orderBy("ord").collect()] == [f"n{i:03}" for i in range(50)]
    assert r.pathways == {"p": (["a", "b"], "b")} and r.findings.count() == 0
