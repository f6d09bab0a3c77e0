"""Queries of the sources: documents and files made from the driver's tables, read back as registers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import text_of
from ..model import Register, attrs, edge, literal, node
from ..sources import document, files, issues, markdown, prose, specs, symbols, toml_tables
from .catalog import key, query, table


def _customers(spark, d):
    """Customers in the order of their document, every tenth one twice."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    copies = F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("*", F.explode(copies).alias("copy")).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "copy", "c_mktsegment"))).alias("rows"))


def _documents(spark, d):
    """A document for each nation: the nation, then its customers, each with an edge to it; edges of every seventh customer don't say which entry declared them."""
    file = F.concat(F.lit("doc-"), F.col("c_nationkey").cast("string"))
    prov = lambda line: F.struct(file.alias("file"), line.alias("line")).alias("provenance")
    nation = F.concat(F.lit("N-"), F.col("c_nationkey").cast("string"))
    head = F.struct(nation.alias("id"), F.lit("nation").alias("kind"), F.struct(F.lit(None).cast("string").alias("segment"), F.lit(None).cast("long").alias("n")).alias("attrs"), prov(F.lit(0)))
    name = lambda x: F.concat(F.lit("C-"), x.c_custkey.cast("string"))
    nodes = F.concat(F.array(head), F.transform("rows", lambda x, i: F.struct(name(x).alias("id"), F.lit("customer").alias("kind"), F.struct(x.c_mktsegment.alias("segment"), x.c_custkey.cast("long").alias("n")).alias("attrs"), prov(i + 1))))
    edges = F.transform("rows", lambda x, i: F.struct(name(x).alias("src"), nation.alias("tgt"), F.lit("in_nation").alias("kind"), prov(i + 1), F.when(x.c_custkey % 7 != 0, i + 1).alias("declared_by")))
    found = F.array(F.struct(F.lit("hint").alias("severity"), F.lit("EXTERNAL_REF").alias("code"), F.lit("seen").alias("message"), nation.alias("node_id"), prov(F.lit(0))))
    return _customers(spark, d).select(F.col("c_nationkey").cast("long").alias("doc"), F.to_json(F.struct(F.lit("1.4").alias("interface_version"), nodes.alias("nodes"), edges.alias("edges"), found.alias("findings"))).alias("text"))


_DOCS = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s, copy, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, copy) AS line
FROM (SELECT *, unnest(CASE WHEN c_custkey % 10 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM customer))"""


@query("S1_document_nodes", _DOCS + " SELECT 'C-' || k AS id, 'customer' AS kind, '\"' || s || '\"' AS segment, k::VARCHAR AS n, 'doc-' || n AS file, line FROM c WHERE copy = 0 UNION ALL SELECT DISTINCT 'N-' || n, 'nation', NULL, NULL, 'doc-' || n, 0 FROM c")
def _nodes(spark, d):
    r = document.read(_documents(spark, d))
    return r.nodes.select("id", "kind", F.col("attrs")["segment"].alias("segment"), F.col("attrs")["n"].alias("n"), "file", "line")


@query("S7_document_edges", _DOCS + " SELECT 'C-' || k AS src, 'N-' || n AS tgt, line FROM c WHERE copy = 0 OR k % 7 = 0")
def _edges(spark, d):
    return document.read(_documents(spark, d)).edges.select("src", "tgt", "line")


@query("V25_document_findings", _DOCS + """
SELECT 'PARSE_ERROR' AS code, 'C-' || b.k AS node_id, 'duplicate node ''C-' || b.k || ''': first at doc-' || a.n || ':' || a.line || CASE WHEN b.k % 7 = 0 THEN '; edges read that no entry declares: 2' ELSE '; edges not read: 1' END AS message, b.line
FROM c a JOIN c b ON a.k = b.k AND a.copy = 0 AND b.copy = 1 UNION ALL SELECT DISTINCT 'EXTERNAL_REF', 'N-' || n, 'seen', 0 FROM c""")
def _repeats(spark, d):
    return document.read(_documents(spark, d)).findings.select("code", "node_id", "message", "line")


@query("S4_contract_faults", """
WITH c AS (SELECT c_custkey % 9 AS m, 'document ' || c_custkey AS doc FROM customer)
SELECT doc, CASE m WHEN 1 THEN 'document' WHEN 2 THEN 'document' WHEN 3 THEN 'document' WHEN 4 THEN 'node 0' WHEN 5 THEN 'node 0' WHEN 6 THEN 'edge 0' WHEN 7 THEN 'pathway 0' ELSE 'document' END AS place FROM c WHERE m > 0""")
def _faults(spark, d):
    """One document for each customer: sound ones, a wrong version, null for a list, an unknown key, a line out of range, attributes that aren't an object, an edge that no entry declared, a pathway outside its order, and text that is no JSON."""
    good = '{"interface_version":"1.3","nodes":[{"id":"a","kind":"k","attrs":{},"provenance":{"file":"f","line":4294967295}}],"edges":[],"pathways":[{"name":"p","order":["x"],"current":"x"}]}'
    texts = [good, good.replace("1.3", "0.9"), good.replace('"edges":[]', '"edges":null'), good.replace('"edges"', '"edgs"'), good.replace("4294967295", "4294967296"), good.replace('"attrs":{}', '"attrs":[1]')]
    texts += [good.replace('"edges":[]', '"edges":[{"src":"a","tgt":"b","kind":"e","provenance":{"file":"f","line":0},"declared_by":1}]'), good.replace('"current":"x"', '"current":"y"'), good[:-1]]
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.array(*map(F.lit, texts))[(F.col("c_custkey") % 9).cast("int")].alias("text"))
    return document.faults(docs).select(F.concat(F.lit("document "), F.col("doc").cast("string")).alias("doc"), "place")


@query("K12_document_round_trip", "SELECT 'P-' || p_partkey AS id, p_size::VARCHAR AS size, '\"' || p_brand || '\"' AS brand, CASE WHEN p_partkey > 1 THEN 'P-' || (p_partkey // 2) END AS parent FROM part")
def _round_trip(spark, d):
    p = table(spark, d, "part")
    n = node(p, key("P-", "p_partkey"), "part", attrs(size=literal(F.col("p_size"), "int"), brand=literal(F.col("p_brand"), "string")), order=F.col("p_partkey"))
    e = edge(p.filter("p_partkey > 1"), key("P-", "p_partkey"), F.concat(F.lit("P-"), F.floor(F.col("p_partkey") / 2).cast("string")), "derives", order=F.col("p_partkey"))
    r = document.read(document.write_many(Register(n, e, {"stage": (["a", "b"], "a")})))
    return r.nodes.join(r.edges.select(F.col("src").alias("id"), F.col("tgt").alias("parent")), "id", "left").select("id", F.col("attrs")["size"].alias("size"), F.col("attrs")["brand"].alias("brand"), "parent")


def _file(rows, head: str, line, tail: str = ""):
    """One file a nation: a line for each customer under a head."""
    lines = F.transform(rows, line)
    return F.encode(F.concat(F.lit(head), F.array_join(lines, ""), F.lit(tail)), "utf-8").alias("content")


def _markdown(spark, d):
    """Tables of customers: every tenth row lacks a cell, every seventh stands in fenced code, and the others name two nations."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("rows"))
    name = lambda x: x.c_custkey.cast("string")
    row = lambda x: F.when(x.c_custkey % 10 == 0, F.concat(F.lit("| **C-"), name(x), F.lit("** | short |\n"))).otherwise(F.concat(F.lit("| **C-"), name(x), F.lit("** | a \\| "), x.c_mktsegment, F.lit(" | N-1, [N-2, x](u) |\n")))
    fence = F.concat(F.lit("\n```\n| ID | Segment | Nations |\n|---|---|---|\n"), F.array_join(F.transform(F.filter("rows", lambda x: x.c_custkey % 7 == 0), row), ""), F.lit("```\n"))
    body = F.concat(F.lit("# People\n\n> | ID | Segment | Nations |\n> |:--|---|--:|\n"), F.array_join(F.transform(F.filter("rows", lambda x: x.c_custkey % 7 != 0), lambda x: F.concat(F.lit("> "), row(x))), ""), fence)
    return c.select(F.concat(F.lit("md/"), F.col("c_nationkey").cast("string"), F.lit(".md")).alias("file"), F.encode(body, "utf-8").alias("content"))


MD = {"tables": [{"heading": "^People$", "kind": "customer", "id_column": "ID", "column_map": {"Segment": "segment"}, "edge_columns": {"Nations": "in_nation"}, "strip_emphasis": True}]}
_MD = "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s, 4 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer WHERE c_custkey % 7 <> 0)"


@query("S11_markdown_nodes", _MD + " SELECT 'C-' || k AS id, 'a | ' || s AS segment, 'md/' || n || '.md' AS file, line FROM c WHERE k % 10 <> 0")
def _md_nodes(spark, d):
    r = markdown.read_markdown(_markdown(spark, d), MD, ["customer"])
    return r.nodes.select("id", text_of(F.col("attrs")["segment"]).alias("segment"), "file", "line")


@query("S15_markdown_edges", _MD + " SELECT 'C-' || k AS src, unnest(['N-1', '[N-2, x](u)']) AS tgt, line FROM c WHERE k % 10 <> 0")
def _md_edges(spark, d):
    return markdown.read_markdown(_markdown(spark, d), MD, ["customer"]).edges.select("src", "tgt", "line")


@query("S12_markdown_findings", _MD + " SELECT 'PARSE_ERROR' AS code, 'md/' || n || '.md: table row has fewer columns than its header' AS message, line FROM c WHERE k % 10 = 0")
def _md_findings(spark, d):
    return markdown.read_markdown(_markdown(spark, d), MD, ["customer"]).findings.select("code", "message", "line")


TOML = {"id_prefix": "file_stem", "tables": {"customer": {"kind": "customer", "id_key": "id", "id_prefix": "kind", "key_map": {"segment": "segment", "deep.size": "size", "tags": {"scalars": "tags", "tables": {"name": "names"}}}, "edge_keys": {"nation": {"kind": "in_nation", "fallback": "land"}, "peers": {"kind": "peer", "table": "customer"}}}}}


def _toml(spark, d):
    """An array of tables a nation. Every seventh customer's nation is read from the fallback key; every tenth has a peer that isn't a string."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("rows"))

    def entry(x):
        k = x.c_custkey.cast("string")
        peers = F.when(x.c_custkey % 10 == 0, F.lit('["a", { x = 1 }]')).otherwise(F.lit('["a",\n  "b", # c\n]'))
        return F.concat(F.lit('[[customer]]\nid = "C-'), k, F.lit('"\nsegment = "'), x.c_mktsegment, F.lit('"\n'), F.when(x.c_custkey % 7 == 0, "land").otherwise("nation"), F.lit(' = "N-1"\ntags = [1, { name = "t", x = 2 }, "z"]\npeers = '), peers, F.lit("\n[customer.deep]\nsize = "), k, F.lit("\n\n"))

    return c.select(F.concat(F.lit("reg/"), F.col("c_nationkey").cast("string"), F.lit(".toml")).alias("file"), _file(F.col("rows"), "# customers\n", entry))


_TOML = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s, 2 + coalesce(sum(CASE WHEN c_custkey % 10 = 0 THEN 9 ELSE 11 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM customer)"""


@query("S17_toml_nodes", _TOML + " SELECT n || '/customer/C-' || k AS id, '\"' || s || '\"' AS segment, k::VARCHAR AS size, '[1,\"z\"]' AS tags, '[\"t\"]' AS names, line::BIGINT AS line FROM c")
def _toml_nodes(spark, d):
    r = toml_tables.read_toml(_toml(spark, d), TOML)
    return r.nodes.select("id", *(F.col("attrs")[a].alias(a) for a in ("segment", "size", "tags", "names")), "line")


@query("S20_toml_edges", _TOML + """
SELECT n || '/customer/C-' || k AS src, 'N-1' AS tgt, 'in_nation' AS kind, (line + 3)::BIGINT AS line FROM c UNION ALL SELECT n || '/customer/C-' || k, n || '/customer/a', 'peer', (line + 5)::BIGINT FROM c
UNION ALL SELECT n || '/customer/C-' || k, n || '/customer/b', 'peer', (line + 6)::BIGINT FROM c WHERE k % 10 <> 0""")
def _toml_edges(spark, d):
    return toml_tables.read_toml(_toml(spark, d), TOML).edges.select("src", "tgt", "kind", "line")


@query("S17_toml_findings", _TOML + " SELECT 'PARSE_ERROR' AS code, 'reg/' || n || '.toml: customer ''' || n || '/customer/C-' || k || ''' has edge key ''peers'' entry 2 of 2: { x = 1 } is a table, not a target string; it was not read' AS message, (line + 5)::BIGINT AS line FROM c WHERE k % 10 = 0")
def _toml_findings(spark, d):
    return toml_tables.read_toml(_toml(spark, d), TOML).findings.select("code", "message", "line")


def _prose(spark, d):
    """A text a nation: a heading for each customer, and below it a reference to the next number, in this file or in that of a neighbour."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey"))).alias("rows"))

    def entry(x):
        k = x.c_custkey
        way = F.when(k % 3 == 0, F.lit("`1.md` § ")).when(k % 3 == 1, F.lit("see § ")).otherwise(F.lit("`t/nowhere.md` § "))
        return F.concat(F.lit("## Customer "), k.cast("string"), F.lit(": of note\n\n"), way, F.lit("`Customer "), k.cast("string"), F.lit("`\n\n"))

    return c.select(F.concat(F.lit("t/"), F.col("c_nationkey").cast("string"), F.lit(".md")).alias("file"), _file(F.col("rows"), "# All\n\n", entry))


_PROSE = "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 3 + 4 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS line FROM customer), one AS (SELECT count(*) AS there FROM customer WHERE c_nationkey = 1)"


@query("S24_prose_sections", _PROSE + " SELECT 't/' || n || '.md#All::Customer ' || k || ': of note' AS id, '2' AS level, line FROM c UNION ALL SELECT DISTINCT 't/' || n || '.md#All', '1', 1 FROM c")
def _sections(spark, d):
    r = prose.read_prose(_prose(spark, d), ["t"])
    return r.nodes.filter("kind = 'section'").select("id", F.col("attrs")["level"].alias("level"), "line")


@query("J17_prose_edges", _PROSE + """
SELECT 't/' || n || '.md#All::Customer ' || k || ': of note' AS src, CASE WHEN k % 3 = 1 OR n = 1 THEN 't/' || n || '.md#All::Customer ' || k || ': of note' ELSE 't/1.md#Customer ' || k END AS tgt, line + 2 AS line FROM c, one WHERE k % 3 = 1 OR k % 3 = 0 AND there > 0""")
def _xrefs(spark, d):
    return prose.read_prose(_prose(spark, d), ["t"]).edges.select("src", "tgt", "line")


@query("S26_prose_findings", _PROSE + " SELECT 'PARSE_ERROR' AS code, 't/' || n || '.md: no file ' || CASE WHEN k % 3 = 2 THEN 't/nowhere.md' ELSE '1.md' END AS message, line + 2 AS line FROM c, one WHERE k % 3 = 2 OR k % 3 = 0 AND there = 0")
def _lost(spark, d):
    return prose.read_prose(_prose(spark, d), ["t"]).findings.select("code", "message", "line")


@query("S32_globs", "SELECT 'log/' || event_type || '/' || event_id || '.md' AS file FROM events WHERE event_type LIKE 'c_i%' UNION ALL SELECT 'top.md'")
def _globs(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("log/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".md")).alias("file"))
    e = e.unionByName(spark.createDataFrame([("top.md",), ("top.mdx",), ("log/click/x/y.txt",)], "file string"))
    return files.matching(e, ["*.md", "**/c?i*/*.md"])


@query("S34_decoding", "SELECT 'f' || c_custkey AS file, 2 AS line, 'line is not valid UTF-8 at column 4, so it was not read: caf\\xe9' AS why FROM customer WHERE c_custkey % 4 = 0")
def _decoding(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"), F.when(F.col("c_custkey") % 4 == 0, F.unhex(F.lit("EFBBBF" + b"ok\r\ncaf".hex() + "E9" + b"\nend".hex()))).otherwise(F.lit("fine\n").cast("binary")).alias("content"))

    def read(rows, lines, faults):
        for n, why in faults:
            rows.finding(n, why)

    return files.scan(c, read).select("file", F.col("line").cast("int").alias("line"), F.expr("substring(message, length(file) + 3)").alias("why"))


def _sources(spark, d):
    """A Python, a Rust or a Go file for each nation, with a function for each of its customers."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("rows"))
    name = lambda x: F.concat(F.lit("test_"), x.cast("string"))
    python = _file(F.col("rows"), "import x\n\nclass T:\n    y = '''def test_no(): 0'''\n", lambda x: F.concat(F.lit("    def "), name(x), F.lit("(self):\n        def inner(): pass\n")))
    rust = _file(F.col("rows"), '// fn no() {}\nmod t {\n    const S: &str = "} fn no() {";\n', lambda x: F.concat(F.lit("    fn "), name(x), F.lit("() { if true { fn inner() {} } }\n")), "}\nimpl X { fn no() {} }\n")
    go = _file(F.col("rows"), "package t\n\nfunc (t *T) No() {}\n", lambda x: F.concat(F.lit("func "), name(x), F.lit("(t *T) { /* } */ }\n")))
    m = F.col("c_nationkey") % 3
    ending = F.when(m == 0, ".py").when(m == 1, ".rs").otherwise("_test.go")
    return c.select(F.concat(F.lit("src/f"), F.col("c_nationkey").cast("string"), ending).alias("file"), F.when(m == 0, python).when(m == 1, rust).otherwise(go).alias("content"))


_ADDRESS = "'src/f' || c_nationkey || CASE c_nationkey % 3 WHEN 0 THEN '.py::T::test_' WHEN 1 THEN '.rs::t::test_' ELSE '_test.go::test_' END"


@query("V26_source_missing", f"SELECT 'SOURCE_MISSING' AS code, {_ADDRESS} || (c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 10000000 ELSE 0 END) || CASE WHEN c_nationkey % 3 = 0 THEN '[1]' ELSE '' END AS node_id FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'SOURCE_MISSING', 'src/../x.md' UNION ALL SELECT 'SOURCE_MISSING', 'src/none.md'")
def _missing(spark, d):
    """A test for each customer; every fourth has a number that no function has. Two files are named that aren't there."""
    m, k = F.col("c_nationkey") % 3, F.col("c_custkey") + F.when(F.col("c_custkey") % 4 == 0, 10000000).otherwise(0)
    address = F.concat(F.lit("src/f"), F.col("c_nationkey").cast("string"), F.when(m == 0, ".py::T::test_").when(m == 1, ".rs::t::test_").otherwise("_test.go::test_"), k.cast("string"), F.when(m == 0, "[1]").otherwise(""))
    kind = F.when(m == 0, "py").when(m == 1, "rs").otherwise("go")
    c = table(spark, d, "customer")
    n = c.select(address.alias("id"), kind.alias("kind"), F.lit("f").alias("file"), F.lit(1).cast("long").alias("line"))
    n = n.unionByName(spark.createDataFrame([("src/../x.md", "doc", "f", 1), ("src/none.md", "doc", "f", 2)], "id string, kind string, file string, line long"))
    return symbols.missing(n, _sources(spark, d), {"py": "pytest", "rs": "cargo", "go": "gotest", "doc": "file"}).select("code", "node_id")


@query("S29_issues", "SELECT md5(c_custkey::VARCHAR) AS id, '\"' || c_mktsegment || '\"' AS summary, CASE WHEN c_custkey % 3 = 0 THEN '\"done\"' ELSE '\"new\"' END AS state, CASE WHEN c_custkey % 5 = 0 THEN '[\"a,b/c\",\"z\"]' ELSE '[]' END AS tags, CASE WHEN c_custkey % 2 = 0 THEN md5((c_custkey + 1)::VARCHAR) END AS depends, (c_custkey % 7 = 0)::INTEGER AS faults FROM customer")
def _issues(spark, d):
    """An issue for each customer: a third have a state, a fifth tags, half a dependency, and a seventh a file that no issue has."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    id_ = F.md5(k.cast("string").cast("binary"))
    entry = lambda path, text, when=F.lit(True): F.when(when, F.struct(F.concat_ws("/", id_, path).alias("file"), F.encode(text, "utf-8").alias("content")))
    many = F.array(
        entry(F.lit("description"), F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" \nmore"))), entry(F.lit("state"), F.lit("done\n"), k % 3 == 0), entry(F.lit("tags/z"), F.lit(""), k % 5 == 0),
        entry(F.lit("tags/a,0b,1c"), F.lit(""), k % 5 == 0), entry(F.concat(F.lit("dependencies/"), F.md5((k + 1).cast("string").cast("binary"))), F.lit(""), k % 2 == 0), entry(F.lit("odd"), F.lit(""), k % 7 == 0),
    )
    r = issues.read_issues(c.select(F.explode(F.array_compact(many)).alias("f")).select("f.*"))
    n = r.nodes.select("id", *(F.col("attrs")[a].alias(a) for a in ("summary", "state", "tags")))
    n = n.join(r.edges.select(F.col("src").alias("id"), F.col("tgt").alias("depends")), "id", "left")
    return n.join(r.findings.groupBy(F.col("node_id").alias("id")).agg(F.count("*").cast("int").alias("faults")), "id", "left").na.fill(0, ["faults"])


def _specs(spark, d):
    """A specification for each nation with a requirement for each customer, and a test source that cites every customer twice in a row, then once after a gap."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("rows"))
    name = F.col("c_nationkey").cast("string")
    spec = _file(F.col("rows"), "# Spec\n", lambda x: F.concat(F.lit("### Requirement: R "), x.cast("string"), F.lit("\nIt shall.\n#### Scenario: a\n#### Scenario: b\nVerified by x\n")), "## End\ntext\n")
    tests = _file(F.col("rows"), "", lambda x: F.concat(F.lit("# Requirement: gone\n\n# Requirement: n"), F.col("c_nationkey").cast("string"), F.lit("/R "), x.cast("string"), F.lit("\n# Requirement: other\ndef test_"), x.cast("string"), F.lit("():\n    pass\n")))
    return c.select(F.concat(F.lit("specs/n"), name, F.lit("/spec.md")).alias("file"), spec).unionByName(c.select(F.concat(F.lit("tests/t"), name, F.lit(".py")).alias("file"), tests))


@query("S31_specs", """
SELECT 'contains' AS kind, 'n' || c_nationkey AS src, 'n' || c_nationkey || '/R ' || c_custkey AS tgt FROM customer
UNION ALL SELECT 'verifies', 'tests/t' || c_nationkey || '.py::test_' || c_custkey, unnest(['n' || c_nationkey || '/R ' || c_custkey, 'other']) FROM customer""")
def _spec_edges(spark, d):
    return specs.read_specs(_specs(spark, d)).edges.select("kind", "src", "tgt")


@query("S31_requirements", "SELECT 'n' || c_nationkey || '/R ' || c_custkey AS id, 'R ' || c_custkey AS title, '2' AS scenarios, 'It shall.' || chr(10) || '#### Scenario: a' || chr(10) || '#### Scenario: b' AS body FROM customer")
def _requirements(spark, d):
    n = specs.read_specs(_specs(spark, d)).nodes.filter("kind = 'requirement'")
    return n.select("id", text_of(F.col("attrs")["title"]).alias("title"), F.col("attrs")["scenarios"].alias("scenarios"), text_of(F.col("attrs")["body"]).alias("body"))
