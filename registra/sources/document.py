"""Interface documents: JSON texts of nodes, edges, pathways and findings, read into a register with DataFrame operations.

A document is one text; a register may be dealt over many of them, which are read as one, in their order. A document that breaks the
contract raises ContractError, naming its faults; a fault of the register itself (a repeated id) is a finding."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Register
from ..shared import cut

#: Fixed values of the interface: its versions, and the keys of each object.
VERSIONS = ("1.0", "1.1", "1.2", "1.3", "1.4")
KEYS = {
    "document": ("interface_version", "contract_version", "nodes", "edges", "pathways", "findings", "issues"),
    "node": ("id", "kind", "attrs", "provenance", "attr_provenance"),
    "edge": ("src", "tgt", "kind", "attrs", "provenance", "declared_by"),
    "pathway": ("name", "order", "current"),
    "finding": ("severity", "code", "message", "provenance", "node_id", "state"),
    "provenance": ("file", "line"),
}
SEVERITIES = ("error", "warning", "info", "hint")
MOST_LINE = (1 << 32) - 1
#: Entries of a document that its place leaves room for in ord.
_ROOM = 1 << 32


class ContractError(ValueError):
    """A document that can't be trusted, so there is no register to report on."""


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def type_name(v: Column) -> Column:
    """null, bool, int, float, string, list or object; null for an absent value."""
    t = F.schema_of_variant(v)
    whole = t.rlike(r"^DECIMAL\((19|2[0-9]|3[0-9]),0\)$")  # beyond a long; a shorter one without decimals was written with a point
    return F.when(t == "VOID", "null").when(t == "BOOLEAN", "bool").when((t == "BIGINT") | whole, "int").when(t == "STRING", "string").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object").when(v.isNotNull(), "float")


def _text(v: Column) -> Column:
    return F.when(type_name(v) == "string", F.try_variant_get(v, "$", "string"))


def literal_of(v: Column) -> Column:
    """Canonical JSON text: keys sorted, strings escaped one way, a float never spelt as an int."""
    j = F.to_json(v)
    return F.when((type_name(v) == "float") & j.rlike(r"\A-?[0-9]+\z"), F.concat(j, F.lit(".0"))).otherwise(j)


def attrs_of(v: Column) -> Column:
    return F.transform_values(_object(v), lambda _, x: literal_of(x))


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _unknown(keys: Column, what: str) -> Column:
    """Names the keys of an object that its kind hasn't."""
    keys = F.array_sort(F.array_except(keys, F.array(*map(F.lit, KEYS[what]))))
    return F.when(F.size(keys) > 0, _say("unknown keys ", F.array_join(keys, ", ")))


def _must_be(m: Column, key: str, kind: str, optional: bool = False) -> Column:
    t = F.coalesce(type_name(m[key]), F.lit("nothing"))
    wrong = (t != kind) & (t != "nothing") if optional else t != kind
    return F.when(wrong, _say(f"'{key}' must be {kind}, got ", t))


def _provenance(v: Column, where: str = "provenance") -> list[Column]:
    m, line = _object(v), _object(v)["line"]
    n = F.try_variant_get(line, "$", "decimal(38,0)")
    return [
        F.when(m.isNull(), F.lit(f"'{where}' must be object")),
        F.when(m.isNotNull(), _say(f"{where}: ", _unknown(F.map_keys(m), "provenance"))),
        F.when(m.isNotNull(), _say(f"{where}: ", _must_be(m, "file", "string"))),
        F.when(m.isNotNull(), _say(f"{where}: ", _must_be(m, "line", "int"))),
        F.when((type_name(line) == "int") & ((n < 0) | (n > MOST_LINE)), F.lit(f"{where}: 'line' must be from 0 to {MOST_LINE}")),
    ]


def _faults_of(m: Column, what: str, n_nodes: Column) -> list[Column]:
    out = [F.when(m.isNull(), F.lit("must be an object")), _unknown(F.map_keys(m), what)]
    if what == "node":
        away = F.map_filter(_object(m["attr_provenance"]), lambda k, _: ~F.coalesce(F.map_contains_key(_object(m["attrs"]), k), F.lit(False)))
        bad = F.filter(F.map_entries(_object(m["attr_provenance"])), lambda e: F.coalesce(*_provenance(e.value)).isNotNull())
        out += [_must_be(m, "id", "string"), _must_be(m, "kind", "string"), _must_be(m, "attrs", "object"), _must_be(m, "attr_provenance", "object", True), *_provenance(m["provenance"])]
        out += [F.when(F.size(away) > 0, _say("attr_provenance names what attrs don't hold: ", F.array_join(F.array_sort(F.map_keys(away)), ", "))), F.when(F.size(bad) > 0, F.lit("attr_provenance isn't a provenance"))]
    elif what == "edge":
        by = F.try_variant_get(m["declared_by"], "$", "decimal(38,0)")
        out += [*(_must_be(m, k, "string") for k in ("src", "tgt", "kind")), _must_be(m, "attrs", "object", True), _must_be(m, "declared_by", "int", True), *_provenance(m["provenance"])]
        out.append(F.when((type_name(m["declared_by"]) == "int") & ((by < 0) | (by >= n_nodes)), F.lit("'declared_by' names no node entry")))
    elif what == "pathway":
        order = F.transform(_list(m["order"]), _text)
        out += [_must_be(m, "name", "string"), _must_be(m, "order", "list"), _must_be(m, "current", "string"), F.when(F.exists(order, lambda x: x.isNull()), F.lit("'order' must be a list of strings"))]
        out += [F.when(F.size(F.array_distinct(order)) < F.size(order), F.lit("'order' repeats a position")), F.when(~F.array_contains(order, _text(m["current"])), F.lit("'current' isn't in 'order'"))]
    else:
        out += [*(_must_be(m, k, "string") for k in ("severity", "code", "message")), *(_must_be(m, k, "string", True) for k in ("node_id", "state")), *_provenance(m["provenance"])]
        out.append(F.when(~_text(m["severity"]).isin(*SEVERITIES), F.lit("unknown severity")))
    return out


#: JSON as try_parse_json takes it.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_LISTS = ("nodes", "edges", "pathways", "findings", "issues")


def items_of(text: Column, key: str) -> Column:
    """The list under a key, each item a variant of its own, so no variant holds a whole document, however long; null if there is none."""
    return F.from_json(text, f"{key} array<variant>", _STRICT)[key]


def texts_of(docs: DataFrame) -> DataFrame:
    """docs: doc (long, the order of documents), text -> the same two columns."""
    return docs.select(F.col("doc").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def entries_of(docs: DataFrame, items: Column, *more: Column) -> DataFrame:
    """A row (at, m) for each item; more columns are worked out once a document, before its items become rows, as is all else that needs the text.

    Rows are dealt out, as a document of any length comes from one task."""
    few = docs.select(items.alias("items"), *more)
    out = few.select(*(c for c in few.columns if c != "items"), F.posexplode("items").alias("at", "e"))
    return out.repartition(*(c for c in out.columns if c != "e")).withColumn("m", _object(F.col("e"))).drop("e")


def _entries(docs: DataFrame, key: str) -> DataFrame:
    """(doc, n_nodes, at, m): the objects under a key with their places; findings are read from either of their names."""
    items = items_of(F.col("text"), key)
    if key == "findings":
        items = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(items_of(F.col("text"), "issues"))
    n_nodes = F.coalesce(F.size(items_of(F.col("text"), "nodes")), F.lit(0)) if key == "edges" else F.lit(None).cast("int")
    return entries_of(docs, items, F.col("doc"), n_nodes.alias("n_nodes"))


def faults(docs: DataFrame) -> DataFrame:
    """Where documents break the contract: doc, place, fault. None for good documents; null, empty and blank texts are no documents."""
    docs = texts_of(docs)
    schema = ", ".join(["interface_version variant", "contract_version variant", *(f"{k} array<variant>" for k in _LISTS)])
    read = docs.select("doc", "text", F.json_object_keys("text").alias("keys"), F.from_json("text", schema, _STRICT).alias("s"))
    s, keys = F.col("s"), F.col("keys")
    lost = [F.array_contains(keys, k) & s[k].isNull() for k in ("interface_version", "contract_version", *_LISTS)]
    sound = keys.isNotNull() & (F.size(F.array_distinct(keys)) == F.size(keys)) & ~reduce(lambda a, b: a | b, lost)
    counts = [F.coalesce(F.size(s[k]), F.lit(0)).alias(f"n_{k}") for k in ("findings", "issues")]
    read = read.select("doc", "keys", F.coalesce(sound, F.lit(False)).alias("sound"), F.coalesce(s["interface_version"], s["contract_version"]).alias("version"), *counts, F.when(~F.coalesce(sound, F.lit(False)), F.col("text")).alias("odd"))
    p = read.withColumn("v", F.try_parse_json("odd")).withColumn("top", _object(F.col("v")))  # only documents that aren't as they should be are read as a whole
    top, sound, v = F.col("top"), F.col("sound"), F.col("v")
    keys = F.coalesce(F.map_keys(top), F.when(sound, F.col("keys")))
    version = F.when(sound, F.col("version")).otherwise(F.coalesce(top["interface_version"], top["contract_version"]))
    known = [F.when(~sound & v.isNull(), F.lit("not JSON, or nothing at all")), F.when(v.isNotNull() & top.isNull(), F.lit("must be an object")), _unknown(keys, "document")]
    known.append(F.when(keys.isNotNull() & ~F.coalesce(_text(version).isin(*VERSIONS), F.lit(False)), _say("unsupported interface version ", F.coalesce(F.to_json(version), F.lit("(none)")), "; supported: " + ", ".join(VERSIONS))))
    known += [F.when(top.isNotNull(), _must_be(top, k, "list", True)) for k in _LISTS]
    known.append(F.when((F.col("n_findings") > 0) & (F.col("n_issues") > 0), F.lit("'findings' and 'issues' are aliases, and both hold entries")))
    out = p.select("doc", F.lit("document").alias("place"), F.explode(F.array_compact(F.array(*known))).alias("fault"))
    for what in ("node", "edge", "pathway", "finding"):
        e = _entries(docs, f"{what}s")
        found = F.array_compact(F.array(*_faults_of(F.col("m"), what, F.col("n_nodes"))))
        out = out.unionByName(e.select("doc", _say(f"{what} ", F.col("at").cast("string")).alias("place"), F.explode(found).alias("fault")))
    return out


def check(docs: DataFrame, shown: int = 20) -> None:
    """Raises ContractError with the first faults."""
    found = faults(docs).orderBy("doc", "place", "fault").limit(shown + 1).collect()
    if found:
        raise ContractError("; ".join(f"document {r.doc}, {r.place}: {r.fault}" for r in found[:shown]) + ("; and more" if len(found) > shown else ""))


def _at(m: Column) -> list[Column]:
    return [_text(_object(m["provenance"])["file"]).alias("file"), F.try_variant_get(_object(m["provenance"])["line"], "$", "bigint").alias("line")]


def declared_nodes(p: DataFrame) -> DataFrame:
    m = F.col("m")
    where = F.transform_values(_object(m["attr_provenance"]), lambda _, x: F.struct(*_at(F.create_map(F.lit("provenance"), x))))
    return _entries(p, "nodes").select(_text(m["id"]).alias("id"), _text(m["kind"]).alias("kind"), attrs_of(m["attrs"]).alias("attrs"), *_at(m), (F.col("doc") * _ROOM + F.col("at")).alias("ord"), where.alias("attr_prov"))


def declared_edges(p: DataFrame) -> DataFrame:
    m = F.col("m")
    by = (F.col("doc") * _ROOM + F.try_variant_get(m["declared_by"], "$", "bigint")).alias("declared_by")
    return _entries(p, "edges").select(*(_text(m[k]).alias(k) for k in ("src", "tgt", "kind")), F.coalesce(attrs_of(m["attrs"]), F.create_map().cast("map<string,string>")).alias("attrs"), *_at(m), (F.col("doc") * _ROOM + F.col("at")).alias("ord"), by)


def settle(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first declaration of each id, the edges that no repeat declared, and a finding for each repeat.

    The finding says where the first lies, how many of the repeat's edges weren't read, and how many from its id were read
    though none says which entry declared them."""
    w = Window.partitionBy("id").orderBy("ord")
    n = nodes.withColumn("_at", F.row_number().over(w)).withColumn("_first", F.first(F.struct("file", "line")).over(w))
    repeats = n.filter("_at > 1").select("id", "file", "line", "ord", "_first")
    kept = edges.join(repeats.select(F.col("ord").alias("declared_by")), "declared_by", "left_anti").select(*edges.columns)
    unread = edges.filter("declared_by is not null").groupBy(F.col("declared_by").alias("ord")).agg(F.count("*").alias("unread"))
    loose = edges.filter("declared_by is null").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("loose"))
    r = repeats.join(unread, "ord", "left").join(loose, "id", "left").na.fill(0, ["unread", "loose"])
    message = _say("duplicate node '", F.col("id"), "': first at ", F.col("_first.file"), ":", F.col("_first.line").cast("string"), F.when(F.col("unread") > 0, _say("; edges not read: ", F.col("unread").cast("string"))).otherwise(""), F.when(F.col("loose") > 0, _say("; edges read that no entry declares: ", F.col("loose").cast("string"))).otherwise(""))
    found = r.select(F.lit("error").alias("severity"), F.lit("PARSE_ERROR").alias("code"), message.alias("message"), F.col("id").alias("node_id"), "file", "line")
    return n.filter("_at = 1").drop("_at", "_first"), kept, found


def read(docs: DataFrame, checked: bool = True) -> Register:
    """docs: doc, text -> a register. checked: look for faults first, which reads the documents once more."""
    if checked:
        check(docs)
    p = texts_of(docs)
    nodes, edges, repeats = settle(declared_nodes(p), declared_edges(p))
    m = F.col("m")
    told = _entries(p, "findings").select(*(_text(m[k]).alias(k) for k in ("severity", "code", "message", "node_id")), *_at(m), _text(m["state"]).alias("state"))
    ways = _entries(p, "pathways").select("doc", "at", _text(m["name"]).alias("name"), F.transform(_list(m["order"]), _text).alias("positions"), _text(m["current"]).alias("current"))
    ways = {r["name"]: (r["positions"], r["current"]) for r in ways.orderBy("doc", "at").collect()}  # declarations, a few to a register
    return Register(nodes, edges, ways, repeats.unionByName(told, allowMissingColumns=True))


def from_files(spark, path: str) -> DataFrame:
    """(doc, text) of the document files under a path, in the order of their names."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    names = [r[0] for r in files.select("name").distinct().orderBy("name").collect()]
    order = spark.createDataFrame(list(enumerate(names)), "doc long, name string")
    return files.join(F.broadcast(order), "name").select("doc", "text")


def attr_location(attr: str) -> list[Column]:
    """Where an attribute was written: its own place, else the node's."""
    own = F.col("attr_prov")[attr]
    return [F.coalesce(own["file"], F.col("file")).alias("file"), F.coalesce(own["line"], F.col("line")).alias("line")]


def _rendered(r: Register) -> list[tuple[str, DataFrame]]:
    """(key, (ord, j)): the JSON text of each entry."""
    prov = F.struct("file", "line").alias("provenance")
    raw = lambda m: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.to_json(F.array(e.key)).substr(F.lit(2), F.length(F.to_json(F.array(e.key))) - 2), F.lit(":"), e.value)), ","), F.lit("}"))
    with_attrs = lambda j: F.concat(j.substr(F.lit(1), F.length(j) - 1), F.lit(',"attrs":'), raw(F.col("attrs")), F.lit("}"))
    n = r.nodes.select("ord", with_attrs(F.to_json(F.struct("id", "kind", prov))).alias("j"))
    e = r.edges.select("ord", with_attrs(F.to_json(F.struct("src", "tgt", "kind", prov))).alias("j"))
    f = None if r.findings is None else r.findings.select(F.lit(0).cast("long").alias("ord"), F.to_json(F.struct("severity", "code", "message", "node_id", prov)).alias("j"))
    return [(k, df) for k, df in (("nodes", n), ("edges", e), ("findings", f)) if df is not None]


def _head(r: Register) -> str:
    ways = json.dumps([{"name": k, "order": o, "current": c} for k, (o, c) in r.pathways.items()])
    return f'{{"interface_version":"{VERSIONS[-1]}","pathways":{ways}'


def write(r: Register) -> DataFrame:
    """The register as one interface document: a row with column text, so one task's memory. Entries come in the order of ord."""
    parts = [(k, df.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "j"))), lambda x: x.j), ",").alias(k))) for k, df in _rendered(r)]
    one = reduce(lambda a, b: a.join(b, "one"), (df.withColumn("one", F.lit(1)) for _, df in parts))  # one row each
    body = [x for k, _ in parts for x in (F.lit(f',"{k}":['), F.col(k), F.lit("]"))]
    return one.select(F.concat(F.lit(_head(r)), *body, F.lit("}")).alias("text"))


def write_many(r: Register, most: int = 20_000) -> DataFrame:
    """The register dealt over documents of at most so many entries, for registers beyond one task's memory: doc (their order), text. The first has the pathways, then come nodes, edges and findings in the order of ord.

    The result is written once, to the shared folder, since a second sort might deal entries in other places."""
    parts = _rendered(r)
    each = reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("k"), "ord", "j") for i, (_, df) in enumerate(parts, 1)))
    each = each.repartitionByRange("k", "ord", "j").sortWithinPartitions("k", "ord", "j").withColumn("m", F.monotonically_increasing_id())
    task, row = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    doc = F.shiftleft(F.col("k").cast("long"), 28) + F.shiftleft(task, 14) + F.floor(row / most)  # 2 bits, 14 for tasks, 14 for documents of a task
    texts = each.groupBy("k", doc.alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "j"))), lambda x: x.j), ",").alias("all"))
    key = reduce(lambda c, i: c.when(F.col("k") == i, parts[i - 1][0]), range(1, len(parts) + 1), F.when(F.lit(False), ""))
    texts = texts.select("doc", F.concat(F.lit(f'{{"interface_version":"{VERSIONS[-1]}","'), key, F.lit('":['), "all", F.lit("]}")).alias("text"))
    first = r.nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("doc"), F.lit(_head(r) + "}").alias("text"))
    return cut(first.unionByName(texts))
