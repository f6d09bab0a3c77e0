"""Suggested edges: the texts that nodes offer, cut into chunks, and the best targets of each source that has no edge yet."""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import text_of
from ..model import Profile, Register

VERSIONS = ("1.0", "1.1")
ENTRY = "src string, tgt string, kind string, score double, basis string"


def texts_of(p: Profile) -> Column:
    """The strings that a node offers by its kind: its text attributes in order, or its summary if the kind names none; blank ones left out."""
    kinds = []
    for k, nk in p.node_kinds.items():
        names = nk.texts if nk.texts is not None else (nk.summary,) if nk.summary else ()
        found = F.array(*(text_of(F.col("attrs")[a]) for a in names)) if names else F.array().cast("array<string>")
        kinds.append((k, F.filter(found, lambda t: t.isNotNull() & (F.trim(t) != ""))))
    empty = F.array().cast("array<string>")
    return reduce(lambda c, x: c.when(F.col("kind") == x[0], x[1]), kinds, F.when(F.lit(False), empty)).otherwise(empty)


def chunks_of(text: Column, prefix: str | None) -> Column:
    """A partition of a text before each line that starts with the prefix: joined, the parts are the text, save blank ones. Lines end at a line feed alone."""
    if not prefix:
        return F.array(text)
    literal = r"\Q" + prefix.replace(r"\E", r"\E\\E\Q") + r"\E"
    parts = F.filter(F.split(text, rf"(?<=\n)(?={literal})"), lambda t: F.regexp_replace(t, r"\s+", "") != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def candidates(nodes: DataFrame, edges: DataFrame, p: Profile, kind: str) -> tuple[DataFrame, DataFrame]:
    """nodes: every declaration, repeats included -> (sources, targets), each (id, kind, text or chunks).

    Sources are nodes of a source kind without an edge of the kind; an id that repeats counts with its first declaration's kind, over the texts of all declarations of that kind in their order.
    Nodes without any text are left out."""
    if kind not in p.edge_kinds:
        raise ValueError(f"edge kind '{kind}' is not declared; declared: {', '.join(sorted(p.edge_kinds)) or '(none)'}")
    if not p.edge_kinds[kind]:
        raise ValueError(f"edge kind '{kind}' allows no pair")
    n = nodes.withColumn("_kind", F.first("kind").over(Window.partitionBy("id").orderBy("ord"))).filter("kind = _kind").withColumn("_texts", texts_of(p))
    of = lambda kinds: n.filter(F.col("kind").isin(*sorted(kinds)))
    merged = lambda df: df.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("ord", "_texts"))).alias("d"))
    whole = F.array_join(F.flatten(F.transform("d", lambda x: x["_texts"])), " \n")
    used = edges.filter(F.col("kind") == kind).select(F.col("src").alias("id")).distinct()
    sources = merged(of({s for s, _ in p.edge_kinds[kind]})).join(used, "id", "left_anti").select("id", "kind", whole.alias("text")).filter("text <> ''")
    t = of({t for _, t in p.edge_kinds[kind]})
    chunks = reduce(lambda c, k: c.when(F.col("kind") == k, F.flatten(F.transform("_texts", lambda x: chunks_of(x, p.node_kinds[k].chunk)))), p.node_kinds, F.when(F.lit(False), F.array().cast("array<string>")))
    targets = merged(t.withColumn("_texts", chunks)).select("id", "kind", F.flatten(F.transform("d", lambda x: x["_texts"])).alias("chunks")).filter("size(chunks) > 0")
    return sources, targets


#: Sources and chunks of targets that one matrix product compares, about.
BLOCK = (1_000, 4_000)


def _side(t: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by id as UTF-8: the different ids, where each starts, kinds, lengths (-1: null, or a null within), and rows scaled to norm 1, padded with zeros."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("id", "kind", "vec")), strict=True), key=lambda r: r[0].encode("utf-8", "surrogatepass"))
    size = np.array([-1 if v is None or None in v else len(v) for _, _, v in rows])
    m = np.zeros((len(rows), max(size.max(initial=0), 0)))
    for i, (_, _, v) in enumerate(rows):
        if size[i] > 0:
            m[i, : size[i]] = v
    norm = np.sqrt((m * m).sum(1))
    first = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]]
    return [rows[i][0] for i in first], np.array(first), np.array([r[1] for r in rows], object), size, m / np.where(norm == 0, 1, norm)[:, None]


def _best(allowed: frozenset, k: int):
    """A block of sources and one of targets -> each source's k best there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        src, tgt, score = [], [], []
        left, right = (t.filter(pc.and_(t.column("id").is_valid(), t.column("kind").is_valid())) for t in (left, right))
        if len(left) and len(right):
            (a, at_a, kind_a, size_a, va), (b, at_b, kind_b, size_b, vb) = _side(left), _side(right)
            width = min(va.shape[1], vb.shape[1])  # vectors of other lengths have no score
            x = va[:, :width] @ vb[:, :width].T
            x[np.isnan(x)] = np.inf
            x[(size_a[:, None] != size_b) | (size_a[:, None] < 0)] = -1e300
            for i in set(kind_a):
                for j in set(kind_b):
                    if (i, j) not in allowed:
                        x[np.ix_(kind_a == i, kind_b == j)] = -np.inf
            x = np.maximum.reduceat(np.maximum.reduceat(x, at_b, axis=1), at_a, axis=0)
            x = np.where(np.abs(x) <= 2, np.round(x, 6), x)
            place = {t: i for i, t in enumerate(b)}
            for i, s in enumerate(a):
                row = x[i]
                if s in place:
                    row[place[s]] = -np.inf
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                c = np.flatnonzero((row >= least) & (row > -np.inf))
                for j in c[np.argsort(-row[c], kind="stable")][:k]:
                    src.append(s)
                    tgt.append(b[j])
                    score.append(None if row[j] == -1e300 else np.nan if row[j] == np.inf else float(row[j]))
        return pa.table({"src": pa.array(src, pa.string()), "tgt": pa.array(tgt, pa.string()), "score": pa.array(score, pa.float64(), from_pandas=False)})

    return run


def rank(sources: DataFrame, targets: DataFrame, p: Profile, kind: str, k: int = 5) -> DataFrame:
    """sources: id, kind, vec; targets: id, kind, vec, a row for each chunk -> the k best targets of each source over the allowed pairs of kinds: src, tgt, kind, score, rank.

    A target scores as its best chunk; a source is never its own target; ties go by id. Vectors of norm 0 score 0.
    All pairs are compared, block against block as matrix products; of a block only the k best of each source go on. Scores are rounded to 6 digits before they are ranked."""
    n_s, n_t = (max(1, math.ceil(df.count() / size)) for df, size in ((sources, BLOCK[0]), (targets, BLOCK[1])))
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["id", "kind", "vec"]
    s = sources.select(cell(n_s).alias("x"), every(n_t).alias("y"), *cols)
    t = targets.select(every(n_s).alias("x"), cell(n_t).alias("y"), *cols)
    best = s.groupBy("x", "y").cogroup(t.groupBy("x", "y")).applyInArrow(_best(frozenset(p.edge_kinds[kind]), k), "src string, tgt string, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "tgt"))).filter(F.col("rank") <= k)
    return ranked.select("src", "tgt", F.lit(kind).alias("kind"), "score", "rank")


def unranked(sources: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row, n: the different sources that no suggestion names."""
    return sources.select("id").distinct().join(suggestions.select(F.col("src").alias("id")), "id", "left_anti").agg(F.count("*").alias("n"))


def ordered(suggestions: DataFrame) -> DataFrame:
    return suggestions.orderBy(F.desc("score"), "src", "tgt", "kind")


def read_suggestions(docs: DataFrame) -> DataFrame:
    """docs: text, each a suggestion document -> src, tgt, kind, score, basis. A malformed document or entry raises."""
    from ..sources.document import _STRICT, ContractError, _object, _text, entries_of, items_of, type_name

    known = "suggestions_version variant, version variant, suggestions array<variant>"
    p = docs.select(F.col("text").cast("string").alias("text")).select("text", F.json_object_keys("text").alias("keys"), F.from_json("text", known, _STRICT).alias("s"))
    m, version = F.col("m"), F.coalesce(F.col("s.suggestions_version"), F.col("s.version"))
    bad_doc = p.filter(F.col("keys").isNull() | (F.size(F.array_distinct("keys")) < F.size("keys")) | ~F.coalesce(_text(version).isin(*VERSIONS), F.lit(False)) | F.col("s.suggestions").isNull())
    e = entries_of(p, items_of(F.col("text"), "suggestions"))
    bad = e.filter(m.isNull() | F.exists(F.array(*(F.coalesce(type_name(m[k]) == "string", F.lit(False)) for k in ("src", "tgt", "kind"))), lambda x: ~x) | ~F.coalesce(type_name(m["score"]).isin("int", "float"), F.lit(False)))
    if bad_doc.limit(1).count():
        raise ContractError(f"a suggestion document needs a version of {', '.join(VERSIONS)} and a list of suggestions")
    if first := bad.limit(1).collect():
        raise ContractError(f"suggestion {first[0].at} is malformed")
    return e.select(*(_text(m[k]).alias(k) for k in ("src", "tgt", "kind")), F.try_variant_get(m["score"], "$", "double").alias("score"), _text(m["basis"]).alias("basis"))


def write_suggestions(suggestions: DataFrame, producer: str, n_unranked: int) -> str:
    """A suggestion document; suggestions are reviewed by people, so there are few."""
    rows = [r.asDict() for r in ordered(suggestions).toLocalIterator()]
    return json.dumps({"version": VERSIONS[-1], "producer": producer, "suggestions": [{k: r[k] for k in ("src", "tgt", "kind", "score")} for r in rows], "unranked": n_unranked})


def suggest_edges(r: Register, p: Profile, kind: str, vectors: DataFrame, k: int = 5) -> DataFrame:
    """candidates() and rank() with vectors (id, vec; several rows of an id are its chunks)."""
    sources, targets = candidates(r.nodes, r.edges, p, kind)
    return rank(sources.join(vectors, "id"), targets.join(vectors, "id"), p, kind, k)
