"""Language ID by rank-order profiles of n-grams and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, pieces

ORDERS, TOP = 3, 300
#: Texts per language that a profile is learnt from, chosen by a hash of the id; a documented bound for the fit alone.
FIT_TEXTS = 4000
#: Different n-grams that a task counts before it passes them on.
HELD = 500_000
_K = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray | None:
    """Hashes of all runs of 1 to ORDERS letters, case ignored, other characters as one border mark; None without a letter. A mark alone isn't counted."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    letter = np.r_[False, letter, False]
    c = np.where(letter, np.r_[np.uint32(0), c, np.uint32(0)], 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c, letter = c[keep].astype(np.uint64), letter[keep]
    out, acc = [c[letter]], c
    for n in range(2, ORDERS + 1):
        acc = acc[: len(acc) - 1] * _K + c[n - 1 :]
        if not len(acc):
            break
        out.append(acc + np.uint64(n))
    return mix64(np.concatenate(out))


def profile(g: np.ndarray) -> np.ndarray:
    """The TOP most frequent n-grams, most frequent first, ties by hash."""
    keys, n = np.unique(g, return_counts=True)
    return keys[np.lexsort((keys, -n))[:TOP]]


def add_counts(old: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by sorted key, of both together."""
    if old is None:
        return keys, n
    every, at = np.unique(np.r_[old[0], keys], return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, at, np.r_[old[1], n])
    return every, total


def learn(docs: DataFrame, fit_texts: int = FIT_TEXTS) -> list[tuple[str, np.ndarray]]:
    """docs: id, text, lang -> profiles by language. Rows without text or lang teach nothing.

    About fit_texts texts of each language, chosen by a hash of their ids, are counted, whole, on the executors in pieces; a row a language and then
    TOP rows a language come back to the driver, so memory there grows with the number of different lang values alone. Repeated rows count each time; ties in frequency go by hash."""
    docs = docs.select("id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return []
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, fit_texts / r["n"])) for r in sizes], "lang string, rate double")
    part = docs.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            at, langs = 0, b.column(1).to_pylist()
            for texts in pieces(b.column(0).to_pylist()):
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(texts, langs[at : at + len(texts)], strict=True):
                    if (g := grams(text)) is not None:
                        by.setdefault(lang, []).append(g)
                at += len(texts)
                for lang, all_ in by.items():
                    held[lang] = add_counts(held.get(lang), *np.unique(np.concatenate(all_), return_counts=True))
                if sum(len(k) for k, _ in held.values()) > HELD:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = part.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= TOP)
    by: dict[str, list] = {}
    for r in sorted(ranked.select("lang", "gram", "rank").collect(), key=lambda r: (r["lang"], r["rank"])):
        by.setdefault(r["lang"], []).append(r["gram"])
    return [(k, np.array(v, np.int64).view(np.uint64)) for k, v in sorted(by.items())]


def distances(p: np.ndarray, profiles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Out-of-place distance of a profile to each (sorted n-grams, their ranks): how far each n-gram is from its rank there, TOP if it isn't there."""
    rank, out = np.arange(len(p)), []
    for keys, ranks in profiles:
        at = np.minimum(np.searchsorted(keys, p), len(keys) - 1)
        out.append(np.where(keys[at] == p, np.abs(ranks[at] - rank), TOP).sum())
    return np.array(out)


def predict(docs: DataFrame, profiles: list[tuple[str, np.ndarray]]) -> DataFrame:
    """docs: id, text -> id, lang_pred, score, a row for each row. The nearest profile wins, ties the first by name; score is the share of the second-nearest distance in both (1 if only one language is known). Null texts, texts without a letter, and all texts where nothing was learnt are und with score 0."""
    names = [k for k, _ in profiles]
    sorted_ = [(v[o := np.argsort(v)], o) for _, v in profiles]
    held = docs.sparkSession.sparkContext.broadcast((names, sorted_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = held.value
        for b in batches:
            lang, score = [], []
            for text in b.column(1).to_pylist():
                g = grams(text)
                if g is None or not names:
                    lang.append("und")
                    score.append(0.0)
                    continue
                d = distances(profile(g), known)
                best = int(np.argmin(d))
                lang.append(names[best])
                second = np.partition(d, 1)[1] if len(d) > 1 else 1
                score.append(float(second / (second + d[best])) if len(d) > 1 and second + d[best] else 1.0 if len(d) == 1 else 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
