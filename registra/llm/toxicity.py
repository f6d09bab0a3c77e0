"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix64

BITS = 20
#: Labelled rows that weights are fitted on, chosen by a hash of the id; a documented bound for the fit alone.
FIT_ROWS = 20_000
#: Bytes of their features (4 each) that the fit holds, about; where the rows have more, fewer rows are taken by another hash.
FIT_BYTES = 256 << 20
#: How much a toxic row counts for one that isn't: texts labelled toxic may hold little that is.
TOXIC_WEIGHT = 3.0
_K = np.uint64(0x9E3779B97F4A7C15)
_TRIM = str.maketrans("", "", "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: words without punctuation, pairs of neighbours, and pairs that skip a word."""
    ws = (text or "").lower().translate(_TRIM).split()
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ws), np.uint64, len(ws))
    parts = [mix64(h)]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(mix64(h[:-gap] * _K + h[gap:] + np.uint64(gap)))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """Per-coordinate rates; l1 keeps weights at 0 until their gradients agree."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0
    epochs: int = 4

    def __post_init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha + self.l2)

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - y) * (TOXIC_WEIGHT if y else 1.0)
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g
        b, s = self.bias, ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z += g - s * b
        self.bias_n += g * g


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """docs: id, text; labels: id, toxic (0, 1) -> numbers of the weights that aren't 0, these weights, bias.

    About fit_rows labelled rows with text, and of very long ones as many as have FIT_BYTES of features, are learnt in the order of a hash of their ids, in one task that
    holds their feature numbers; rows that repeat an id count each, in the order of their features; null labels teach nothing, labels other than 1 count as 0, an id labelled twice counts as toxic if either says so. Without labelled rows there are no weights and the bias is 0.
    An executor that is lost starts the fit again with the same rows in the same order."""
    labels = labels.filter("toxic is not null and id is not null").groupBy("id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    n = labels.count()
    at = F.xxhash64(F.lit(11), "id")
    chosen = labels.filter(F.pmod(at, F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, fit_rows / max(n, 1)))))
    rows = docs.select("id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen), "id")
    scratch = Scratch(docs.sparkSession)
    made = scratch.cut(rows.select("id", "text", "y").mapInArrow(_featurize, "id long, y int, f binary"))
    held = made.agg(F.sum(F.octet_length("f"))).first()[0] or 0
    if held > FIT_BYTES:
        made = made.filter(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * FIT_BYTES / held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.frombuffer(f, np.int32), y) for b in batches for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = Ftrl()
        for _ in range(model.epochs):
            for i, y in seen:
                model.learn(i, y)
        w = model.weights(slice(None))
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i]), pa.array(np.r_[model.bias, w[i]])], ["i", "w"])

    one = made.repartition(1).sortWithinPartitions(at, "id", "f").select("y", "f")
    got = one.mapInArrow(run, "i long, w double").collect()
    bias = sum(r["w"] for r in got if r["i"] < 0)
    return np.array([r["i"] for r in got if r["i"] >= 0], np.int64), np.array([r["w"] for r in got if r["i"] >= 0]), bias


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [features(t).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.binary())], ["id", "y", "f"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs: text and any other columns -> row (a struct of all columns), score (0 to 1), predicted (1 if score >= 0.5), a row for each row. Null and empty texts get the bias's score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, bias = held.value
        dense = np.zeros(1 << BITS)
        dense[i] = w
        for b in batches:
            s = np.array([bias + dense[features(t)].sum() for t in b.column(0).field("text").to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
