"""Pieces that several operators share: words, hashes, shared scratch tables, scalable prefix sums."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The separators of words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side of a join of at most so many narrow rows (an id and a few numbers) is broadcast after it was counted; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000

_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit over all output bits."""
    x = x + _K
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Texts are hashed in pieces of about so many characters, which bounds the words held as Python objects.
PIECE = 1 << 20


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a text, A-Z lower-cased; bytes.split() cuts at just the bytes of SPACE."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(raw) <= PIECE:
        words = raw.split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out, at = [], 0
    while at < len(raw):  # a piece ends before a space
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        words = raw[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out)


def pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about PIECE characters together; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        n = len(t or "")
        if run and held + n > PIECE:
            yield run
            run, held = [], 0
        run.append(t)
        held += n
    if run:
        yield run


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs of width words, sorted, one text after another, and how many each has.

    A shorter text is one run, hashed apart from others; a text without words has none."""
    each = [word_hashes(t) for t in texts]
    n = np.array([len(w) for w in each], np.int64)
    h = np.concatenate([*each, np.zeros(0, np.uint64)])
    acc, size = h[:0], np.maximum(n - width + 1, 0)
    if len(h) >= width:
        doc = np.repeat(np.arange(len(n)), n)
        acc = h[: len(h) - width + 1]
        for i in range(1, width):
            acc = acc * _K + h[i : len(h) - width + 1 + i]
        acc = mix64(acc)[doc[: len(doc) - width + 1] == doc[width - 1 :]]
    few_words = np.flatnonzero((n > 0) & (n < width))
    if len(few_words):
        whole = []
        for d in few_words:
            x = np.array([n[d]], np.uint64)
            for w in each[d]:
                x = mix64(x * _K + w)
            whole.append(x[0])
        acc = np.insert(acc, (np.cumsum(size) - size)[few_words], np.array(whole, np.uint64))
        size[few_words] = 1
    end = np.cumsum(size)
    for a, b in zip((end - size).tolist(), end.tolist(), strict=True):
        if b - a > 1:
            acc[a:b].sort()
    first = np.ones(len(acc), bool)
    first[1:] = acc[1:] != acc[:-1]
    starts = (end - size)[size > 0]
    first[starts] = True
    total = np.r_[0, np.cumsum(first)]
    return acc[first], total[end] - total[end - size]


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of width words."""
    return shingle_sets([text], width)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    """Number of words without building them: starts of runs of other characters."""
    t = F.coalesce(c, F.lit(""))
    return F.regexp_count(t, F.lit(NOT_SPACE)).cast("long")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


class Scratch:
    """Tables in the folder that all executors share (spark.checkpoint.dir).

    cut() writes a frame as Parquet and reads it back, so later stages don't depend on the executors that made it.
    A folder of its own is made only where the setting is absent, and only in local mode."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="registra-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/registra-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Lets Spark remove the shuffle files of frames that are gone, which it does as the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no returned frame reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            if path := df.__dict__.pop("_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a frame of narrow rows for broadcast only if it was counted and is small; else it is returned as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], cell: str, sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums within keys in the order (cell, *order), without one task for a hot key.

    cell: a column that follows the order and splits each key into cells; each cell is summed on its own, and only the
    cells' totals are added up along the key. sums: new column -> summed column."""
    inner = Window.partitionBy(*keys, cell).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(cell)
    totals = df.groupBy(*keys, cell).agg(*(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()))
    before = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(cell).alias("_cell"), *((F.sum(f"_t_{k}").over(outer) - F.col(f"_t_{k}")).alias(f"_b_{k}") for k in sums))
    out = df.select("*", *((F.sum(v).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(v)).alias(f"_i_{k}") for k, v in sums.items()))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(cell) == F.col("_cell")]
    joined = out.join(before, on)
    return joined.select(*df.columns, *((F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums))
