"""Line dedup: lines that many documents share are dropped from all of them but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, ascii_lower, few


def line_key(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, rf"\A{SPACE}+|{SPACE}+\z", ""))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    r"""Drops repeated lines and reassembles the rest by position.

    docs: id, text; of other columns those in carry come along in a struct, row. A text is split at \n; null and empty texts are one empty line. A line's key is the
    line stripped and lower-cased (ASCII); keys of at least min_chars code points that at least min_docs different ids hold
    lose all their lines except in the largest id that holds them. Returns a row for each row: id, n_lines (before),
    n_dropped, text (kept lines joined by \n, never null). Rows that repeat an id count as one document and lose or keep alike; rows without an id neither count nor lose lines."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"))
    lines = F.split("text", "\n", -1)
    # A long key is known by two hashes with different salts: 128 bits, in two narrow columns.
    hashed = F.transform(F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars), lambda k: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g")))
    held = docs.filter("id is not null").select("id", F.explode(F.array_distinct(hashed)).alias("k")).select("id", "k.h", "k.g")
    common = held.groupBy("h", "g", "id").agg(F.lit(1).alias("one")) if _repeats(docs) else held
    common = scratch.cut(common.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).select("h", "g", "keeper"))
    losers = held.join(few(common), ["h", "g"]).filter("id <> keeper").groupBy("id").agg(F.collect_set(F.struct("h", "g")).alias("lost"))
    losers = scratch.cut(losers)
    keyed = F.transform(lines, lambda x: F.struct(x.alias("line"), line_key(x).alias("k")))
    kept = F.filter(keyed, lambda x: (F.char_length(x.k) < min_chars) | ~F.array_contains(F.col("lost"), F.struct(F.xxhash64(x.k).alias("h"), F.xxhash64(F.lit(1), x.k).alias("g"))))
    kept = F.when(F.col("lost").isNull(), lines).otherwise(F.transform(kept, lambda x: x.line))
    out = docs.join(losers, "id", "left").select("id", "row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("id", "row", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _repeats(docs: DataFrame) -> bool:
    """Whether an id has several rows; then an id's lines are first brought together."""
    return bool(docs.filter("id is not null").groupBy("id").count().filter("count > 1").limit(1).count())
