"""Exact token statistics from a histogram of encoded lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prefix_sums

#: GPT-2's published pre-tokenisation pattern, a fixed value of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs: text -> n_tokens (long), a row for each row. Null counts as empty, 0 tokens. The vocabulary file lies at the same path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(e.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def length_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each encoded length that occurs, which answers questions on every context limit.

    Returns n_tokens, n_docs (of just that length), docs_upto and tokens_upto (of at most that length), docs_over,
    truncated_tokens (all documents' tokens if each is cut at that length), quantile (share of documents of at most that length). For a limit
    between two lengths l < limit < m: docs_upto of l, and truncated_tokens of l plus (limit - l) * docs_over of l. No documents give no rows; null and empty texts have length 0."""
    scratch = Scratch(docs.sparkSession)
    hist = scratch.cut(encoded_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    total = F.broadcast(hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all_tokens")))
    hist = hist.withColumn("mass", F.col("n_docs") * F.col("n_tokens")).withColumn("cell", F.floor(F.col("n_tokens") / 1024)).withColumn("zero", F.lit(0))
    sums = prefix_sums(hist, ["zero"], ["n_tokens"], "cell", {"docs_below": "n_docs", "tokens_below": "mass"}).join(total.withColumn("zero", F.lit(0)), "zero")
    upto, tokens = F.col("docs_below") + F.col("n_docs"), F.col("tokens_below") + F.col("mass")
    return sums.select("n_tokens", "n_docs", upto.alias("docs_upto"), tokens.alias("tokens_upto"), (F.col("all_docs") - upto).alias("docs_over"), (tokens + (F.col("all_docs") - upto) * F.col("n_tokens")).alias("truncated_tokens"), (upto / F.col("all_docs")).alias("quantile"), "all_docs", "all_tokens")


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """What a context limit means, from the table alone: docs_over, truncated_tokens, lost_tokens; one row, none for an empty table."""
    below = table.filter(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "docs_over", "truncated_tokens")).alias("b")).select("b.*")
    every = table.agg(F.max("all_docs").alias("d"), F.max("all_tokens").alias("t")).filter("d is not null")
    j = every.withColumn("k", F.lit(1)).join(F.broadcast(below.withColumn("k", F.lit(1))), "k", "left")
    over = F.coalesce("docs_over", "d")
    cut = F.coalesce("truncated_tokens", F.lit(0)) + (F.lit(limit) - F.coalesce("n_tokens", F.lit(0))) * over
    return j.select(over.alias("docs_over"), cut.alias("truncated_tokens"), (F.col("t") - cut).alias("lost_tokens"))
