"""The corpus pipeline: toxicity, line dedup, n-gram near duplicates, benchmark decontamination, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from registra.llm.common import Scratch, few

#: SQL can't train the classifier of the first stage; tests hold run() against plain versions of all stages, with the fitted weights given.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go. The model is fitted on the labelled documents among those given; rows without an id teach nothing and are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    return toxicity.score(docs, model).filter("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars is counted anew. A document with nothing left stays, empty; rows without an id neither count nor lose lines."""
    fresh = {"doc_id": F.col("id").alias("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    rest = tuple(c for c in docs.columns if c not in fresh)
    kept = line_dedup.dedup_lines(docs.select(F.col("doc_id").alias("id"), *(c for c in docs.columns if c not in ("doc_id", "n_chars", "id"))), carry=tuple(c for c in rest if c != "id"))
    return kept.select(*(fresh.get(c, F.col(f"row.`{c}`")) for c in docs.columns if c != "id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts without words and rows without an id stay."""
    links = ngram_join.jaccard_links(docs.select(F.col("doc_id").alias("id"), "text"))
    gone = Scratch(spark).cut(links.filter("id <> component_id").select("id").distinct())
    return docs.join(few(gone), docs["doc_id"] == gone["id"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, with or without an id."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; rows without an id are mixed like others."""
    return mixing.mix(docs.select(F.col("doc_id").alias("id"), "source", "text")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            after = scratch.cut(after)
            scratch.drop(docs)
        docs = after
    return docs
