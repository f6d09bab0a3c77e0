"""Document fingerprints: Merkle trees over paragraphs and sections, with DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, few

#: A paragraph (leaf) is a sentence or a line with what ends it. A longer one is cut past 64 code points after a word that ends with one of
#: a few letters, so that borders follow the text and not its place, at the latest after 256. Leaves cover the whole text.
PARAGRAPH = r"(?s)[^.!?\n]{1,63}[.!?\n]+|[^.!?\n]{64,255}?(?:[.!?\n]+|[dlmrsx] )|[^.!?\n]{1,256}[.!?\n]*|[.!?\n]+"
#: A section ends with a leaf whose hash ends with 0, at the latest with the 32nd, so an insertion moves no borders beyond its section.
SECTION = "(?:[0-9a-f]{31}[1-9a-f]){0,31}(?:[0-9a-f]{31}0)?"
#: Buckets of neighbouring ids at most; one of them holds a row in so many.
MOST_BUCKETS = 16_384


def tree(text: Column) -> Column:
    """Sections in order: hash (128 bits) and the first 8 digits of each leaf's hash, one after another."""
    leaves = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.md5(p.cast("binary")))
    sections = F.filter(F.regexp_extract_all(F.array_join(leaves, ""), F.lit(SECTION), F.lit(0)), lambda s: s != "")
    return F.transform(sections, lambda s: F.struct(F.md5(s.cast("binary")).alias("h"), F.regexp_replace(s, "([0-9a-f]{8})[0-9a-f]{24}", "$1").alias("leaves")))


def fingerprint(nodes: Column) -> Column:
    """A tree as root|section:leaves;section:leaves...: the root in 32 hex digits, each section in 16 and each leaf in 8. Null and empty texts have a root over nothing.

    The root is the hash of the sections' hashes, a section's that of its leaves', each in full (128 bits), so equal roots mean equal
    texts. Shown sections are cut to 64 bits and leaves to 32: a comparison of two texts of n leaves takes two different leaves for equal with a
    chance of some n * n / 2^32, and only differing sections need a look at their leaves. Pass a column that holds
    a tree rather than tree(...) itself, which would be built once for the root and again for the rest."""
    root = F.md5(F.array_join(F.transform(nodes, lambda n: n.h), "").cast("binary"))
    return F.concat(root, F.lit("|"), F.array_join(F.transform(nodes, lambda n: F.concat(F.substring(n.h, 1, 16), F.lit(":"), n.leaves)), ";"))


def leaves_of(fp: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.substring(fp, 34, 1 << 30), "[0-9a-f]{16}:|;", ""), F.lit("[0-9a-f]{8}"), F.lit(0))


def sections_of(fp: Column) -> Column:
    """Structs of section hash and leaves, in order."""
    return F.transform(F.filter(F.split(F.substring(fp, 34, 1 << 30), ";"), lambda s: s != ""), lambda s: F.struct(F.substring(s, 1, 16).alias("section"), F.regexp_extract_all(F.substring(s, 18, 1 << 30), F.lit("[0-9a-f]{8}"), F.lit(0)).alias("leaves")))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the common distinct leaves by the distinct leaves of both (0 to 1)."""
    x, y = F.array_distinct(leaves_of(a)), F.array_distinct(leaves_of(b))
    n = F.size(x) + F.size(y)
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / n)


def differing(a: Column, b: Column) -> Column:
    """Where a was edited to become b: for each section of a that b hasn't, its number from 0 and the numbers in it of the leaves that b hasn't. Equal roots: none."""
    known = F.transform(sections_of(b), lambda s: s.section)
    other = leaves_of(b)
    numbered = F.transform(sections_of(a), lambda s, i: F.struct(i.alias("section"), s.section.alias("h"), s.leaves.alias("leaves")))
    off = F.filter(numbered, lambda s: ~F.array_contains(known, s.h))
    return F.transform(off, lambda s: F.struct(s.section.alias("section"), F.filter(F.transform(s.leaves, lambda x, i: F.when(~F.array_contains(other, x), i)), lambda i: i.isNotNull()).alias("leaves")))


def successors(keys: DataFrame) -> DataFrame:
    """key (distinct long) -> with next, the next greater key, after the greatest the least. Keys are looked at in cells; only the cells' first keys meet in one place."""
    c = keys.withColumn("cell", F.floor(F.col("key") / 4096))
    within = c.withColumn("next", F.lead("key").over(Window.partitionBy("cell").orderBy("key")))
    firsts = c.groupBy("cell").agg(F.min("key").alias("first"))
    after = F.coalesce(F.lead("first").over(Window.orderBy("cell")), F.min("first").over(Window.partitionBy()))
    return within.join(firsts.select("cell", after.alias("after")), "cell").select("key", F.coalesce("next", "after").alias("next"))


def _rank(c: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most c, by halving."""
    if not bounds:
        return F.lit(0).cast("long")
    steps = F.lit(np.array([1 << i for i in reversed(range(len(bounds).bit_length()))], np.int64))
    held = F.lit(np.array(bounds, np.int64))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda p, s: F.when((p + s <= len(bounds)) & (F.get(held, (p + s - 1).cast("int")) <= c), p + s).otherwise(p))


def with_next(docs: DataFrame) -> DataFrame:
    """docs: id, text -> with next_text, the text of the next row by ascending id (then text), after the last that of the first.

    Rows meet in buckets of about 256 by quantiles of the ids, MOST_BUCKETS at most, however the ids are spread; a bucket is sorted, with
    spilling, and read one row ahead. The last row of a bucket gets the first row of the next bucket. Rows of one id and rows without an id lie in one bucket."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    if not n:
        return docs.withColumn("next_text", F.lit(""))
    buckets = max(1, min(MOST_BUCKETS, n // 256))
    at = np.arange(1, buckets) / buckets
    bounds = (docs.agg(F.percentile_approx("id", F.lit(at), F.lit(10 * buckets)).alias("b")).first()["b"] or []) if len(at) else []
    bucket = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(_rank(F.col("id"), sorted(set(bounds))))  # null ids come first
    d = docs.withColumn("bucket", bucket)
    firsts = d.groupBy("bucket").agg(F.min("id").alias("id"))
    chain = scratch.cut(successors(firsts.select(F.col("bucket").alias("key"))).select(F.col("key").alias("before"), F.col("next").alias("bucket")).join(firsts, "bucket"))
    opening = d.alias("d").join(few(chain).alias("c"), (F.col("d.bucket") == F.col("c.bucket")) & F.col("d.id").eqNullSafe(F.col("c.id")))
    opening = scratch.cut(opening.groupBy("before").agg(F.min("text").alias("opening")))
    led = d.withColumn("lead", F.lead(F.struct("text")).over(Window.partitionBy("bucket").orderBy("id", "text")))
    return led.join(opening, led["bucket"] == opening["before"], "left").select("id", "text", F.coalesce("lead.text", "opening").alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of the same texts with their last quarter replaced by the start of the next, and how like they are.

    docs: id, text; other columns are ignored. Null texts are empty; an empty text and its edit are equal; a table of one row is its own next; repeated ids are told apart by text, and null ids come first. Returns a row for each row: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    d = d.select("id", "n_chars", "text", "next_text", edited.alias("edited"))
    d = d.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(tree(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    d = d.select("id", "n_chars", "edited_sha256", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("_next"))
    return d.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
