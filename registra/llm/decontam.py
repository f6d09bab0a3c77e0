"""Benchmark decontamination with DataFrame operations only: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, ascii_lower, few, words


def _runs(w: Column, width: int, one) -> Column:
    """one(start, length) for each run of width words of an array, for a shorter array one for all of it; nothing for an empty one."""
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: one(i, F.lit(width)))).when(F.size(w) > 0, F.array(one(F.lit(1), F.size(w)))).otherwise(F.array())


def shingle_texts(column: str, width: int) -> Column:
    """Distinct shingles of a column of words."""
    w = F.col(column)
    return F.array_distinct(_runs(w, width, lambda i, n: F.array_join(F.slice(w, i, n), " ")))


def hash_words(w: Column, width: int) -> Column:
    """A hash for each run of words; a short array's one is of other columns, so it equals that of an equally short array only."""
    run = lambda i, n: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(width)))
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: run(i, width))).when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def _spaced(w: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))


def hash_short(w: Column, lengths: list[int]) -> Column:
    """hash_words' hashes of arrays as short as each of the lengths, for all runs of an array that are so long."""

    def runs(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.lit("short"), F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(*map(runs, lengths)))


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Which documents hold which test items: at least percent / 100 of an item's distinct shingles of width words.

    docs: id, text; items: item_id, text; other columns are ignored. Items are partitioned by size (powers of two of their shingles). An item's sketch is its least hashes (the
    bottom of a MinHash permutation), as many as its partition needs: an item of n shingles may lack (100 - percent) * n / 100, so one hash more must occur
    in any document that holds it, and no document is missed. Hashes above the greatest of all sketches are dropped before the join. Candidates are verified on the shingles' words.
    Returns id, item_id, n_item (shingles), n_shared, containment; null, empty and blank texts hold nothing and are held by nothing; an item of fewer words than width is found
    where its words stand in a row, as its only shingle; repeated ids count with the text that holds most, repeated rows once; a null id or item_id keeps its hits."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    is_row = F.xxhash64("text")  # with the id it tells rows apart, whether ids repeat or are null
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.cut(items.withColumn("w", words(ascii_lower(F.col("text")))).filter(F.size("w") > 0).withColumn("hashes", F.array_sort(F.array_distinct(hash_words(F.col("w"), width)))).select("item_id", "text", "hashes", F.xxhash64("text").alias("of")))
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes")))).cast("int")
    keep = F.least(F.size("hashes"), F.floor(largest * (100 - percent) / 100).cast("int") + 1)
    sketch = scratch.cut(items.select("item_id", "of", F.explode(F.slice("hashes", F.lit(1), keep)).alias("h")).distinct())
    top = sketch.agg(F.max("h")).first()[0]
    if top is None:
        return docs.select("id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment")).filter(F.lit(False))
    w = docs.select("id", is_row.alias("d"), words(ascii_lower(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    lengths = sorted(r[0] for r in items.select(F.size(words(F.col("text"))).alias("n")).filter(F.col("n") < width).distinct().collect())
    probed = F.concat(hash_words(F.col("w"), width), hash_short(F.col("w"), lengths)) if lengths else hash_words(F.col("w"), width)
    probes = w.select("id", "d", F.explode(F.filter(probed, lambda h: h <= top)).alias("h"))
    cands = scratch.cut(probes.join(few(sketch), "h").select("id", "d", "item_id", "of").distinct())
    # A text's words and shingles are made once, whatever the number of its candidates, each in a column of its own, since a lambda would make them again for each element.
    hits = cands.groupBy("id", "d").agg(F.collect_list(F.struct("item_id", "of")).alias("hits"))
    hits = F.broadcast(hits) if cands.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hits
    held = docs.alias("d").join(hits.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (is_row == F.col("c.d"))).select("d.id", words(ascii_lower(F.col("text"))).alias("w"), "hits")
    whole = [_spaced(F.col("w")).alias("whole")] if lengths else []
    held = held.select("id", shingle_texts("w", width).alias("held"), *whole, "hits").select("id", "held", *(["whole"] if lengths else []), F.explode("hits").alias("hit"))
    told = items.select("item_id", "of", words(ascii_lower(F.col("text"))).alias("w")).select(F.col("item_id").alias("_item"), F.col("of").alias("_of"), shingle_texts("w", width).alias("shingles"), F.when(F.size("w") < width, _spaced(F.col("w"))).alias("short"))
    pairs = held.join(told, F.col("hit.item_id").eqNullSafe(F.col("_item")) & (F.col("hit.of") == F.col("_of")))
    shared = F.size(F.array_intersect("shingles", "held"))
    if lengths:
        shared = F.when(F.col("short").isNotNull(), F.contains("whole", "short").cast("int")).otherwise(shared)
    found = pairs.select("id", F.col("_item").alias("item_id"), F.size("shingles").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    found = found.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_item", "n_shared")).alias("b"))
    return best.select("id", "item_id", "b.n_item", "b.n_shared", F.col("b.c").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs (key, text and whatever else they have) that hold no item. All rows of a key that holds one go; rows without a key are judged by their text, known by a 64-bit hash."""
    scratch, named, told = Scratch(docs.sparkSession), F.col(key).isNotNull(), docs
    leaks = find_leaks(docs.filter(named).select(F.col(key).alias("id"), "text"), items, width, percent).select(F.col("id").alias("_leak")).distinct()
    out = told.join(few(scratch.cut(leaks)), docs[key] == F.col("_leak"), "left_anti")
    nameless = docs.filter(~named)
    if nameless.limit(1).count():
        texts = find_leaks(nameless.select(F.xxhash64("text").alias("id"), "text"), items, width, percent).select(F.col("id").alias("_leak")).distinct()
        out = out.join(few(scratch.cut(texts)), out[key].isNull() & (F.xxhash64(out["text"]) == F.col("_leak")), "left_anti")
    return out
