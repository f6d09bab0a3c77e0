"""Mixing sources to target weights along a low-discrepancy schedule, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, prefix_sums

#: frac(n * PHI) for n up to 2^60, from two small factors so that doubles stay exact to about 1e-7.
PHI = 0.6180339887498949
CELLS = 1024


def _golden(n):
    high, low = F.floor(n / F.lit(1 << 24)), F.pmod(n, F.lit(1 << 24))
    step = (PHI * (1 << 24)) % 1.0
    x = high * F.lit(step) + low * F.lit(PHI)
    return x - F.floor(x)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with rank and target: shares of all words by weight, none above most times its source.

    Sources take the weights in turn by code point, null last. What a source can't take is shared out again by weight: in
    the order of most * size / weight there is one level up to which all sources are full, found by running sums over one row a source: that of the first source that it doesn't fill."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("full")) / F.col("rest"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("full", "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 1024, seed: int = 17) -> DataFrame:
    """Takes words from all sources near their targets.

    docs: id, source, text; other columns are ignored. Each source's documents are shuffled by hash and cut into blocks of
    block_words words. Slot n of the schedule goes to the source in whose share of the targets the fractional part of n times
    the golden ratio falls; its k-th slot takes the source's k-th block, from the first again when all were taken, and its last slot
    takes what is left of the target, so a source is taken to its target to the word and no document more often than most, rounded up.

    Returns a row for each row: id, source, size, source_size, target, taken. Null texts, empty texts and those of white space have size 0 and
    are taken 0 times; null is a source of its own, last; rows that repeat an id are taken each for itself; ties in the shuffle order go by id and size and are interchangeable.
    The same rows give the same mix whatever their partitions."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    d = d.withColumn("r", F.xxhash64(F.lit(seed), "id", "size")).withColumn("cell", F.shiftrightunsigned("r", 52))
    d = scratch.cut(d)
    goal = scratch.cut(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("quota", F.floor(F.col("target") + F.lit(0.5)).cast("long")))

    # Blocks: where each document lies among the words of its source.
    placed = scratch.cut(prefix_sums(d, ["source"], ["r", "id", "size"], "cell", {"start": "size"}))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    parts = parts.select("id", "size", "source", "start", "block", F.greatest("start", F.col("block") * block_words).alias("lo"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words).alias("hi"))

    # Slots: as many as the targets need, and some more because a source's share of the first n points is off by about log n.
    total = goal.agg(F.sum("quota").alias("q"), F.count("*").alias("s")).first()
    if not total["q"]:
        zero = placed.join(goal, placed["source"].eqNullSafe(goal["source"]))
        return zero.select("id", placed["source"], "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    n = -(-total["q"] // block_words)
    line = Window.orderBy(F.col("source").asc_nulls_last())
    ranges = goal.filter("quota > 0").withColumn("to", F.sum("quota").over(line.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(total["q"])))
    ranges = ranges.withColumn("from", F.coalesce(F.lag("to").over(line), F.lit(0.0))).withColumn("to", F.when(F.lead("quota").over(line).isNull(), F.lit(1.0)).otherwise(F.col("to")))
    # The k-th point in a share of width w comes before (k + c log) / w points, so each source gets its own horizon in the same sequence, but none looks further than
    # twice the slots: a source with a share so small that it has fewer points by then gets the slots it lacks at the end.
    slack = 3 * (n + 2).bit_length()
    ranges = ranges.withColumn("horizon", F.least(F.ceil((F.ceil(F.col("quota") / block_words) + slack) / (F.col("to") - F.col("from"))).cast("long"), F.lit(2 * n + 64 * slack)))
    cells = F.broadcast(ranges.select("source", "quota", "from", "to", "horizon", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("to") * CELLS)))).alias("cell")))
    furthest = ranges.agg(F.max("horizon")).first()[0]
    points = docs.sparkSession.range(furthest).withColumn("x", _golden(F.col("id"))).withColumn("cell", F.floor(F.col("x") * CELLS))
    slots = points.join(cells, "cell").filter("x >= `from` and x < `to` and id < horizon").select("source", "quota", "id", F.floor(F.col("id") / (1 << 16)).alias("chunk"), F.lit(1).cast("long").alias("one"))
    slots = prefix_sums(slots, ["source"], ["id"], "chunk", {"k": "one"}).filter(F.col("k") * block_words < F.col("quota")).select("source", "quota", "k")
    slots = scratch.cut(slots)
    have = F.broadcast(slots.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("have")))  # a row a source
    lacking = goal.filter("quota > 0").join(have, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("have", F.coalesce("have", F.lit(0))).withColumn("need", F.ceil(F.col("quota") / block_words))
    slots = slots.unionByName(lacking.filter("have < need").select("source", "quota", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("k")))
    # The k-th slot takes words [k * block_words, ...) of the source repeated without end; a pass ends with a shorter block, so a slot may touch two or more blocks.
    slots = slots.join(F.broadcast(goal.select(F.col("source").alias("_s"), "source_size")), F.col("source").eqNullSafe(F.col("_s")))
    a, b = F.col("k") * block_words, F.least((F.col("k") + 1) * block_words, F.col("quota"))
    turn = slots.withColumn("turn", F.explode(F.sequence(F.floor(a / F.col("source_size")), F.floor((b - 1) / F.col("source_size")))))
    lo, hi = F.greatest(a - F.col("turn") * F.col("source_size"), F.lit(0)), F.least(b - F.col("turn") * F.col("source_size"), F.col("source_size"))
    takes = turn.select("source", lo.alias("p"), hi.alias("q")).withColumn("block", F.explode(F.sequence(F.floor(F.col("p") / block_words), F.floor((F.col("q") - 1) / block_words))))
    takes = takes.select("source", "block", F.greatest("p", F.col("block") * block_words).alias("p"), F.least("q", (F.col("block") + 1) * block_words).alias("q"))
    got = parts.alias("d").join(takes.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.block") == F.col("t.block")))
    got = got.withColumn("w", F.least("hi", "q") - F.greatest("lo", "p")).filter("w > 0").groupBy("d.source", "id", "size", "start").agg(F.sum("w").alias("taken"))
    got = got.select(F.col("source").alias("_s"), F.col("id").alias("_id"), F.col("start").alias("_start"), F.col("taken").alias("_taken"), F.lit(True).alias("_hit"), F.col("size").alias("_size"))
    out = placed.join(got, F.col("source").eqNullSafe(F.col("_s")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_start")) & (F.col("size") == F.col("_size")), "left")
    out = out.select("id", "source", "size", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
    out = out.alias("o").join(F.broadcast(goal.alias("g")), F.col("o.source").eqNullSafe(F.col("g.source")))
    return out.select("id", F.col("o.source").alias("source"), "size", "source_size", "target", "taken")
