"""Exact n-gram Jaccard join by universe partitioning.

The universe of shingles is hashed into m segments, m by the size band of the smaller text of a pair. Two sets whose
difference is at most H agree in one of more than H segments (pigeonhole), so sets are indexed by (band, segment, content
of the segment). A segment is worth 1 to a set if its exact content is looked up, 2 if contents that differ by one shingle
are looked up too (one-deletion neighbourhoods), and 0 if it is left out; any allocation whose sum passes H loses no link.

Costs decide, set by set, from the measured lengths of the lists:
1. Every segment is worth 1 at first, and a set leaves out its longest lists, as many as its sum can spare. All sets order
   lists alike (length, then key), so the shortest list that two linked sets share is kept by both.
2. A set whose lists then still hold more than COST candidates for each of its shingles is dear. Pairs of a set that isn't dear are met
   in the lists; they are at most COST times all shingles, whatever the lists look like.
3. Dear sets are indexed by their one-deletion neighbourhoods too, again with list lengths, and each set takes the cheapest
   worths of 0, 1 and 2 whose sum passes H. Only pairs of two dear sets are met there, and only where the shingles that many dear sets have can make the
   link; pairs that need others too are counted in segments of one shingle, the finest partition there is.
Candidates are verified on whole sets. Before that, wherever lists are joined with themselves, a pair is left out if the sketches
of its sets differ in more bits than linked sets can: a bit is the parity of the elements that fall on it, so bits that differ are
never more than elements that differ, and no link is lost. Above some 500 shingles a set the bits fill up and leave out little.

Equal sets form a class and are represented once. Lists of classes are first tested as stars (a centre against the rest),
and a list whose members are all connected needs no further pair, so groups of copies cost rows in proportion to their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, few, mix64, pieces, shingle_sets
from .components import components

_SEG, _BAND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_HALF = np.uint64(32)
#: Candidates for each shingle of a set beyond which its neighbourhoods are cheaper.
COST = 2.0
#: Rounds of stars, each with other centres.
ROUNDS = 2
#: Lists of one shingle with at most so many dear sets are counted pair by pair, so a set costs at most so much for each of its shingles.
RARE = 64
#: Centres that a dear set is tested against, about.
CENTRES = 16
#: Rounds in which sets go that share too few segments with any other.
PRUNINGS = 2
#: Words of 64 bits of a sketch.
SKETCH = tuple(f"s{i}" for i in range(8))


class Bands:
    """Sizes [start[b], start[b + 1]) form band b; partners of a set lie in its own band and the next one."""

    def __init__(self, percent: int):
        self.percent = percent
        self.start = np.array([1], np.int64)
        self.m = np.zeros(0, np.int64)

    def larger(self, size):
        return size * 100 // self.percent

    def differ(self, total):
        """The greatest symmetric difference of two linked sets with so many elements together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def _extend(self, size: int) -> None:
        start = self.start.tolist()
        while len(start) < 3 or start[-2] <= size:
            start.append(self.larger(start[-1]) + 1)
        if len(start) > len(self.start):
            self.start = np.array(start, np.int64)
            need = [self.differ(s - 1 + self.larger(s - 1)) + 1 for s in start[1:]]
            self.m = np.array([math.ceil(1.07 * x + 1.2 * math.sqrt(x)) for x in need], np.int64)  # some stay empty

    def schemes(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For the own and the lower band of sets of sizes n > 0: which sets, band, number of segments, and the greatest difference of its pairs that hold such a set."""
        self._extend(int(n.max(initial=1)))
        s, band = self.start, np.searchsorted(self.start, n, "right") - 1
        yield np.ones(len(n), bool), band, self.m[band], self.differ(n + np.minimum(self.larger(n), self.larger(s[band + 1] - 1)))
        low = (band > 0) & (n <= self.larger(s[band] - 1))
        band = band[low]
        yield low, band - 1, self.m[band - 1], self.differ(n[low] + s[band] - 1)


@lru_cache(8)
def bands(percent: int) -> Bands:
    return Bands(percent)


class Cells:
    """Segments of many sets in one scheme: g: the band's hashes of all elements, at: the cell of each; first: each set's first cell."""

    def __init__(self, h: np.ndarray, n: np.ndarray, which: np.ndarray, band: np.ndarray, m: np.ndarray):
        self.n, self.band, self.m = n[which], band, m
        self.first = np.cumsum(m) - m
        mine = h if which.all() else h[np.repeat(which, n)]
        self.g = mix64(mine ^ np.repeat(band.astype(np.uint64) * _BAND, self.n))
        seg = ((self.g >> _HALF) * np.repeat(m.astype(np.uint64), self.n)) >> _HALF
        self.at = np.repeat(self.first, self.n) + seg.astype(np.int64)
        self.size = np.bincount(self.at, minlength=int(m.sum()))

    def each(self, of_cells: np.ndarray) -> np.ndarray:
        """Sums by set."""
        return np.add.reduceat(of_cells.astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)

    def contents(self) -> np.ndarray:
        """The sum (64 bits) of each cell's hashes, in halves that doubles add up exactly."""
        low, high = (np.bincount(self.at, x.astype(np.float64), len(self.size)).astype(np.uint64) for x in (self.g & np.uint64(0xFFFFFFFF), self.g >> _HALF))
        return (high << _HALF) + low

    def keys(self, content: np.ndarray, cell: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The lowest bit tells the band's parity, so own and lower band are told apart."""
        band = self.band[owner].astype(np.uint64)
        k = mix64(content + (cell - self.first[owner]).astype(np.uint64) * _SEG + band * _BAND)
        return ((k & ~np.uint64(1)) | (band & np.uint64(1))).view(np.int64)


def slacks(h: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both schemes: which sets, the band's parity, and the number of segments to spare, negative if too many are empty."""
    for which, band, m, most in bands(percent).schemes(n):
        c = Cells(h, n, which, band, m)
        yield which, band & 1, c.each(c.size > 0) - most - 1


def signatures(h: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For both schemes: the keys of the filled segments, and the number of the set that each belongs to."""
    for which, band, m, _ in bands(percent).schemes(n):
        c = Cells(h, n, which, band, m)
        cell = np.flatnonzero(c.size)
        owner = np.repeat(np.arange(len(m)), m)[cell]
        yield c.keys(c.contents()[cell], cell, owner), np.flatnonzero(which)[owner]


def neighbourhoods(h: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """For both schemes of one set: the band's parity, how much must be passed, keys, their segments, whether each is a content
    as it is (else one less a shingle), and whether all the worths together are too little."""
    n = np.array([len(h)])
    for which, band, m, most in bands(percent).schemes(n):
        if not which.any():
            continue
        c = Cells(h, n, which, band, m)
        total, cell = c.contents(), np.flatnonzero(c.size)
        drop = c.size[c.at] > 1
        at = np.r_[cell, c.at[drop]]
        keys = c.keys(np.r_[total[cell], total[c.at[drop]] - c.g[drop]], at, np.zeros(len(at), np.int64))
        yield int(band[0] & 1), int(most[0]), keys, at, np.arange(len(at)) < len(cell), int(np.minimum(c.size, 2).sum()) <= most[0]


def sketches(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of words for each set: bit i is the parity of the number of its elements whose highest bits say i."""
    width = 64 * len(SKETCH)
    bits = np.zeros(len(n) * width, np.uint8)
    np.bitwise_xor.at(bits, np.repeat(np.arange(len(n)) * width, n) + (((h >> _HALF) * np.uint64(width)) >> _HALF).astype(np.int64), np.uint8(1))
    return np.packbits(bits, bitorder="little").view(np.int64).reshape(len(n), len(SKETCH))


def _close(percent: int) -> str:
    """The condition that the sketches s0_a ... and s0_b ... of sets of n_a and n_b elements don't rule a link out."""
    return f"({' + '.join(f'bit_count({s}_a ^ {s}_b)' for s in SKETCH)}) * {100 + percent} <= (n_a + n_b) * {100 - percent}"


def _profile(width: int, percent: int):
    """(id, of, text) -> (id, of, n, c1, c2, odd, own, low): set size, class of equal sets (128 bits), parity of its band, slack in the own and in the lower band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in pieces(b.column(2).to_pylist()):
                h, n = shingle_sets(texts, width)
                end = np.cumsum(n)
                cls = [xxhash.xxh3_128_intdigest(h[e - k : e]) for e, k in zip(end.tolist(), n.tolist(), strict=True)]
                out = {c: np.zeros(len(n), np.int32) for c in ("odd", "own", "low")}
                has_low, some = np.zeros(len(n), bool), np.flatnonzero(n)
                if len(some):
                    for name, (which, odd, slack) in zip(("own", "low"), slacks(h, n[some], percent), strict=True):
                        out[name][some[which]] = slack
                        if name == "own":
                            out["odd"][some] = odd
                        else:
                            has_low[some[which]] = True
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), b.column(1).slice(at, len(n)), pa.array(n), pa.array([(c >> 64) - (1 << 63) for c in cls], pa.int64()), pa.array([(c & (1 << 64) - 1) - (1 << 63) for c in cls], pa.int64()), pa.array(out["odd"]), pa.array(out["own"]), pa.array(out["low"], mask=~has_low)], ["id", "of", "n", "c1", "c2", "odd", "own", "low"])
                at += len(n)

    return run


def _signatures(width: int, percent: int):
    """(cls, text) -> (key, cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cls = 0, b.column(0).to_numpy()
            for texts in pieces(b.column(1).to_pylist()):
                for keys, owner in signatures(*shingle_sets(texts, width), percent):
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls[at : at + len(texts)][owner])], ["key", "cls"])
                at += len(texts)

    return run


def _sets(width: int):
    """(cls, text) -> (cls, n, h, s0, ...): the set as sorted hashes of 8 bytes, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in pieces(b.column(1).to_pylist()):
                h, n = shingle_sets(texts, width)
                end = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n), pa.array([h[e - k : e].tobytes() for e, k in zip(end.tolist(), n.tolist(), strict=True)], pa.binary()), *map(pa.array, sketches(h, n).T)], ["cls", "n", "h", *SKETCH])
                at += len(n)

    return run


def _verify(percent: int):
    """(a, b, ha, hb) -> the pairs (a, b) whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
                good[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def _neighbourhoods(percent: int):
    """(cls, h, odd, even) -> (key, cls, parity, most, seg, exact, thin): odd, even: whether the scheme of that parity is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, raw, odd, even in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for parity, most, keys, seg, exact, thin in neighbourhoods(np.frombuffer(raw, np.uint64), percent):
                    if (even, odd)[parity]:
                        k = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(k, cls)), pa.array(np.full(k, parity, np.int32)), pa.array(np.full(k, most, np.int32)), pa.array(seg.astype(np.int32)), pa.array(exact), pa.array(np.full(k, thin))], ["key", "cls", "parity", "most", "seg", "exact", "thin"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, comp, h) -> (key, cls, comp): single shingles."""
    for b in batches:
        h = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
        n = [len(x) for x in h]
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(b.column(1).to_numpy(), n))], ["key", "cls", "comp"])


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Groups of texts linked by a Jaccard likeness of at least percent / 100 of their shingles of width words.

    docs: id long, text string; other columns are ignored. Returns a row for each row of docs: id, n_shingles, and
    component_id, the smallest id that links reach. Null and empty texts have no shingles and are linked with nothing;
    repeated texts are linked; an id that repeats gives a row each time; a null id keeps its row, and the component of
    texts without any id is null. Classes of equal sets are known by 128 bits; shingles are compared as 64-bit hashes, so two
    different shingles of a compared pair count as one with a chance of some n * n / 2^64, 5e-14 for sets of 1,000."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    of = F.xxhash64("text").alias("of")  # with the id it tells a class's text from others, whether ids repeat or are null
    info = scratch.cut(docs.select("id", of, "text").mapInArrow(_profile(width, percent), "id long, of long, n long, c1 long, c2 long, odd int, own int, low int"))
    classes = info.filter("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("first"), F.coalesce(F.min_by("of", "id"), F.min("of")).alias("of"), *(F.min(c).alias(c) for c in ("n", "odd", "own", "low")))
    classes = scratch.cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    reps = classes.select("cls", F.col("first").alias("_id"), F.col("of").alias("_of"))

    def texts(wanted: DataFrame) -> DataFrame:
        """(cls, text) of classes, a row for each of the rows that have just the class's id and text."""
        return docs.select("id", "text", of).join(few(wanted), F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of"))).select("cls", "text")

    # Lists: the classes of each content, if several.
    by_key, by_set = Window.partitionBy("key"), Window.partitionBy("cls", "parity")
    sig = texts(reps).mapInArrow(_signatures(width, percent), "key long, cls long")
    lists = scratch.cut(sig.select("key", "cls", F.min("cls").over(by_key).alias("lo"), F.max("cls").over(by_key).alias("hi")).filter("lo < hi").select("key", "cls").distinct())
    scratch.release()
    parity = F.pmod(F.col("key"), F.lit(2)).cast("int").alias("parity")
    slack = F.when(F.col("parity") == F.col("odd"), F.col("own")).otherwise(F.col("low")).alias("slack")
    for _ in range(PRUNINGS):  # a set differs from a partner in each segment that no other set has
        held = lists.groupBy("cls", parity).agg(F.count("*").alias("k")).join(classes, "cls").withColumn("slack", slack).filter("k > slack").select("cls", "parity", "n", "slack")
        kept = lists.select("key", "cls", parity).join(held, ["cls", "parity"]).select("key", "cls", "parity", "n", "slack", F.count("*").over(by_key).alias("size"))
        fewer = scratch.cut(kept.filter("size > 1"))
        scratch.drop(lists)
        lists = fewer
    # Of its lists a set leaves out the longest, as many as it can spare.
    kept = lists.withColumn("rank", F.row_number().over(by_set.orderBy(F.desc("size"), F.desc("key")))).filter("rank > slack").drop("rank")
    kept = scratch.cut(kept.withColumn("size", F.count("*").over(by_key)).filter("size > 1").drop("size"))
    scratch.drop(lists)
    lists = kept
    scratch.release()

    short = classes.filter("own < 0").select("cls", F.col("odd").alias("parity")).union(classes.filter("low < 0").select("cls", (1 - F.col("odd")).alias("parity")))
    short = scratch.cut(short)  # too many segments are empty, so the lists don't suffice
    near = lists.select("cls").union(short.select("cls")).distinct()
    sets = scratch.cut(texts(reps.join(near, "cls")).mapInArrow(_sets(width), f"cls long, n long, h binary, {' long, '.join(SKETCH)} long").groupBy("cls").agg(*(F.min(c).alias(c) for c in ("n", "h", *SKETCH))))
    marks = few(sets.select("cls", *SKETCH), BROADCAST_ROWS // 4)  # wider rows than others that are broadcast
    comp = scratch.cut(sets.select("cls", F.col("cls").alias("comp")))
    tested = None

    def merge(pairs: DataFrame) -> None:
        """Tests pairs of different components that weren't tested; joins the components that they link."""
        nonlocal comp, tested
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = scratch.cut(new if tested is None else new.join(tested, ["a", "b"], "left_anti"))
        if not new.limit(1).count():
            return
        tested = new if tested is None else tested.union(new)
        full = new.join(sets.select(F.col("cls").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("cls").alias("b"), F.col("h").alias("hb")), "b")
        found = scratch.cut(full.select("a", "b", "ha", "hb").mapInArrow(_verify(percent), "a long, b long"))
        if found.limit(1).count():
            for n in "ab":
                found = found.join(comp.select(F.col("cls").alias(n), F.col("comp").alias(f"_{n}")), n)
            known = components(scratch, found.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("id").alias("comp"), F.col("comp").alias("now"))
            comp = scratch.cut(comp.join(few(known), "comp", "left").select("cls", F.coalesce("now", "comp").alias("comp")))
        scratch.release()

    def open_lists() -> DataFrame:
        """Lists that hold more than one component still."""
        g = lists.join(comp, "cls")
        return g.select("*", F.min("comp").over(by_key).alias("least"), F.max("comp").over(by_key).alias("most"), F.count("*").over(by_key).alias("size")).filter("least < most").drop("least", "most")

    for r in range(ROUNDS):
        g = open_lists().withColumn("c", F.min_by(F.struct("comp", "cls", "n"), F.xxhash64("cls", F.lit(r))).over(by_key)).withColumn("all", F.count("*").over(by_set))
        # Stars only save work, so they are tested where a class shares much with a centre.
        star = g.filter(f"c.comp <> comp and least(n, c.n) * 100 >= greatest(n, c.n) * {percent}")
        merge(star.groupBy(F.col("c.cls").alias("a"), F.col("cls").alias("b"), "parity", "all").agg(F.count("*").alias("k")).filter("3 * k >= all"))

    # Pairs of a set that isn't dear.
    left = open_lists()
    cost = left.groupBy("cls", "parity").agg(F.sum(F.col("size") - 1).alias("cost"), F.max("n").alias("n"))
    dear = cost.filter(F.col("cost") > COST * F.col("n")).select("cls", "parity").union(short).distinct()
    dear = scratch.cut(dear)
    left = scratch.cut(left.select("key", "cls", "comp", "parity", "n").join(few(dear.withColumn("dear", F.lit(True))), ["cls", "parity"], "left").withColumn("dear", F.coalesce("dear", F.lit(False))))
    x, y = (left.join(marks, "cls").select("key", "parity", *(F.col(c).alias(f"{c}_{n}") for c in ("cls", "comp", "n", "dear", *SKETCH))) for n in "ab")
    fits = f"least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent} and {_close(percent)}"
    merge(x.filter("not dear_a").join(y, ["key", "parity"]).filter(f"comp_a <> comp_b and (dear_b or cls_a < cls_b) and {fits}").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))

    # Pairs of two dear sets.
    if dear.limit(1).count():
        wanted = dear.groupBy("cls").agg(F.bool_or(F.col("parity") == 1).alias("odd"), F.bool_or(F.col("parity") == 0).alias("even"))
        held = scratch.cut(sets.join(few(wanted), "cls"))

        # Segments of one shingle: rare ones, which at most RARE dear sets have, are counted pair by pair. Two sets share no more than those and the usual ones of the poorer.
        e = held.join(few(comp), "cls").select("cls", "comp", "h").mapInArrow(_elements, "key long, cls long, comp long")
        e = e.select("key", "cls", F.min("comp").over(by_key).alias("least"), F.max("comp").over(by_key).alias("last"), F.count("*").over(by_key).alias("held")).filter("least < last")
        e = scratch.cut(e.select("key", "cls", "held"))
        has = e.groupBy("cls").agg(F.count_if(F.col("held") > RARE).alias("u"), F.count("*").alias("all"))
        sizes = scratch.cut(held.select("cls", "n").join(few(has), "cls").filter(f"all * 100 >= n * {percent}").select("cls", "n", "u"))
        x, y = (e.filter(f"held <= {RARE}").join(few(comp), "cls").join(few(sizes), "cls").join(marks, "cls").select("key", F.col("cls").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("comp", "n", "u", *SKETCH))) for n in "ab")
        both = x.join(y, "key").filter(f"a < b and comp_a <> comp_b and {fits}").groupBy("a", "b", "n_a", "n_b", "u_a", "u_b").agg(F.count("*").alias("s"))
        merge(both.filter(f"(s + least(u_a, u_b)) * {100 + percent} >= (n_a + n_b) * {percent}").select("a", "b"))
        bound = f"least(u_a, u_b) * {100 + percent} >= (n_a + n_b) * {percent} and least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent}"

        # The other pairs share usual shingles only, so of either set at least percent must be usual.
        held = scratch.cut(held.join(few(sizes.select("cls", "u")), "cls").filter(f"u * 100 >= n * {percent}"))
        made = scratch.cut(held.select("cls", "h", "odd", "even").mapInArrow(_neighbourhoods(percent), "key long, cls long, parity int, most int, seg int, exact boolean, thin boolean"))

        def neighbours(r: int = 0) -> DataFrame:
            """Rows with their components; of keys that hold several of them, how many rows are contents as they are and how many lack one shingle, and a centre."""
            g = made.join(few(comp), "cls").join(few(held.select("cls", "n", "u")), "cls")
            c = F.min_by(F.struct("comp", "cls", "n", "u"), F.when(F.col("exact"), F.xxhash64("cls", F.pmod(F.shiftright("key", 1), F.lit(CENTRES)), F.lit(r)))).alias("c")
            by = g.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("last"), F.count_if("exact").alias("as_is"), F.count_if(~F.col("exact")).alias("less_one"), c)
            return g.join(by.filter("least < last and as_is > 0").drop("least", "last"), "key", "left").na.fill(0, ["as_is", "less_one"])

        star = neighbours(1).select("cls", "comp", "parity", "most", "seg", "c", *(F.col(x).alias(f"{x}_a") for x in ("n", "u")), *(F.col(f"c.{x}").alias(f"{x}_b") for x in ("n", "u"))).filter(f"c.comp <> comp and {bound}")
        merge(star.groupBy(F.col("c.cls").alias("a"), F.col("cls").alias("b"), "parity", "most").agg(F.count_distinct("seg").alias("k")).filter(f"{3 * CENTRES} * k >= most").select("a", "b"))
        rows = scratch.cut(neighbours().drop("c"))
        # What a segment costs at worth 1, and what worth 2 adds; the units of worth are taken from the cheapest on.
        price = rows.groupBy("cls", "parity", "most", "seg").agg(F.sum(F.when(F.col("exact"), F.greatest(F.col("as_is") - 1, F.lit(0))).otherwise(0)).alias("one"), F.sum(F.when(F.col("exact"), F.col("less_one")).otherwise(F.col("as_is"))).alias("two"), F.count("*").alias("k"))
        both = (F.col("one") + F.col("two")) / 2
        units = F.when(F.col("k") == 1, F.array(F.col("one").cast("double"))).when(F.col("two") < F.col("one"), F.array(both, both)).otherwise(F.array(F.col("one").cast("double"), F.col("two").cast("double")))
        units = price.select("*", F.explode(units).alias("unit")).withColumn("rank", F.row_number().over(by_set.orderBy("unit", "seg"))).filter("rank <= most + 1")
        worth = units.groupBy("cls", "parity", "seg").agg(F.when((F.count("*") == 2) | (F.max("k") > 1) & (F.max("two") < F.max("one")), 2).otherwise(1).alias("worth"))
        rows = rows.filter("as_is > 0")
        # A set's own worths meet any partner, so it is enough that the greater of two looks the other up.
        probes = rows.join(worth, ["cls", "parity", "seg"]).filter("exact or worth = 2")
        x, y = (t.join(marks, "cls").select("key", *(F.col(c).alias(f"{c}_{n}") for c in ("cls", "comp", "n", "u", "exact", *SKETCH, *w))) for n, t, w in (("a", probes, ("worth",)), ("b", rows, ())))
        merge(x.join(y, "key").filter(f"(n_a > n_b or n_a = n_b and cls_a > cls_b) and comp_a <> comp_b and (exact_a and exact_b or worth_a = 2 and exact_a <> exact_b) and {bound} and {_close(percent)}").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
        thin = made.filter("thin").select("cls").distinct()  # too few segments are filled even so: pairs of two such sets are met by their usual shingles
        x, y = (e.filter(f"held > {RARE}").join(few(thin), "cls").join(few(sizes), "cls").join(marks, "cls").select("key", F.col("cls").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("n", *SKETCH))) for n in "ab")
        merge(x.join(y, "key").filter(f"a < b and {fits}").select("a", "b"))
        scratch.drop(made, rows, held, e, sizes)

    group = classes.join(comp, "cls", "left").select("c1", "c2", "first", F.coalesce("comp", "cls").alias("comp"))
    lead = group.groupBy("comp").agg(F.min("first").alias("component_id"))
    found = scratch.cut(group.join(lead, "comp").select("c1", "c2", "component_id"))
    scratch.drop(lists, sets, left, short, dear)
    return info.join(found, ["c1", "c2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
