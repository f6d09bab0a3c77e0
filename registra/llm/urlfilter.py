"""URL filters: a blocked Bloom filter passes possible hits to an exact join with the rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, few

BITS_PER_KEY, BITS_SET = 16, 4


#: A filter has at most so many blocks of 8 bytes; with more keys it passes more to the exact join, and loses nothing.
MOST_BLOCKS = 1 << 24


def place(key: str, blocks: int) -> tuple[int, int]:
    """The block of a key and the BITS_SET bits that it sets there."""
    h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
    mask = 0
    for i in range(BITS_SET):
        mask |= 1 << (h >> (6 * i) & 63)
    return (h >> 24) % blocks, mask


class BlockedBloom:
    """Each key sets BITS_SET bits of one 64-bit block, so a test reads one word."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def __contains__(self, key: str) -> bool:
        block, mask = place(key, len(self.blocks))
        return int(self.blocks[block]) & mask == mask


def bloom_of(rules: DataFrame) -> BlockedBloom:
    """rules: rule (string) -> a filter of them, 16 bits a rule. Executors set the bits and join blocks by bit-or; only blocks reach the driver, 8 MB for each 4 million rules and 128 MB at most."""
    n = rules.count()
    size = max(1, min(MOST_BLOCKS, n * BITS_PER_KEY // 64 + 1))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [place(k, size) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in at], pa.int64()), pa.array(np.array([m for _, m in at], np.uint64).view(np.int64))], ["block", "mask"])

    rows = rules.select("rule").mapInArrow(bits, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    blocks = np.zeros(size, np.uint64)
    blocks[rows["block"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return BlockedBloom(blocks)


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    ends = [i for i in (path.find(c) for c in "?#") if i >= 0]
    return rest[:cut].translate(_LOWER), path[: min(ends, default=len(path))]


def rule_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """What a rule that fits may look like: a host's suffixes by label, each with the path's start of each length that rules have."""
    labels = host.split(".")
    return [f"{'.'.join(labels[i:])}{path[:n]}" for i in range(len(labels)) for n in lengths if n <= len(path)]


def filter_urls(pages: DataFrame, rules: DataFrame, other: str = "allow") -> DataFrame:
    """Judges urls by rules.

    pages: id, url; rules: host, path, verdict; other columns are ignored. A rule fits its host (A-Z in any case) and all subdomains where the url's path starts with the
    rule's. The longest rule (host and path together, then the longer host, then block before allow) wins; without one the
    verdict is other. Returns a row for each row: id, host, path, rule, verdict; repeated rows and ids are judged each for itself. A null url, or one without ://, has neither host nor path and no rule;
    rules with a null column are left out. Urls are split once; rows that the filter passes meet the rules by their own numbers, so a common url is no hot key."""
    scratch = Scratch(pages.sparkSession)
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().select(F.concat("host", "path").alias("rule"), F.length("host").alias("n"), "verdict")
    rules = scratch.cut(rules.groupBy("rule").agg(F.max(F.struct("n", "verdict")).alias("v")).select("rule", "v.n", "v.verdict"))
    bloom = pages.sparkSession.sparkContext.broadcast(bloom_of(rules))
    lengths = sorted(r[0] for r in rules.select((F.length("rule") - F.col("n")).alias("n")).distinct().collect())  # of paths of rules, a few hundred at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = bloom.value
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            maybe = [[k for k in rule_keys(h, p, lengths) if k in b_] if h else [] for h, p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(maybe, pa.list_(pa.string()))], ["id", "host", "path", "maybe"])

    urls = pages.select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url")).mapInArrow(judge, "id long, host string, path string, maybe array<string>")
    urls = scratch.cut(urls.withColumn("row", F.monotonically_increasing_id()))
    free = urls.filter("size(maybe) = 0").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(other).alias("verdict"))
    hits = urls.filter("size(maybe) > 0").select("row", "id", "host", "path", F.explode("maybe").alias("rule")).join(few(rules.withColumn("hit", F.col("rule"))), "rule", "left")
    best = hits.groupBy("row", "id", "host", "path").agg(F.max_by(F.struct("hit", "verdict"), F.struct(F.length("hit"), "n", F.col("verdict"))).alias("r"))
    return free.unionByName(best.select("id", "host", "path", F.col("r.hit").alias("rule"), F.coalesce("r.verdict", F.lit(other)).alias("verdict")))
