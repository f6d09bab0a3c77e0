"""Several registers as one: qualified ids and kinds, targets found by raw id across sources, and findings over the whole."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NodeKind, Profile, Register
from ..operators import relations as rel
from ..shared import cut
from ..sources import profiles
from . import validate

#: Severities of the codes that fusing adds, fixed values.
SEVERITY = {"SOURCE_FAILURE": "error", "CROSS_SOURCE_DUPLICATE_ID": "error", "AMBIGUOUS_CROSS_REF": "error", "FUSE_ERROR": "error"}
MAJOR = 1
ORPHANS = ("UNREFERENCED", "UNTRACED")
COLUMNS = ["source", "severity", "code", "message", "node_id", "file", "line", "suppressed"]


class FuseError(ValueError):
    """A manifest or fuse profile that can't be used, or a source that couldn't be read; there is no partial answer."""


@dataclass(frozen=True)
class FuseProfile:
    edge_kinds: dict[str, list[tuple[str, str]]]  # kind -> pairs of 'source:kind'
    validations: tuple = ()
    overrides: dict = field(default_factory=dict)
    suppressions: tuple = ()


def load_manifest(path: str) -> dict:
    """name, version, fuse_profile and sources (name, profile, adapter, target), with paths made absolute from the manifest's folder."""
    raw = profiles._yaml(open(path, encoding="utf-8").read(), path)
    base = os.path.dirname(os.path.realpath(path))
    try:
        profiles.check_version("manifest_version", raw.get("manifest_version"), MAJOR)
        for key in ("name", "version", "fuse_profile"):
            if not isinstance(raw.get(key), str) or not raw[key].strip():
                raise FuseError(f"'{key}' must not be empty")
        if unknown := sorted(set(raw) - {"manifest_version", "name", "version", "fuse_profile", "sources"}):
            raise FuseError(f"unknown keys {unknown}")
        if not isinstance(raw.get("sources"), list) or not raw["sources"]:
            raise FuseError("'sources' must be a list that isn't empty")
        names = set()
        for s in raw["sources"]:
            name = s.get("name")
            if not isinstance(name, str) or not name.strip() or ":" in name:
                raise FuseError("source names must not be empty nor contain ':'")
            if name in names:
                raise FuseError(f"duplicate source name '{name}'")
            names.add(name)
            for key in ("profile", "target"):
                s[key] = os.path.join(base, s[key])
        return {**raw, "fuse_profile": os.path.join(base, raw["fuse_profile"])}
    except (profiles.ProfileError, FuseError) as e:
        raise FuseError(f"manifest '{path}': {e}") from e


def compile_fuse_profile(raw: dict) -> FuseProfile:
    faults = [f"fuse profile: unknown key '{k}'" for k in raw if k not in ("annotations", "name", "profile_version", "edge_kinds", "node_kinds", "validations")]
    faults += [f"fuse profile must not declare '{k}'; it belongs to source profiles" for k in ("annotations", "node_kinds") if k in raw]
    if not isinstance(raw.get("edge_kinds"), dict):
        raise FuseError("; ".join([*faults, "fuse profile requires 'edge_kinds'"]))
    edges = {k: [tuple(x) for x in (v or {}).get("allowed", [])] for k, v in raw["edge_kinds"].items()}
    for k, pairs in edges.items():
        faults += [f"edge kind '{k}': '{e}' must be source:kind" for x in pairs for e in x if e.count(":") != 1 or not all(e.split(":"))]
    p = {"pathways": (), "overrides": {}, "suppressions": [], "pathway_bindings": {}, "templates": {}, "validations": []}
    f = profiles._Faults()
    kinds = {e: NodeKind() for x in edges.values() for pair in x for e in pair}
    for entry in raw.get("validations") or []:
        for code, config in entry.items():
            if code not in ("COVERAGE", "COVERAGE_DEEP", "SUPPRESS") and set(config or {}) - {"severity"}:
                f.append(f"fuse profile: '{code}' takes a severity only")
            profiles._entry(f, code, config or {}, {**p, "node_kinds": kinds, "edge_kinds": edges})
    if faults or f:
        raise FuseError("; ".join([*faults, *f]))
    return FuseProfile(edges, tuple(p["validations"]), p["overrides"], tuple(p["suppressions"]))


def check_endpoints(f: FuseProfile, sources: dict[str, Profile]) -> None:
    """Refuses pairs that name a source or a kind that isn't there, before any source is read."""
    known = {f"{s}:{k}" for s, p in sources.items() for k in p.node_kinds}
    if gone := sorted({e for x in f.edge_kinds.values() for pair in x for e in pair} - known):
        raise FuseError(f"fuse profile: undeclared kinds {', '.join(gone)}")


def compose(sources: dict[str, Register], f: FuseProfile) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all sources. Nodes: qualified id and kind, with raw and source. Edges: qualified src, raw target, and where just one
    candidate fits its qualified id as tgt; candidates counts them. The target of a kind that the fuse profile declares lies where the source's kind may link to, of another in its own source."""
    nodes, edges = [], []
    for at, (s, r) in enumerate(sources.items()):
        q = lambda c: F.concat_ws(":", F.lit(s), F.col(c))  # noqa: B023, E731
        n = r.nodes.select("id", "kind", "attrs", "file", "line", "ord")
        nodes.append(n.select(q("id").alias("id"), q("kind").alias("kind"), "attrs", "file", "line", "ord", F.col("id").alias("raw"), F.lit(s).alias("source"), F.lit(at).alias("source_at")))
        edges.append(r.edges.select(q("src").alias("src"), F.col("tgt").alias("raw"), "kind", "attrs", "file", "line", "ord", F.lit(s).alias("source"), F.lit(at).alias("source_at")))
    n = cut(rel._union(nodes))
    e = rel._union(edges).join(n.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src", "left").withColumn("no", F.monotonically_increasing_id())
    e = cut(e)
    rules = n.sparkSession.createDataFrame([(k, a, b) for k, pairs in f.edge_kinds.items() for a, b in pairs], "kind string, src_kind string, tgt_kind string")
    crossing = [*f.edge_kinds]
    ends = n.select("raw", F.col("id").alias("found"), F.col("kind").alias("tgt_kind"), F.col("source").alias("tgt_source"))
    far = e.filter(F.col("kind").isin(*crossing)).join(F.broadcast(rules), ["kind", "src_kind"]).join(ends, ["raw", "tgt_kind"])
    own = e.filter(~F.col("kind").isin(*crossing)).join(ends.withColumnRenamed("tgt_source", "source"), ["raw", "source"])
    hits = far.select("no", "found", "tgt_kind").unionByName(own.select("no", "found", "tgt_kind")).distinct()
    hits = hits.groupBy("no").agg(F.count("*").alias("candidates"), F.min("found").alias("found"), F.min("tgt_kind").alias("tgt_kind"))
    out = e.join(hits, "no", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    one = F.col("candidates") == 1
    return n, cut(out.select("src", F.when(one, F.col("found")).otherwise(F.concat_ws(":", "source", "raw")).alias("tgt"), "kind", "attrs", "file", "line", "ord", "raw", "source", "source_at", "src_kind", F.when(one, F.col("tgt_kind")).alias("tgt_kind"), "candidates"))


def duplicates(n: DataFrame) -> DataFrame:
    """CROSS_SOURCE_DUPLICATE_ID for each raw id that several sources declare."""
    g = n.groupBy("raw").agg(F.array_sort(F.collect_set("source")).alias("sources")).filter("size(sources) > 1")  # as many as there are sources
    return g.select(F.lit("CROSS_SOURCE_DUPLICATE_ID").alias("code"), F.concat(F.lit("raw ID '"), "raw", F.lit("' occurs in "), F.array_join("sources", ", ")).alias("message"), F.lit(None).cast("string").alias("node_id"), F.lit("<fuse-source>").alias("file"), F.lit(0).cast("long").alias("line"))


def ambiguous(e: DataFrame) -> DataFrame:
    """AMBIGUOUS_CROSS_REF for each edge whose target fits several nodes."""
    m = F.concat(F.lit("edge '"), "src", F.lit("' -> '"), "raw", F.lit("' (kind '"), "kind", F.lit("') fits "), F.col("candidates").cast("string"), F.lit(" nodes"))
    return e.filter("candidates > 1").select(F.lit("AMBIGUOUS_CROSS_REF").alias("code"), m.alias("message"), F.col("src").alias("node_id"), "file", "line", "source")


def fuse(sources: dict[str, tuple[Register, Profile]], f: FuseProfile, strict: bool = False) -> tuple[Register, DataFrame]:
    """The composed register (edges with one target) and the findings on it: source, severity, code, message, node_id, file, line, suppressed.

    Each source's own findings stay, save those that the whole settles: dangling targets that were found elsewhere, and all findings on nodes without edges, which the whole is asked for again, with the
    severities and suppressions of their source. An edge without one target is no edge of the whole, but its ends count as linked."""
    check_endpoints(f, {s: p for s, (_, p) in sources.items()})
    n, e = compose({s: r for s, (r, _) in sources.items()}, f)
    spark = n.sparkSession
    # The sources' findings, ids qualified.
    told = []
    for s, (r, p) in sources.items():
        x = validate.validate(r, p, strict)
        told.append(x.select(F.lit(s).alias("source"), "severity", "code", "message", F.when(F.col("node_id").isNotNull(), F.concat_ws(":", F.lit(s), "node_id")).alias("node_id"), "file", "line", "suppressed"))
    told = cut(rel._union(told))
    settled = e.filter("candidates = 1").select("source", F.col("src").alias("node_id"), F.lit("VACANCY").alias("code"), F.concat(F.lit("tgt "), "raw", F.lit(" isn't declared")).alias("message")).distinct()
    kept = told.filter(~F.col("code").isin(*ORPHANS)).join(settled, ["source", "node_id", "code", "message"], "left_anti").select(*COLUMNS)

    # The whole's own.
    r = Register(n.select("id", "kind", "attrs", "file", "line", (F.col("source_at") * F.lit(1 << 50) + F.col("ord")).alias("ord")), e.filter("candidates = 1").select("src", "tgt", "kind", "attrs", "file", "line", (F.col("source_at") * F.lit(1 << 50) + F.col("ord")).alias("ord")))
    pairs = {k: list(v) for k, v in f.edge_kinds.items()}
    for s, (_, p) in sources.items():
        for k, v in p.edge_kinds.items():
            pairs[k] = [*pairs.get(k, []), *((f"{s}:{a}", f"{s}:{b}") for a, b in v)]
    for x in e.filter("candidates = 1").select("kind", "src_kind", "tgt_kind").distinct().collect():  # kinds, as many as profiles declare
        if x.src_kind and (x.src_kind, x.tgt_kind) not in pairs.setdefault(x.kind, []):
            pairs[x.kind].append((x.src_kind, x.tgt_kind))
    kinds = {f"{s}:{k}": replace(v, pattern=".*", attrs={}) for s, (_, p) in sources.items() for k, v in p.node_kinds.items()}
    p = Profile(kinds, pairs, validations=f.validations, overrides=f.overrides, suppressions=f.suppressions)
    mine = validate.collect(r, p).filter("code <> 'EMPTY_KIND'")
    loose = e.filter("candidates <> 1")
    leaves = loose.select(F.col("src").alias("node_id"), F.lit("UNTRACED").alias("code"))
    reaches = loose.select(F.col("tgt").alias("node_id"), F.lit("UNREFERENCED").alias("code"))
    mine = mine.join(leaves.union(reaches).distinct(), ["node_id", "code"], "left_anti")
    # Nodes without edges are judged by their source's profile.
    judged = [(s, c, x.overrides.get(c) or validate.SEVERITY[c]) for s, (_, x) in sources.items() for c in ORPHANS if c not in f.overrides]
    if judged:
        by_source = F.broadcast(spark.createDataFrame(judged, "source string, code string, theirs string"))
        mine = mine.withColumn("source", F.substring_index("node_id", ":", 1)).join(by_source, ["source", "code"], "left").withColumn("own", F.col("own") | F.col("theirs").isNotNull()).withColumn("severity", F.coalesce("theirs", "severity")).drop("theirs", "source")
    names = {s: x for s, (_, x) in sources.items()}
    off = [F.col("source").eqNullSafe(F.lit(s)) & F.col("kind").endswith(f":{k}") & ~F.col("raw").rlike(rf"(?U)\A(?:{v.pattern})\z") & (F.col("kind") == f"{s}:{k}") for s, x in names.items() for k, v in x.node_kinds.items()]
    wrong = n.filter(reduce(lambda a, b: a | b, off, F.lit(False)))
    mine = mine.unionByName(validate._finding(wrong, "ID_FORMAT", F.concat(F.lit("node '"), "id", F.lit("' doesn't fit the pattern of "), "kind"), F.col("id")).select(*mine.columns))
    more = duplicates(n).withColumn("source", F.lit(None).cast("string")).unionByName(ambiguous(e)).withColumn("severity", F.lit("error"))
    more = more.select(F.lit(False).alias("own"), "severity", "code", "message", "node_id", "file", "line", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("template"))
    mine = validate.finish(mine.select(*more.columns).unionByName(more), r, p, strict)
    hushed = told.filter(F.col("code").isin(*ORPHANS) & F.col("suppressed")).select("code", "node_id", F.lit(True).alias("hushed")).distinct()
    mine = mine.join(hushed, ["code", "node_id"], "left").withColumn("suppressed", F.col("suppressed") | F.coalesce("hushed", F.lit(False)))
    sources_of = n.select(F.col("id").alias("node_id"), "source").dropDuplicates(["node_id"])
    mine = mine.join(sources_of, "node_id", "left").select(*COLUMNS)
    return r, kept.unionByName(mine)


def failure(name: str, why: object, spark) -> DataFrame:
    """SOURCE_FAILURE: a source that couldn't be read; the run has no answer besides."""
    return spark.createDataFrame([(name, "error", "SOURCE_FAILURE", f"source '{name}': {why}", None, "<fuse-source>", 0, False)], "source string, severity string, code string, message string, node_id string, file string, line long, suppressed boolean")
