"""Validators, each a frame of findings, and what happens to findings afterwards."""

from __future__ import annotations

import datetime
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates
from ..functions.predicates import as_json, block, first_failing, has_type
from ..model import FINDING, Profile, Register
from ..operators import graph
from ..operators import relations as rel
from ..sources import profiles
from ..sources.document import literal_of

#: Default severities by code, fixed values of the register format.
SEVERITY = {
    "ID_FORMAT": "error", "UNKNOWN_KIND": "error", "EDGE_CONSTRAINT": "error", "VACANCY": "error", "ATTR_REQUIRED": "error", "ATTR_TYPE": "error", "ATTR_ENUM": "error",
    "ATTR_LIST_ITEMS": "error", "NOTE_INVALID": "error", "CONFIG_ERROR": "error", "PARSE_ERROR": "error", "UNREFERENCED": "warning", "UNTRACED": "warning", "COVERAGE": "warning",
    "COVERAGE_DEEP": "warning", "CONSTRAINT": "warning", "EDGE_WHERE": "warning", "EDGE_COUNT": "warning", "PATHWAY_UNRESOLVED": "warning", "NOTE_FILE_MISSING": "warning",
    "NOTE_EXPIRED": "warning", "EMPTY_KIND": "info", "SUPPRESS_UNUSED": "info", "OVERRIDE_UNUSED": "info", "NOTE_UNUSED": "info", "COVERAGE_UNKNOWN": "hint", "SUGGESTED_EDGE": "hint",
    "SUGGESTION_UNRESOLVED": "hint", "SUGGESTION_UNRANKED": "hint",
}
#: Codes that only adapters and the fusing of registers emit, with severities of their own.
OTHER_CODES = {
    "AMBIGUOUS_CROSS_REF", "AMBIGUOUS_REF", "CROSS_SOURCE_DUPLICATE_ID", "EXTERNAL_REF", "FUSE_ERROR", "NO_MATCHING_FILES", "PATHWAY_INVALID", "SOURCE_FAILURE", "SOURCE_MISSING",
    "UNREAD_ENTRIES", "WRAPPED_REF",
}
GATING = "severity = 'error' and not suppressed"


def _finding(df: DataFrame, code: str, message: Column, node_id: Column | None = None, severity: str | None = None, template: str | None = None) -> DataFrame:
    """own: the severity is stated by the entry itself, so no override of the code changes it; template: the entry's own message."""
    at = [F.col(c) if c in df.columns else F.lit(d) for c, d in (("file", "<profile>"), ("line", 0))]
    state = F.col("state") if "state" in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(severity is not None).alias("own"), F.lit(severity or SEVERITY[code]).alias("severity"), F.lit(code).alias("code"), message.alias("message"), (F.lit(None).cast("string") if node_id is None else node_id).alias("node_id"), at[0].alias("file"), at[1].cast("bigint").alias("line"), state.alias("state"), F.lit(template).cast("string").alias("template"))


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _told(when: Column, code: str, message: Column, node_id: Column | None = None, severity: str | None = None, template: str | None = None, at: tuple[Column, Column] | None = None) -> Column:
    """A finding as a struct where a condition holds, else null; at: where, if not the row's own place."""
    file, line = at or (F.col("file"), F.col("line"))
    return F.when(when, _as_struct(code, message, node_id, severity, template, file, line))


def _as_struct(code: str, message: Column, node_id: Column | None, severity: str | None, template: str | None, file: Column, line: Column) -> Column:
    none = F.lit(None).cast("string")
    own = {"own": F.lit(severity is not None), "severity": F.lit(severity or SEVERITY[code]), "code": F.lit(code), "message": message, "node_id": none if node_id is None else node_id}
    return F.struct(*(c.alias(k) for k, c in {**own, "file": file, "line": line.cast("bigint"), "state": none, "template": F.lit(template).cast("string")}.items()))


def _spread(df: DataFrame, checks: list[Column], *many: Column) -> DataFrame:
    """All checks of a row in one pass over it; many: arrays of findings."""
    found = F.array_compact(F.array(*checks))
    return df.select(F.explode(F.concat(found, *many) if many else found).alias("f")).select("f.*")


def _located(nodes: DataFrame, attr: str) -> tuple[Column, Column]:
    """Where an attribute was written, else its node."""
    if "attr_prov" not in nodes.columns:
        return F.col("file"), F.col("line")
    own = F.col("attr_prov")[attr]
    return F.coalesce(own["file"], F.col("file")), F.coalesce(own["line"], F.col("line"))


def _attr_checks(nodes: DataFrame, kind: str, nk) -> tuple[list[Column], list[Column]]:
    checks, many, mine, id_ = [], [], F.col("kind") == kind, F.col("id")
    for name, spec in nk.attrs.items():
        has, value, type_, at = F.map_contains_key("attrs", name), F.col("attrs")[name], spec["type"], _located(nodes, name)
        fits = has_type(value, type_)
        if spec.get("required"):
            checks.append(_told(mine & ~has, "ATTR_REQUIRED", _say(f"{name} is required"), id_))
        shown = F.when(F.length(value) > 60, F.concat(F.substring(value, 1, 59), F.lit("…"))).otherwise(value)
        checks.append(_told(mine & has & ~fits, "ATTR_TYPE", _say(f"{name} isn't {type_}: ", shown), id_, at=at))
        if type_ == "enum":
            checks.append(_told(mine & fits & ~value.isin(*map(as_json, spec["values"])), "ATTR_ENUM", _say(f"{name} isn't one of its values: ", shown), id_, at=at))
        if type_ == "list" and spec.get("items"):
            each = F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda x, i: F.struct(i.alias("i"), literal_of(x).alias("v")))
            bad = F.filter(F.when(mine & fits, each), lambda x: ~has_type(x.v, spec["items"]))  # noqa: B023
            item = lambda x: _as_struct("ATTR_LIST_ITEMS", _say(f"{name}[", x.i.cast("string"), f"] isn't {spec['items']}"), id_, None, None, *at)  # noqa: B023, E731
            many.append(F.coalesce(F.transform(bad, item), F.array()))
    return checks, many


def node_checks(r: Register, p: Profile) -> list[DataFrame]:
    """Kinds, ids, attributes and links, in one pass over the nodes with their degrees. A node of an unknown kind gets no other finding."""
    d, kind, id_ = rel.degrees(r), F.col("kind"), F.col("id")
    checks, many = [_told(~kind.isin(*p.node_kinds), "UNKNOWN_KIND", _say("unknown kind ", kind), id_)], []
    off = reduce(lambda c, k: c.when(kind == k, ~id_.rlike(rf"(?U)\A(?:{p.node_kinds[k].pattern})\z")), p.node_kinds, F.when(F.lit(False), F.lit(False)))
    checks.append(_told(off, "ID_FORMAT", _say("id doesn't fit the pattern of ", kind), id_))
    for name, nk in p.node_kinds.items():
        one, several = _attr_checks(d, name, nk)
        checks += one
        many += several
    pairs = [x for v in p.edge_kinds.values() for x in v]
    expecting = [k for k, v in p.node_kinds.items() if not v.orphan_ok]
    checks.append(_told(kind.isin(*sorted({t for _, t in pairs} & set(expecting))) & ~F.col("has_incoming"), "UNREFERENCED", _say("nothing refers to it"), id_))
    checks.append(_told(kind.isin(*sorted({s for s, _ in pairs} & set(expecting))) & ~F.col("has_outgoing"), "UNTRACED", _say("it refers to nothing"), id_))
    return [_spread(d, checks, *many)]


def edge_checks(r: Register, p: Profile) -> list[DataFrame]:
    """Kinds, ends, allowed pairs and EDGE_WHERE rules, in one pass over the edges with both ends resolved once."""
    e, kind, src = rel.with_ends(r), F.col("kind"), F.col("src")
    known = kind.isin(*p.edge_kinds)
    checks = [_told(~known, "UNKNOWN_KIND", _say("unknown edge kind ", kind))]
    for end in ("tgt", "src"):
        gone, message = known & F.col(f"{end}_kind").isNull(), _say(f"{end} ", F.col(end), " isn't declared")
        cross = kind.isin(*p.cross_source) if end == "tgt" and p.cross_source else F.lit(False)
        checks += [_told(gone & ~cross, "VACANCY", message, src), _told(gone & cross, "VACANCY", message, src, "hint")]
    pairs = {k: F.struct(F.col("src_kind").alias("s"), F.col("tgt_kind").alias("t")).isin(*(F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in v)) if v else F.lit(False) for k, v in p.edge_kinds.items()}
    allowed = reduce(lambda c, x: c.when(kind == x[0], x[1]), pairs.items(), F.when(F.lit(False), F.lit(True)))
    both = F.col("src_kind").isin(*p.node_kinds) & F.col("tgt_kind").isin(*p.node_kinds)
    checks.append(_told(known & both & ~allowed, "EDGE_CONSTRAINT", _say("no ", kind, " from ", F.col("src_kind"), " to ", F.col("tgt_kind")), src))
    sides = {"edge": F.col("attrs"), "source": F.col("src_attrs"), "target": F.col("tgt_attrs")}
    for v in p.validations:
        if v["code"] == "EDGE_WHERE":
            why = F.coalesce(*(first_failing(v.get(what, {}).get(s, {}), c, what == "expect") for what in ("expect", "reject") for s, c in sides.items()))
            checks.append(_told(both & (kind == v["edge_kind"]) & _both(v.get("when", {}), sides, True) & why.isNotNull(), "EDGE_WHERE", why, src, v.get("severity"), v.get("message")))
    return [_spread(e, checks)]


def _both(blocks: dict, sides: dict[str, Column], expect: bool) -> Column:
    return reduce(lambda a, b: a & b, (block(c, sides[s], expect) for s, c in blocks.items()), F.lit(True))


def _edge_count(r: Register, p: Profile, v: dict, where: Column | None) -> list[DataFrame]:
    """Counts out of bounds, with the far ends in order of declaration; and edges that group_by finds no value for. Ends of unknown kinds count for nothing."""
    group, low, high = v.get("group_by"), v.get("min"), v.get("max")
    r = Register(r.nodes.filter(F.col("kind").isin(*p.node_kinds)), r.edges)
    at = (r, v["node_kind"], v["edge_kind"], v.get("direction", "out"), group, where)
    way, far = ("outgoing", "target") if at[3] == "out" else ("incoming", "source")
    off = (F.col("n") < F.lit(low or 0)) | (F.col("n") > F.lit(1 << 62 if high is None else high))
    bounds = "any count" if low is None and high is None else f"at most {high}" if low is None else f"at least {low}" if high is None else f"exactly {low}" if low == high else f"{low} to {high}"
    c, e = rel.edge_counts(*at).filter(off), rel.edge_ends(*at)
    same = (F.col("c.id") == F.col("e.id")) & F.col("c.value").eqNullSafe(F.col("e.value"))
    ends = F.transform(F.array_sort(F.collect_list(F.when(F.col("e.id").isNotNull(), F.struct("e.ord", "e.line", "e.far", "e.file")))), lambda x: _say("'", x.far, "' (", x.file, ":", x.line.cast("string"), ")"))
    c = c.alias("c").join(e.alias("e"), same, "left").groupBy("c.id", "c.value", "c.n").agg(F.array_join(ends, ", ").alias("ends"))
    of = F.when(F.col("value").isNull(), "").otherwise(_say(f" to a {far} with '{group}' = ", F.col("value")))
    tail = F.when(F.col("ends") == "", "").otherwise(_say(": ", F.col("ends")))
    c = c.join(r.nodes.select("id", "file", "line"), "id")
    out = [_finding(c, "EDGE_COUNT", _say("node '", F.col("id"), "' has ", F.col("n").cast("string"), f" {way} '{v['edge_kind']}' edge(s)", of, f", expected {bounds}", tail), F.col("id"), v.get("severity"), v.get("message"))]
    if group:
        why = _say("edge '", F.col("src"), "'->'", F.col("tgt"), f"' (kind '{v['edge_kind']}'): {far} '", F.col("far"), f"' has no '{group}' attr to group by")
        out.append(_finding(e.filter("value is null"), "EDGE_COUNT", why, F.col("id"), v.get("severity"), v.get("message")))
    return out


def _coverage_deep(r: Register, p: Profile, v: dict, where: Column | None) -> list[DataFrame]:
    """Coverage rolls up over all targets, whatever where says; where picks those that are reported. Sources that source_where refuses prove nothing."""
    t = r.nodes.filter(F.col("kind") == v["target_kind"])
    via = r.edges.filter(F.col("kind") == v["via"]) if v["via"] != v["evidence"] else r.edges.filter("false")
    inside = t.select("id")
    via = via.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    sw = block(v["source_where"]) if v.get("source_where") else None
    sources = r.nodes.filter(sw) if sw is not None else r.nodes
    proof = r.edges.filter(F.col("kind") == v["evidence"]).join(sources.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("tgt").alias("id"))
    shown = t.filter(where) if where is not None else t
    f = shown.join(graph.uncovered_causes(graph.deep_uncovered(inside, via, proof), via), "id")
    quoted = F.array_join(F.transform("children", lambda x: _say("'", x, "'")), ", ")
    why = F.when(F.col("members").isNotNull(), _say(f"in an uncovered '{v['via']}' cycle: ", F.array_join("members", ", "))).when(F.col("children").isNotNull(), _say("uncovered children: ", quoted)).otherwise("no evidence and no children")
    u = rel.unattributed(r, p, v["evidence"], sw, v["target_kind"]).filter("unattributed > 0")
    unknown = _say(F.col("unattributed").cast("string"), " of ", F.col("total").cast("string"), f" sources have no {v['evidence']} edge; deep coverage of {v['target_kind']} is unknown")
    return [_finding(f, "COVERAGE_DEEP", _say("node '", F.col("id"), f"' (kind '{v['target_kind']}') is not deep-covered: ", why), F.col("id"), v.get("severity"), v.get("message")), _finding(u, "COVERAGE_UNKNOWN", unknown)]


def rule_checks(r: Register, p: Profile) -> list[DataFrame]:
    out = []
    for v in p.validations:
        severity, code = v.get("severity"), v["code"]
        where = block(v["where"]) if v.get("where") else None
        if code == "EDGE_COUNT":
            out += _edge_count(r, p, v, where)
        elif code == "COVERAGE":
            sw = block(v["source_where"]) if v.get("source_where") else None
            told = rel.unattributed(r, p, v["edge_kind"], sw)  # one row: whether a missing edge is known to be missing
            gaps = rel.uncovered(r, v["target_kind"], v["edge_kind"], where, sw).drop("state").withColumn("_one", F.lit(1)).join(F.broadcast(told.select("state", F.lit(1).alias("_one"))), "_one", "left")
            out.append(_finding(gaps, code, _say(f"no {v['edge_kind']} edge"), F.col("id"), severity, v.get("message")))
            u = told.filter("unattributed > 0")
            out.append(_finding(u, "COVERAGE_UNKNOWN", _say(F.col("unattributed").cast("string"), " of ", F.col("total").cast("string"), f" sources have no {v['edge_kind']} edge")))
        elif code == "COVERAGE_DEEP":
            out += _coverage_deep(r, p, v, where)
        elif code == "CONSTRAINT":
            mine = r.nodes.filter((F.col("kind") == v["node_kind"]) & block(v.get("when", {})))
            why = F.coalesce(first_failing(v.get("expect", {})), first_failing(v.get("reject", {}), expect=False))
            out.append(_finding(mine.withColumn("_why", why).filter("_why is not null"), code, F.col("_why"), F.col("id"), severity, v.get("message")))
    return out


def empty_kinds(r: Register, p: Profile) -> list[DataFrame]:
    c = rel.counts(r, p).filter(F.col("n") == 0)
    return [_finding(c, "EMPTY_KIND", _say("no ", F.col("what"), " of kind ", F.col("kind")))]


def collect(r: Register, p: Profile) -> DataFrame:
    first, repeats = rel.first_declarations(r.nodes)
    r = Register(first, r.edges, r.pathways, r.findings)
    parts = [*empty_kinds(r, p), *node_checks(r, p), *edge_checks(r, p), *rule_checks(r, p), _finding(repeats, "PARSE_ERROR", _say("declared again"), F.col("id"))]
    if r.findings is not None:
        state = F.col("state") if "state" in r.findings.columns else F.lit(None).cast("string")
        parts.append(r.findings.select(F.lit(False).alias("own"), *FINDING, state.alias("state"), F.lit(None).cast("string").alias("template")))
    return rel._union(parts)


def demote(findings: DataFrame, r: Register, bindings: dict[str, tuple[str, str]]) -> DataFrame:
    """Errors and warnings of bound codes become info where the node's position is after the current one or off the pathway; without a position nothing changes."""
    values = r.nodes.select(F.col("id").alias("node_id"), F.col("attrs").alias("_a")).dropDuplicates(["node_id"])
    bindings = {c: b for c, b in bindings.items() if b[0] in r.pathways}
    if not bindings:
        return findings
    f = findings.join(values, "node_id", "left")
    for code, (name, attr) in bindings.items():
        if name in r.pathways:
            order, current = r.pathways[name]
            value = F.col("_a")[attr]
            early = value.isin(*map(as_json, order[: order.index(current) + 1]))
            late = (F.col("code") == code) & F.col("severity").isin("error", "warning") & value.startswith('"') & ~early
            f = f.withColumn("severity", F.when(F.coalesce(late, F.lit(False)), "info").otherwise(F.col("severity")))
    return f.drop("_a")


def _unused(f: DataFrame, p: Profile) -> DataFrame:
    """SUPPRESS_UNUSED for each entry with a node, or without nodes a code, that no finding has; entries for SUPPRESS_UNUSED itself are judged last and see the others' findings."""
    spark, code = f.sparkSession, "SUPPRESS_UNUSED"
    severity = p.overrides.get(code, SEVERITY[code])
    out = None
    for own in (False, True):
        entries = [(at, c, i) for at, (c, ids) in enumerate(p.suppressions) if (c == code) == own for i in (ids or [None])]
        if not entries:
            continue
        wanted = spark.createDataFrame(entries, "at int, code string, node_id string")
        seen = f.select("code", "node_id") if out is None else f.select("code", "node_id").union(out.select("code", "node_id"))
        seen = seen.join(F.broadcast(wanted.select("code").distinct()), "code", "left_semi").distinct()
        parts = []  # each reads all findings, so only those that are needed
        if any(i is not None for *_, i in entries):
            parts.append(wanted.filter("node_id is not null").join(seen, ["code", "node_id"], "left_anti").select("at", "code", "node_id"))
        if any(i is None for *_, i in entries):
            parts.append(wanted.filter("node_id is null").join(seen.select("code").distinct(), "code", "left_anti").select("at", "code", "node_id"))
        gone = rel._union(parts)
        gone = gone.groupBy("at", "code").agg(F.array_join(F.array_sort(F.collect_set("node_id")), ", ").alias("ids"))
        new = _finding(gone, code, _say("nothing to suppress: ", F.col("code"), F.when(F.col("ids") == "", "").otherwise(_say(" at ", F.col("ids")))), severity=severity)
        out = new if out is None else out.unionByName(new)
    return out


def promoted_hints(p: Profile, adapter: DataFrame | None, spark) -> DataFrame | None:
    """CONFIG_ERROR, once a code, where an override would promote a hint: of the core's own codes, and of findings that arrive as hints."""
    names = {c: s for c, s in p.overrides.items() if s != "hint"}
    mine = [c for c in names if SEVERITY.get(c) == "hint"]
    parts = [spark.createDataFrame([(c,) for c in mine], "promoted string")] if mine else []
    rest = [c for c in names if c not in SEVERITY or c == "PARSE_ERROR"]
    if adapter is not None and rest:
        parts.append(adapter.filter(F.col("code").isin(*rest) & (F.col("severity") == "hint")).select(F.col("code").alias("promoted")).distinct())
    return _finding(rel._union(parts), "CONFIG_ERROR", _say("severity override for '", F.col("promoted"), "': cannot promote from hint; the override is ignored")) if parts else None


def unresolved_pathways(f: DataFrame, r: Register, p: Profile) -> DataFrame | None:
    """PATHWAY_UNRESOLVED for each code that a finding has and that is bound to a pathway which the register doesn't supply."""
    gone = [(c, name) for c, (name, _) in p.pathway_bindings.items() if name not in r.pathways]
    if not gone:
        return None
    g = F.broadcast(f.sparkSession.createDataFrame(gone, "code string, pathway string"))
    hit = f.join(g, "code").select(F.col("code").alias("bound"), "pathway").distinct()
    return _finding(hit, "PATHWAY_UNRESOLVED", _say(F.col("bound"), " is bound to the pathway '", F.col("pathway"), "', which the register doesn't supply"))


def unused_overrides(f: DataFrame, p: Profile) -> DataFrame | None:
    """OVERRIDE_UNUSED for each override of a code that nothing here emits and no finding has."""
    odd = [(c,) for c in p.overrides if c not in SEVERITY and c not in OTHER_CODES]
    if not odd:
        return None
    o = f.sparkSession.createDataFrame(odd, "unused string")
    seen = f.join(F.broadcast(o), F.col("code") == F.col("unused"), "left_semi").select("code").distinct()
    return _finding(o.join(seen, F.col("code") == F.col("unused"), "left_anti"), "OVERRIDE_UNUSED", _say("override for '", F.col("unused"), "': nothing emits this code and no finding carried it"))


def notes_frame(p: Profile, r: Register, items: list[tuple[int, object]], today: str, spark) -> tuple[DataFrame, DataFrame]:
    """A notes file's entries -> (notes: code, node_id, note, until, by, at, expired, line; NOTE_INVALID findings). The first entry of a (code, node) counts."""
    good, bad, first = [], [], {}
    date = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")

    def day(v: object, key: str) -> str:
        try:
            if isinstance(v, str) and date.fullmatch(v):
                return datetime.date.fromisoformat(v).isoformat()
        except ValueError:
            pass
        raise ValueError(f"'{key}' must be a YYYY-MM-DD date")

    def known(m: object, keys: tuple, where: str) -> dict:
        if not isinstance(m, dict):
            raise ValueError(f"{where} must be a mapping")
        if unknown := sorted(str(k) for k in m if k not in keys):
            raise ValueError(f"{where}: unknown keys {unknown}")
        return m

    def text(m: dict, key: str, needed: bool = True) -> str | None:
        v = m.get(key)
        if v is None and not needed and key not in m:
            return None
        if not isinstance(v, str) or not v.strip():
            raise ValueError(f"'{key}' must be a string that isn't empty")
        return v

    for line, item in items:
        try:
            m = known(item, ("finding", "note", "until", "by", "at"), "entry")
            of = known(m.get("finding"), ("code", "node"), "'finding'")
            code, node, note, by = text(of, "code"), text(of, "node"), text(m, "note"), text(m, "by", False)
            at = day(m["at"], "at") if "at" in m else None
            until, expired, u = None, False, m.get("until")
            if isinstance(u, dict):
                known(u, ("pathway", "position"), "'until'")
                way, position = text(u, "pathway"), text(u, "position")
                if way not in p.pathways or way not in r.pathways:
                    raise ValueError(f"until: no pathway '{way}' in the profile and the register")
                order, current = r.pathways[way]
                if position not in order:
                    raise ValueError(f"until: '{position}' is not a position on pathway '{way}'")
                until, expired = f"{way} {position}", order.index(position) <= order.index(current)
            elif "until" in m:
                until = day(u, "until")
                expired = today > until
            if (code, node) in first:
                raise ValueError(f"duplicates the entry for {code} on '{node}' at line {first[code, node]}")
            first[code, node] = line
            good.append((code, node, note, until, by, at, expired, line))
        except ValueError as e:
            bad.append((str(e), line))
    notes = spark.createDataFrame(good, "code string, node_id string, note string, until string, by string, at string, expired boolean, line long")
    faults = spark.createDataFrame([(b, p.notes, n) for b, n in bad], "why string, file string, line long")
    return notes, _finding(faults, "NOTE_INVALID", F.col("why"))


def with_notes(f: DataFrame, r: Register, p: Profile, today: str | None) -> DataFrame:
    """Attaches the notes of the profile's file to every finding of their code and node; a note that is invalid, unused or expired is a finding."""
    spark, empty = f.sparkSession, F.lit(None).cast("struct<text:string,until:string,by:string,at:string,expired:boolean>")
    if not p.notes:
        return f.withColumn("note", empty)
    items = profiles.read_notes(p.notes)
    if items is None:
        gone = spark.createDataFrame([(p.notes,)], "file string")
        return f.withColumn("note", empty).unionByName(_finding(gone, "NOTE_FILE_MISSING", _say("notes file ", F.col("file"), " does not exist")), allowMissingColumns=True)
    notes, faults = notes_frame(p, r, items, today or datetime.datetime.now(datetime.UTC).date().isoformat(), spark)
    n = notes.select("code", "node_id", F.struct(F.col("note").alias("text"), "until", "by", "at", "expired").alias("note"))
    out = f.join(F.broadcast(n), ["code", "node_id"], "left")  # a file that people write, read on the driver
    seen = f.join(F.broadcast(notes.select("code", "node_id")), ["code", "node_id"], "left_semi").select("code", "node_id").distinct()
    of = _say("note on ", F.col("code"), " for '", F.col("node_id"), "'")
    here = notes.select("*", F.lit(p.notes).alias("file"))
    unused = _finding(here.join(seen, ["code", "node_id"], "left_anti"), "NOTE_UNUSED", _say(of, " matched no finding"))
    late = _finding(here.filter("expired").join(seen, ["code", "node_id"], "left_semi"), "NOTE_EXPIRED", _say(of, " has expired: until ", F.col("until")))
    return rel._union([x.select(*_finding(here, "NOTE_UNUSED", of).columns) for x in (faults, unused, late)]).withColumn("note", empty).unionByName(out)


def with_messages(f: DataFrame, r: Register, p: Profile) -> DataFrame:
    """Findings say what their entry's template says, or else their code's."""
    texts = {**{f"{v['code']}/{v['message']}": v["message"] for v in p.validations if v.get("message")}, **p.templates}
    if not texts:
        return f
    nodes = r.nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("_kind"), F.col("attrs").alias("_attrs")).dropDuplicates(["node_id"])
    f = f.join(nodes, "node_id", "left")
    message = F.col("message")
    for code, text in p.templates.items():
        message = F.when(F.col("template").isNull() & (F.col("code") == code), templates.render(text, F.col("_kind"), F.col("_attrs"))).otherwise(message)
    for text in {v["message"] for v in p.validations if v.get("message")}:
        message = F.when(F.col("template") == text, templates.render(text, F.col("_kind"), F.col("_attrs"))).otherwise(message)
    return f.withColumn("message", message).drop("_kind", "_attrs")


def finish(findings: DataFrame, r: Register, p: Profile, strict: bool = False, today: str | None = None) -> DataFrame:
    """What happens to findings, in this order: overrides (a hint is never promoted, an entry's own severity stays), pathways, notes, what in the
    profile matched nothing, strict, suppression, message templates."""
    f = findings
    for c, empty in (("own", F.lit(False)), ("state", F.lit(None).cast("string")), ("template", F.lit(None).cast("string"))):
        if c not in f.columns:
            f = f.withColumn(c, empty)
    more = [x for x in (promoted_hints(p, r.findings, f.sparkSession),) if x is not None]
    f = rel._union([f, *more])
    if p.overrides:
        severity = reduce(lambda c, x: c.when(F.col("code") == x[0], x[1]), p.overrides.items(), F.when(F.lit(False), F.lit("")))
        f = f.withColumn("severity", F.when((F.col("severity") != "hint") & ~F.col("own"), F.coalesce(severity, F.col("severity"))).otherwise(F.col("severity")))
    way = unresolved_pathways(f, r, p)
    f = demote(f, r, p.pathway_bindings)
    f = f if way is None else f.unionByName(way)
    f = with_notes(f, r, p, today)
    odd = unused_overrides(f, p)
    f = f if odd is None else f.unionByName(odd, allowMissingColumns=True)
    if p.suppressions:
        f = f.unionByName(_unused(f, p), allowMissingColumns=True)
    if strict:
        f = f.withColumn("severity", F.when(F.col("severity") == "warning", "error").otherwise(F.col("severity")))
    hit = reduce(lambda a, b: a | b, ((F.col("code") == c) & (F.col("node_id").isin(*ids) if ids else F.lit(True)) for c, ids in p.suppressions), F.lit(False))
    return with_messages(f.withColumn("suppressed", F.coalesce(hit, F.lit(False))), r, p).drop("own", "template")


def validate(r: Register, p: Profile, strict: bool = False, today: str | None = None) -> DataFrame:
    """All findings of a register; ordered() gives a report's order."""
    return finish(collect(r, p), r, p, strict, today)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file", "line", "code", F.coalesce("node_id", F.lit("")), "message")


def gate(findings: DataFrame) -> int:
    """The exit code: 1 if an error isn't suppressed."""
    return int(bool(findings.filter(GATING).limit(1).count()))
