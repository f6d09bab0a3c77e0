"""One entry for programs: a view of a register, a request, and a response that says what it was computed from. And exit codes."""

from __future__ import annotations

import posixpath
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import condition, filters
from ..model import Profile, Register
from ..operators import graph, reports, walks
from ..operators import relations as rel
from ..sources import document, files, issues, markdown, prose, specs, symbols, toml_tables
from . import validate


@dataclass(frozen=True)
class Context:
    """identity: the host's name of the snapshot; scope: the records it covers, None if unknown; complete: the host says that all of the scope is there; today: the day notes are judged by."""

    identity: str | None = None
    scope: str | None = None
    complete: bool = False
    today: str | None = None


@dataclass
class View:
    register: Register
    profile: Profile
    context: Context = field(default_factory=Context)


@dataclass
class Response:
    """payload: a frame, or several by name; diagnostics: the findings that came with the inputs, by side."""

    payload: DataFrame | dict[str, DataFrame]
    inputs: list[tuple[str, Context]]
    diagnostics: list[tuple[str, DataFrame | None]]
    execution: str = "completed"


def unreadable(r: Register) -> bool:
    """No node at all and an error among the findings that came with the register: there is nothing to answer on."""
    return r.findings is not None and not r.nodes.limit(1).count() and bool(r.findings.filter("severity = 'error'").limit(1).count())


def _candidates(target: str, path: str) -> list[str]:
    """The spellings under which a path may stand in a register that was read at target: relative to it, as given, and absolute, . and .. parts resolved."""
    absolute = posixpath.normpath(path if path.startswith("/") else posixpath.join(target, path))
    root = posixpath.normpath(target)
    out = [posixpath.normpath(path), absolute]
    if absolute == root:
        out.append(".")
    elif absolute.startswith(root.rstrip("/") + "/"):
        out.append(absolute[len(root.rstrip("/")) + 1 :])
    return list(dict.fromkeys(out))


def at(v: View, target: str, path: str, exists: bool = False, where: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Entries and findings of a file or folder. Refused if nothing stands there and the host has no such path either, which is a typing error rather than an empty answer."""
    ways = _candidates(target, path)

    def here(df: DataFrame) -> DataFrame:
        c = F.lit(False)
        for w in ways:
            c = c | (~F.col("file").startswith("/") if w == "." else (F.col("file") == w) | F.col("file").startswith(w + "/"))
        return df.filter(c)

    nodes, found = here(v.register.nodes), here(validate.validate(v.register, v.profile, today=v.context.today))
    if not exists and not nodes.limit(1).count() and not found.limit(1).count():
        raise walks.QueryError(f"nothing was read from '{path}'")
    return {"entries": nodes.filter(filters(list(where))) if where else nodes, "findings": found}


def rollup_with_totals(r: Register, kind: str, status: str, group_by: str, values: list[str] | None = None) -> DataFrame:
    """The status table in long form, with a total of each status over all groups (grp null) and of all (status null too)."""
    long = rel.rollup_long(r, kind, status, group_by, values).select("grp", "status", "n")
    return long.rollup("status", "grp").agg(F.sum("n").alias("n"), F.grouping("grp").alias("g"), F.grouping("status").alias("s")).select("grp", "status", "n", (F.col("g") + F.col("s") > 0).alias("is_total"))


def summary(v: View) -> DataFrame:
    """The profile's SUMMARY as a status table, or counts by kind and finding."""
    entry = next((x for x in v.profile.validations if x["code"] == "SUMMARY"), None)
    if entry:
        spec = v.profile.node_kinds[entry["node_kind"]].attrs.get(entry["status_attr"], {})
        return rollup_with_totals(v.register, entry["node_kind"], entry["status_attr"], entry["group_by_attr"], spec.get("values"))
    return reports.summary(v.register, v.profile, validate.validate(v.register, v.profile, today=v.context.today))


def path(v: View, src: str, tgt: str, kinds: list[str]) -> DataFrame:
    for x in (src, tgt):
        walks.check_node(v.register, x)
    walks.check_edge_kinds(v.profile, kinds)
    return graph.path(v.register.edges.filter(F.col("kind").isin(*kinds)), src, tgt)


def orphans(v: View, kind: str | None = None, where: tuple[str, ...] = ()) -> DataFrame:
    if kind is not None:
        walks.check_kind(v.profile, kind)
    d = rel.orphans(v.register, filters(list(where)) if where else None)
    return (d.filter(F.col("kind") == kind) if kind is not None else d).select("id", "kind").orderBy("id")


def counts(v: View, where: tuple[str, ...] = ()) -> DataFrame:
    """Nodes of each kind that the filters admit, and all edges of each kind; declared kinds with 0."""
    r = Register(v.register.nodes.filter(filters(list(where))), v.register.edges) if where else v.register
    return rel.counts(r, v.profile)


def trace(v: View, strict: bool = False) -> dict[str, DataFrame]:
    entries, lost = reports.trace(v.register, validate.validate(v.register, v.profile, strict, v.context.today))
    return {"entries": entries, "unattachable": lost}


REQUESTS: dict[str, Callable] = {
    "validate": lambda v, strict=False: validate.validate(v.register, v.profile, strict, v.context.today),
    "reach": lambda v, origin, edge_kinds, reverse=False, where=(), check_resolved=False: walks.reach(v.register, v.profile, origin, edge_kinds, reverse, list(where), check_resolved),
    "path": path,
    "orphans": orphans,
    "counts": counts,
    "coverage": lambda v: rel.coverage_report(v.register),
    "at": at,
    "summary": summary,
    "trace": trace,
}


def _check(context: Context) -> None:
    if context.complete and context.scope is None:
        raise walks.QueryError("complete input status requires a declared scope")


def execute(v: View, request: str, **arguments) -> Response:
    """Answers a request on a view; the register isn't changed. Refuses views that can't be read, whose answers would look like empty ones."""
    _check(v.context)
    if request not in REQUESTS:
        raise walks.QueryError(f"unknown request '{request}'; there are {', '.join(REQUESTS)}")
    if request not in ("validate", "trace", "summary") and unreadable(v.register):
        raise walks.QueryError("the register could not be read; its errors say why")
    return Response(REQUESTS[request](v, **arguments), [("view", v.context)], [("view", v.register.findings)])


def compare(a: View, b: View) -> Response:
    """What changed between two snapshots: nodes, edges, and pathways by name."""
    for v in (a, b):
        _check(v.context)
    nodes, edges = rel.diff(a.register, b.register)
    return Response({"nodes": nodes, "edges": edges, "pathways": pathway_diff(a.register, b.register)}, [("before", a.context), ("after", b.context)], [("before", a.register.findings), ("after", b.register.findings)])


def pathway_diff(a: Register, b: Register) -> DataFrame:
    """name, change (added, removed or changed), before, after, over the pathways of either."""
    told = lambda r, n: None if n not in r.pathways else " ".join(f"[{x}]" if x == r.pathways[n][1] else x for x in r.pathways[n][0])
    rows = [(n, told(a, n), told(b, n)) for n in sorted({*a.pathways, *b.pathways})]
    rows = [(n, "added" if x is None else "removed" if y is None else "changed", x, y) for n, x, y in rows if x != y]
    return a.nodes.sparkSession.createDataFrame(rows, "name string, change string, before string, after string")


def exit_code(run: Callable[[], DataFrame], gating: bool = True) -> int:
    """0: nothing gates; 1: an error that isn't suppressed (validation only); 2: it could not run."""
    try:
        found = run()
        return validate.gate(found) if gating else 0
    except ValueError:  # contract, profile, fuse and query errors
        return 2


READERS: dict[str, Callable] = {
    "markdown": lambda found, p, adapter: markdown.read_markdown(found, adapter, list(p.node_kinds)),
    "toml": lambda found, p, adapter: toml_tables.read_toml(found, adapter),
    "prose-xref": lambda found, p, adapter: prose.read_prose(found, adapter["paths"]["content_dirs"]),
}
READERS |= {"md": READERS["markdown"], "entomologist": lambda found, p, adapter: issues.read_issues(found), "openspec": lambda found, p, adapter: specs.read_specs(found)}


def load(spark, p: Profile, target: str, adapter: str | None = None, timeout: float = 60) -> Register:
    """The register at a folder, by the adapter that is asked for or that the profile names: a reader of this package, or a program that prints an interface document."""
    config = p.raw.get("adapter") or {}
    name = adapter or config.get("native")
    if not name:
        raise walks.QueryError("no adapter was chosen and the profile names none")
    if name not in READERS:
        return run_program(spark, [name, "--target", target], timeout)
    globs = config.get("paths", {}).get("files", [])
    found = files.read_folder(spark, target, globs)
    r = READERS[name](found, p, config)
    more = [files.no_matching(found, globs, target, files.read_folder(spark, target, ["**"]))]
    named = {k: v.names for k, v in p.node_kinds.items() if v.names is not None}
    if named:
        more.append(symbols.missing(r.nodes, files.read_folder(spark, target, ["**"]), named))
    columns = ["severity", "code", "message", "node_id", "file", "line"]
    told = [x.select(*columns) for x in (r.findings, *more) if x is not None]
    return Register(r.nodes, r.edges, r.pathways, rel._union(told) if told else None)


def run_program(spark, command: list[str], timeout: float = 60) -> Register:
    """Runs an external adapter on the driver, for timeout seconds at most, and reads the document it prints."""
    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout, check=False)  # noqa: S603
    except (OSError, subprocess.TimeoutExpired) as e:
        raise document.ContractError(f"adapter {command[0]}: {e}") from e
    if done.returncode:
        raise document.ContractError(f"adapter {command[0]} ended with {done.returncode}: {done.stderr.decode('utf-8', 'replace').strip()[-2000:]}")
    return document.read(spark.createDataFrame([(0, done.stdout.decode("utf-8"))], "doc long, text string"))


def absent_filter_attrs(v: View, where: list[str]) -> DataFrame:
    """Attributes of filters that no node has: a warning beside the answer."""
    from ..functions.predicates import parse_filter

    return reports.absent_attrs(v.register.nodes, sorted({parse_filter(w)[0] for w in where}))


__all__ = ["Context", "View", "Response", "execute", "compare", "exit_code", "load", "condition"]
