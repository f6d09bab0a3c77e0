"""Profiles from YAML: inheritance, closed keys, every fault at once; and notes files."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from ..functions import templates
from ..functions.predicates import parse_block
from ..model import NodeKind, Profile
from . import symbols

#: Fixed values of the profile format: attribute types, list items, and the keys of each level.
TYPES = ("bool", "date", "enum", "int", "list", "string")
ITEMS = ("bool", "date", "int", "string")
MAJOR = 1
KEYS = {
    "profile": ("adapter", "annotations", "edge_kinds", "name", "node_kinds", "pathways", "profile_version", "validations"),
    "node kind": ("actions", "attrs", "id_names", "id_pattern", "orphan_ok", "summary_attr", "text_attrs", "text_chunk_line_prefix"),
    "attr": ("items", "required", "type", "values"),
    "edge kind": ("allowed", "cross_source"),
}
ENTRY_KEYS = {
    "COVERAGE": ("edge_kind", "message", "severity", "source_where", "target_kind", "where"),
    "COVERAGE_DEEP": ("evidence", "message", "severity", "source_where", "target_kind", "via", "where"),
    "CONSTRAINT": ("expect", "kind", "message", "reject", "severity", "when"),
    "EDGE_COUNT": ("direction", "edge_kind", "group_by", "max", "message", "min", "node_kind", "severity", "where"),
    "EDGE_WHERE": ("edge_kind", "expect", "message", "reject", "severity", "when"),
    "SUMMARY": ("group_by_attr", "message", "node_kind", "severity", "status_attr"),
    "SUPPRESS": ("code", "node_ids"),
}
ANY_ENTRY = ("message", "severity")
BINDING = ("pathway", "position_attr")
SEVERITIES = ("error", "warning", "info", "hint")


class ProfileError(ValueError):
    """A profile that can't be loaded; the message names all that is wrong with it."""


def _yaml(text: str, what: str) -> Any:
    import yaml

    class Loader(yaml.SafeLoader):
        """Dates stay strings, and only true and false are booleans."""

    plain = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.yaml_implicit_resolvers = plain
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|false)$"), list("tf"))
    try:
        return yaml.load(text, Loader)  # noqa: S506
    except yaml.YAMLError as e:
        raise ProfileError(f"{what}: {e}") from e


def check_version(key: str, value: object, major: int = MAJOR) -> str:
    """X.Y.Z without leading zeros, of a supported major."""
    if not isinstance(value, str) or not re.fullmatch(r"(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*)){2}", value):
        raise ProfileError(f"{key} must be a version X.Y.Z, got {value!r}")
    if int(value.split(".")[0]) > major:
        raise ProfileError(f"{key} {value}: majors up to {major} are supported")
    return value


def merge(parent: Any, child: Any) -> Any:
    """Mappings merge key by key, the child's winning; anything else is replaced."""
    if isinstance(parent, dict) and isinstance(child, dict):
        return {k: merge(parent[k], child[k]) if k in parent and k in child else child.get(k, parent.get(k)) for k in [*parent, *(k for k in child if k not in parent)]}
    return child


def read_raw(path: str, above: tuple[str, ...] = ()) -> dict:
    """The YAML of a file merged over what it extends."""
    real = os.path.realpath(path)
    if real in above:
        raise ProfileError(f"profile inheritance cycle: {path}")
    if not os.path.exists(path):
        folder = os.path.dirname(path) or "."
        beside = sorted(f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if f.endswith((".yaml", ".yml")) and re.search("^node_kinds:", open(os.path.join(folder, f), encoding="utf-8").read(), re.M))
        raise ProfileError(f"no profile at {path}; " + (f"profiles beside it: {', '.join(beside)}" if beside else f"no profile found in '{folder}'"))
    raw = _yaml(open(path, encoding="utf-8").read(), path)
    if not isinstance(raw, dict):
        raise ProfileError(f"profile {path}: a mapping is expected")
    if "annotations" in raw:
        if not isinstance(raw["annotations"], str):
            raise ProfileError(f"profile {path}: 'annotations' must be a path")
        raw["annotations"] = os.path.abspath(os.path.join(os.path.dirname(path), raw["annotations"]))
    if "extends" in raw:
        parent = raw.pop("extends")
        if not isinstance(parent, str):
            raise ProfileError(f"profile {path}: 'extends' must be a path")
        if "profile_version" not in raw:
            raise ProfileError(f"profile {path}: a child declares its own profile_version")
        raw = merge(read_raw(os.path.join(os.path.dirname(path), parent), (*above, real)), raw)
    return raw


class _Faults(list):
    def keys(self, raw: object, allowed: tuple, where: str) -> dict:
        if not isinstance(raw, dict):
            self.append(f"{where}: a mapping is expected")
            return {}
        if unknown := sorted(str(k) for k in raw if k not in allowed):
            self.append(f"{where}: unknown keys {unknown} (valid: {sorted(allowed)})")
        return raw

    def block(self, raw: object, where: str) -> dict:
        if raw is None:
            return {}
        if not isinstance(raw, dict):
            self.append(f"{where}: a mapping is expected")
            return {}
        try:
            return parse_block(raw)
        except ValueError as e:
            self.append(f"{where}: {e}")
            return {}

    def sides(self, raw: object, where: str) -> dict:
        raw = self.keys(raw if raw is not None else {}, ("edge", "source", "target"), where)
        return {k: self.block(v, f"{where}.{k}") for k, v in raw.items()}


def _attr(f: _Faults, raw: object, where: str) -> dict:
    raw = f.keys({"type": raw} if isinstance(raw, str) else raw, KEYS["attr"], where)
    kind, out = raw.get("type"), {}
    if kind not in TYPES:
        f.append(f"{where}: unknown type {kind!r} (valid: {', '.join(TYPES)})")
    if not isinstance(raw.get("required", False), bool):
        f.append(f"{where}: 'required' must be a boolean")
    if kind == "enum":
        values = raw.get("values")
        if not isinstance(values, list) or not values or not all(isinstance(v, str) for v in values):
            f.append(f"{where}: enum type requires 'values' (a list of strings)")
        out["values"] = values
    if kind == "list":
        if raw.get("items") not in ITEMS:
            f.append(f"{where}: list type requires 'items' (valid: {', '.join(ITEMS)})")
        out["items"] = raw.get("items")
    return {"type": kind, "required": raw.get("required", False), **out}


def _node_kind(f: _Faults, name: str, raw: object) -> NodeKind:
    where = f"node kind '{name}'"
    raw = f.keys(raw, KEYS["node kind"], where)
    pattern = raw.get("id_pattern")
    if not isinstance(pattern, str):
        f.append(f"{where}: missing 'id_pattern'")
        pattern = ".*"
    elif re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        f.append(f"{where}: lookaround and backreferences aren't part of the pattern language")
    if raw.get("id_names") is not None:
        try:
            symbols.form(raw["id_names"])
        except ValueError as e:
            f.append(f"{where}: id_names: {e}")
    declared = {a: _attr(f, spec, f"{where} attr '{a}'") for a, spec in (raw.get("attrs") or {}).items()}
    for key in ("summary_attr", "text_attrs"):
        for a in [raw[key]] if isinstance(raw.get(key), str) else raw.get(key) or []:
            if a not in declared:
                f.append(f"{where}: '{key}' names the undeclared attr '{a}'")
    return NodeKind(pattern, declared, raw.get("summary_attr"), bool(raw.get("orphan_ok", False)), None if raw.get("text_attrs") is None else tuple(raw["text_attrs"]), raw.get("text_chunk_line_prefix"), raw.get("id_names"))


def _entry(f: _Faults, code: str, raw: object, p: dict) -> None:
    raw = f.keys(raw, (*ENTRY_KEYS.get(code, ANY_ENTRY), *(() if code == "SUPPRESS" else BINDING)), code)
    nodes, edges = p["node_kinds"], p["edge_kinds"]
    for key, known in (("target_kind", nodes), ("node_kind", nodes), ("kind", nodes), ("edge_kind", edges), ("via", edges), ("evidence", edges)):
        if key in ENTRY_KEYS.get(code, ()) and code not in ("SUMMARY", "SUPPRESS"):
            if key not in raw:
                f.append(f"{code}: missing '{key}'")
            elif raw[key] not in known:
                f.append(f"{code}: '{key}' names the undeclared kind {raw[key]!r}")
    if code == "SUPPRESS":
        ids = raw.get("node_ids")
        if not isinstance(raw.get("code"), str) or not (ids is None or isinstance(ids, list) and ids and all(isinstance(i, str) for i in ids)):
            f.append("SUPPRESS: 'code' must be a string and 'node_ids' a list of strings")
        else:
            p["suppressions"].append((raw["code"], tuple(ids) if ids else None))
        return
    severity = raw.get("severity")
    if severity is not None:
        if severity not in SEVERITIES:
            f.append(f"{code}: unknown severity {severity!r}")
        else:
            p["overrides"][code] = severity
    if ("pathway" in raw) != ("position_attr" in raw):
        f.append(f"{code}: 'pathway' and 'position_attr' go together")
    elif "pathway" in raw:
        if raw["pathway"] not in p["pathways"]:
            f.append(f"{code}: the profile declares no pathway {raw['pathway']!r}")
        p["pathway_bindings"][code] = (raw["pathway"], raw["position_attr"])
    template = raw.get("message")
    if template is not None:
        try:
            templates.parse(str(template))
        except ValueError as e:
            f.append(f"{code}: {e}")
    if code not in ENTRY_KEYS:
        if template is not None:
            p["templates"][code] = str(template)
        return
    v = {"code": code, **{k: raw[k] for k in raw if k not in ("where", "source_where", "when", "expect", "reject", "pathway", "position_attr")}}
    for key in ("where", "source_where"):
        if key in raw:
            v[key] = f.block(raw[key], f"{code}.{key}")
    for key in ("when", "expect", "reject"):
        if key in raw:
            v[key] = f.sides(raw[key], f"{code}.{key}") if code == "EDGE_WHERE" else f.block(raw[key], f"{code}.{key}")
    if code in ("CONSTRAINT", "EDGE_WHERE") and not (v.get("expect") or v.get("reject")):
        f.append(f"{code}: 'expect' or 'reject' is needed")
    if code == "CONSTRAINT":
        v["node_kind"] = v.pop("kind", None)
    if code == "EDGE_COUNT":
        bounds = [raw.get(k) for k in ("min", "max")]
        if all(b is None for b in bounds) or any(b is not None and (isinstance(b, bool) or not isinstance(b, int) or b < 0) for b in bounds):
            f.append("EDGE_COUNT: 'min' or 'max' is needed, as integers from 0")
        elif None not in bounds and bounds[0] > bounds[1]:
            f.append("EDGE_COUNT: 'min' is above 'max'")
        if raw.get("direction", "out") not in ("in", "out"):
            f.append("EDGE_COUNT: 'direction' must be in or out")
    p["validations"].append(v)


def compile_profile(raw: dict, where: str = "profile") -> Profile:
    """A merged mapping -> Profile. Raises ProfileError with all faults."""
    f = _Faults()
    raw = f.keys(raw, KEYS["profile"], where)
    try:
        check_version("profile_version", raw.get("profile_version"))
    except ProfileError as e:
        f.append(str(e))
    ways = raw.get("pathways") or {}
    p = {"pathways": tuple(ways), "overrides": {}, "suppressions": [], "pathway_bindings": {}, "templates": {}, "validations": []}
    p["node_kinds"] = {k: _node_kind(f, str(k), v) for k, v in (raw.get("node_kinds") or {}).items()}
    p["edge_kinds"], cross = {}, set()
    for k, v in (raw.get("edge_kinds") or {}).items():
        v = f.keys(v if v is not None else {}, KEYS["edge kind"], f"edge kind '{k}'")
        pairs = v.get("allowed") or []
        if not all(isinstance(x, list) and len(x) == 2 for x in pairs):
            f.append(f"edge kind '{k}': 'allowed' must be a list of pairs")
            pairs = []
        for kind in {e for x in pairs for e in x if e not in p["node_kinds"]}:
            f.append(f"edge kind '{k}': undeclared node kind '{kind}'")
        p["edge_kinds"][k] = [tuple(x) for x in pairs]
        if v.get("cross_source"):
            cross.add(k)
    for entry in raw.get("validations") or []:
        if not isinstance(entry, dict):
            f.append("a validations entry must be a mapping")
            continue
        for code, config in entry.items():
            _entry(f, str(code), config if config is not None else {}, p)
    if f:
        raise ProfileError("; ".join(f))
    p |= {"suppressions": tuple(p["suppressions"]), "validations": tuple(p["validations"]), "cross_source": frozenset(cross)}
    return Profile(name=str(raw.get("name", where)), raw=raw, notes=raw.get("annotations"), **p)


def load(path: str) -> Profile:
    return compile_profile(read_raw(path), os.path.basename(path))


def resolved(p: Profile) -> str:
    """The merged profile as one JSON document."""
    return json.dumps({**p.raw, "resolved_schema": "1"}, ensure_ascii=True, sort_keys=True)


def read_notes(path: str) -> list[tuple[int, object]] | None:
    """(line, entry) of a notes file in its order; None if there is no such file. Entries are checked as they are attached."""
    import yaml

    if not os.path.exists(path):
        return None
    text = open(path, encoding="utf-8").read()
    items = _yaml(text, path)
    if items is None:
        return []
    if not isinstance(items, list):
        raise ProfileError(f"notes file {path}: a list of entries is expected")
    return list(zip((n.start_mark.line + 1 for n in yaml.compose(text).value), items, strict=True))
