"""Whether ids that are addresses name something: files, and functions in Python, Rust and Go sources."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Presets and file endings, fixed values of the profile format.
PRESETS = {"file": None, "cargo": ("rust", "::", None), "pytest": ("python", "::", "[]"), "gotest": ("go", "::", None)}
ENDINGS = {"rust": ".rs", "python": ".py", "go": ".go"}
_SEP = "\x00"


def form(spec: object) -> tuple[str, str, str | None] | None:
    """(language, separator, params) of an id_names value; None for plain files."""
    if isinstance(spec, str):
        if spec not in PRESETS:
            raise ValueError(f"unknown preset '{spec}'; there are {', '.join(PRESETS)}")
        return PRESETS[spec]
    if not isinstance(spec, dict) or set(spec) - {"language", "separator", "params"} or spec.get("language") not in ENDINGS or not spec.get("separator") or len(spec.get("params", "[]")) != 2:
        raise ValueError("id_names is a preset, or a mapping of language, separator and a pair of params")
    return spec["language"], spec["separator"], spec.get("params")


def python_chains(text: str) -> list[list[str]]:
    """Top-level functions and classes, and the functions directly in those classes."""
    out = []
    for n in ast.parse(text).body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append([n.name])
        if isinstance(n, ast.ClassDef):
            out += [[n.name, m.name] for m in n.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
    return out


def _bare(text: str, rust: bool) -> str:
    """A source with comments and literals blanked."""
    raw = r'r(#*)".*?"\1|' if rust else r"`[^`]*`|"
    char = r"'(?:\\.[^']*|[^'\\])'" if rust else r"'(?:\\.|[^'\\])+'"
    block = r"/\*.*?\*/"
    return re.sub(rf'//[^\n]*|{block}|{raw}"(?:\\.|[^"\\])*"|{char}', lambda m: "".join("\n" if c == "\n" else " " for c in m[0]), text, flags=re.S)


def rust_chains(text: str) -> list[list[str]]:
    """Functions at top level and directly in inline modules."""
    out, stack, mods = [], [], []
    for m in re.finditer(r"\bmod\s+(\w+)\s*\{|\bfn\s+(\w+)|[{}()\[\]]", _bare(text, True)):
        if m[1]:
            stack.append(True)
            mods.append(m[1])
        elif m[2]:
            if all(stack):
                out.append([*mods, m[2]])
        elif m[0] in "{([":
            stack.append(False)
        elif not stack:
            raise ValueError("brackets don't match")
        elif stack.pop():
            mods.pop()
    if stack:
        raise ValueError("brackets don't match")
    return out


def go_chains(text: str) -> list[list[str]]:
    """Top-level functions that aren't methods."""
    out, depth = [], 0
    for m in re.finditer(r"\bfunc\s+(\w+)\s*[(\[]|[{}()\[\]]", _bare(text, False)):
        if m[1] and not depth:
            out.append([m[1]])
        depth += (m[0][-1] in "{([") - (m[0][-1] in "})]")
        if depth < 0:
            raise ValueError("brackets don't match")
    if depth:
        raise ValueError("brackets don't match")
    return out


SCANNERS = {".py": python_chains, ".rs": rust_chains, ".go": go_chains}


def definitions(files: DataFrame) -> DataFrame:
    """files: file, content -> (file, chain): what each source defines, the parts of a chain joined by a null character; a source that can't be read has one row with chain null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, chains = [], []
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    got = [_SEP.join(c) for c in SCANNERS[file[file.rindex(".") :]](content.as_py().decode("utf-8"))]
                except (ValueError, SyntaxError):
                    got = [None]
                at += [file] * len(got)
                chains += got
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), pa.array(chains, pa.string())], ["file", "chain"])

    return files.filter(F.col("file").rlike(r"\.(py|rs|go)$")).select("file", "content").mapInArrow(run, "file string, chain string")


def missing(nodes: DataFrame, files: DataFrame, names: dict[str, object]) -> DataFrame:
    """Findings: SOURCE_MISSING for each node of the kinds in names (kind -> id_names) whose id names nothing, PARSE_ERROR for each source that can't be read, whose nodes go unchecked.

    Addresses are split into file and chain by columns, and two anti-joins tell which are there."""
    forms = {k: form(v) for k, v in names.items()}
    file: Column = F.lit(None).cast("string")
    chain: Column = F.lit(None).cast("string")
    bad: Column = F.lit(False)
    for kind, f in forms.items():
        mine = F.col("kind") == kind
        if f is None:
            file = F.when(mine, F.col("id")).otherwise(file)
            continue
        language, separator, params = f
        id_ = F.col("id") if not params else F.regexp_replace("id", rf"\Q{params[0]}\E.*\Q{params[1]}\E$", "")
        parts = F.split(id_, rf"\Q{separator}\E")
        file = F.when(mine, parts[0]).otherwise(file)
        chain = F.when(mine, F.array_join(F.slice(parts, 2, 1 << 20), _SEP)).otherwise(chain)
        ending = "_test.go" if language == "go" else ENDINGS[language]
        bad = F.when(mine, ~parts[0].endswith(ending) | (F.size(parts) < 2)).otherwise(bad)
    n = nodes.filter(F.col("kind").isin(*forms)).select("id", "file", "line", file.alias("_file"), chain.alias("_chain"), bad.alias("_bad"))
    n = n.withColumn("_bad", F.col("_bad") | F.col("_file").startswith("/") | F.array_contains(F.split("_file", "/"), ".."))
    there = files.select(F.col("file").alias("_file")).distinct()
    found = definitions(files).select(F.col("file").alias("_file"), F.col("chain").alias("_chain")).distinct()
    broken = found.filter("_chain is null").select("_file")
    good = n.filter("not _bad")
    lost = n.filter("_bad").unionByName(good.filter("_chain is null").join(there, "_file", "left_anti").select(*n.columns))
    lost = lost.unionByName(good.filter("_chain is not null").join(broken, "_file", "left_anti").join(found, ["_file", "_chain"], "left_anti").select(*n.columns))
    out = lost.select(F.lit("warning").alias("severity"), F.lit("SOURCE_MISSING").alias("code"), F.concat(F.lit("'"), "id", F.lit("' names nothing")).alias("message"), F.col("id").alias("node_id"), "file", "line")
    used = broken.join(good.select("_file"), "_file", "left_semi")
    return out.unionByName(used.select(F.lit("warning").alias("severity"), F.lit("PARSE_ERROR").alias("code"), F.concat("_file", F.lit(": the source can't be read")).alias("message"), F.lit(None).cast("string").alias("node_id"), F.col("_file").alias("file"), F.lit(0).cast("long").alias("line")))
