"""Files for the text scanners: globs, reading, decoding, and the rows that scanners give."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Register
from ..shared import cut

#: A scanner's row: a node (id, kind, attrs), an edge (id to far, of a kind, declared_by the at of its node) or a finding (code, severity, message, id).
ROW = pa.schema([("what", pa.string()), ("id", pa.string()), ("kind", pa.string()), ("far", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("line", pa.int64()), ("at", pa.int64()), ("declared", pa.int64()), ("severity", pa.string()), ("code", pa.string()), ("message", pa.string())])
ROW_DDL = "what string, id string, kind string, far string, attrs map<string,string>, file string, line long, at long, declared long, severity string, code string, message string"
#: Bits of ord for an entry's place in its file, and for a file's place among those sorted with it.
AT_BITS, FILE_BITS = 28, 22


def glob_regex(glob: str) -> str:
    """The whole-path pattern of a glob: * and ? within a segment, ** across segments, everything else itself."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return rf"\A(?:{out})\z"


def matching(files: DataFrame, globs: list[str]) -> DataFrame:
    return files.filter(F.col("file").rlike("|".join(map(glob_regex, globs)))) if globs else files.filter(F.lit(False))


def read_folder(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """(file, content) of the files under a folder that a glob fits; file is relative to the folder. Listing and reading are Spark's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), r"\A[a-z]+:/*", "/")
    clean = re.sub(r"\A[a-z]+:/*", "/", root).rstrip("/")
    return matching(files.select(F.substring(path, F.lit(len(clean) + 2), F.length("path")).alias("file"), "content"), globs)


def retarget(files: DataFrame, globs: list[str], target: str) -> str | None:
    """The folder above a target that a glob was probably meant from: its leading folders repeat the target's own, and without them it fits a file."""
    own = target.rstrip("/").split("/")
    for g in globs:
        lead = g.split("/")[:-1]
        for n in range(min(len(lead), len(own)), 0, -1):
            if lead[:n] == own[-n:] and matching(files, ["/".join(g.split("/")[n:])]).limit(1).count():
                return "/".join(own[:-n]) or "/"
    return None


def no_matching(files: DataFrame, globs: list[str], target: str = "", every: DataFrame | None = None) -> DataFrame | None:
    """NO_MATCHING_FILES if nothing fits, with the target to use instead if one suggests itself; every: all files below the target."""
    if matching(files, globs).limit(1).count():
        return None
    hint = retarget(every, globs, target) if every is not None else None
    message = f"no file matches {', '.join(globs)}" + (f"; with the target {hint} some do" if hint else "")
    return files.sparkSession.createDataFrame([("info", "NO_MATCHING_FILES", message, None, "<profile>", 0)], "severity string, code string, message string, node_id string, file string, line long")


def decode(content: bytes | None) -> tuple[list[str | None], list[tuple[int, str]]]:
    """Lines of a file, null where a line isn't UTF-8, and (line, fault) for those. A byte order mark and carriage returns at line ends go."""
    lines, faults = [], []
    for n, raw in enumerate((content or b"").removeprefix(b"\xef\xbb\xbf").split(b"\n"), 1):
        raw = raw.removesuffix(b"\r")
        try:
            lines.append(raw.decode("utf-8"))
        except UnicodeDecodeError as e:
            lines.append(None)
            faults.append((n, f"line is not valid UTF-8 at column {len(raw[: e.start].decode('utf-8')) + 1}, so it was not read: {raw.decode('utf-8', 'backslashreplace').replace(chr(92) + 'x', chr(92) + 'x')}"))
    return lines, faults


class Fences:
    """Whether a line lies in fenced code: a fence is closed by a run of its own character that is at least as long and has nothing after it."""

    def __init__(self, deep: bool = False):
        self.open: tuple[str, int, int] | None = None  # character, length, line
        self.pattern = re.compile(r"\s*(`{3,}|~{3,})(.*)" if deep else r" {0,3}(`{3,}|~{3,})(.*)")

    def inside(self, n: int, line: str) -> bool:
        m = self.pattern.fullmatch(line)
        if self.open:
            char, size, _ = self.open
            if m and m[1][0] == char and len(m[1]) >= size and not m[2].strip():
                self.open = None
            return True
        if m and not (m[1][0] == "`" and "`" in m[2]):
            self.open = (m[1][0], len(m[1]), n)
            return True
        return False


class Rows:
    """Collects a file's rows."""

    def __init__(self, file: str):
        self.file, self.rows = file, []

    def _add(self, line: int, **row) -> int:
        self.rows.append({"file": self.file, "line": line, "at": len(self.rows), **row})
        return len(self.rows) - 1

    def node(self, line: int, id_: str, kind: str, attrs: dict) -> int:
        return self._add(line, what="node", id=id_, kind=kind, attrs=list(attrs.items()))

    def edge(self, line: int, src: str, tgt: str, kind: str, declared: int | None = None) -> None:
        self._add(line, what="edge", id=src, far=tgt, kind=kind, attrs=[], declared=declared)

    def finding(self, line: int, message: str, code: str = "PARSE_ERROR", severity: str = "error", id_: str | None = None) -> None:
        self._add(line, what="finding", code=code, severity=severity, message=f"{self.file}: {message}", id=id_)


def scan(files: DataFrame, read: Callable[[Rows, list[str | None], list[tuple[int, str]]], None]) -> DataFrame:
    """files: file, content -> the rows that read() finds in each. One file is one task's work and is held whole; files are dealt over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = Rows(file)
                read(rows, *decode(content.as_py()))
                if rows.rows:
                    yield pa.RecordBatch.from_pylist(rows.rows, schema=ROW)

    return files.select("file", "content").mapInArrow(run, ROW_DDL)


def register(rows: DataFrame) -> Register:
    """A register of scanned rows: entries in the order of file names and places, the first declaration of an id counts."""
    from .document import settle

    rows = cut(rows)
    names = rows.select("file").distinct()
    names = cut(names.repartitionByRange("file").withColumn("p", F.spark_partition_id()))
    names = names.withColumn("n", F.shiftleft(F.col("p").cast("long"), FILE_BITS) + F.row_number().over(Window.partitionBy("p").orderBy("file")))
    r = rows.join(names.select("file", "n"), "file")
    at = lambda c: F.shiftleft(F.col("n"), AT_BITS) + F.col(c)
    nodes = r.filter("what = 'node'").select("id", "kind", "attrs", "file", "line", at("at").alias("ord"))
    edges = r.filter("what = 'edge'").select(F.col("id").alias("src"), F.col("far").alias("tgt"), "kind", "attrs", "file", "line", at("at").alias("ord"), at("declared").alias("declared_by"))
    nodes, edges, repeats = settle(nodes, edges)
    told = r.filter("what = 'finding'").select("severity", "code", "message", F.col("id").alias("node_id"), "file", "line")
    return Register(nodes, edges, {}, repeats.unionByName(told))
