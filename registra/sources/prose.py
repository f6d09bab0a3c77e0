"""Cross-references in prose: headings are sections, references to headings edges between them, resolved by joins."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Register
from ..shared import cut
from .files import AT_BITS, FILE_BITS, Fences, Rows, scan
from .markdown import HEADING, strip_emphasis

_MARK = "§"
_SPACE = "[  \t]"
_CODE = r"`([^`]+)`"
#: A file before the mark, as code or as a link's target; then one or more headings in code.
_REF = re.compile(rf"(?:(?:`([^`\n]+)`|\[[^\]\n]*\]\(\s*<?([^)\s>]+)>?[^)\n]*\)){_SPACE}*)?({_MARK}{{1,2}}){_SPACE}*({_CODE}(?:{_SPACE}*(?:,|and|or|, and|, or){_SPACE}*{_CODE})*)?")
_QUALIFIER = re.compile(r"(.+?)(?:: | \(| \[| — )")
_PATH = re.compile(r"(?:.*[/ `(])?[^\s`()]+\.[A-Za-z0-9]+`?\)?\s*")


def normal(path: str) -> str:
    """A path without . and .. parts; what climbs out of the register keeps its leading .. parts."""
    return posixpath.normpath(path)


def heading_paths(levels: list[tuple[int, str]]) -> list[str]:
    """Each heading with those above it, joined by ::."""
    out, above = [], []
    for level, name in levels:
        while above and above[-1][0] >= level:
            above.pop()
        above.append((level, name))
        out.append("::".join(n for _, n in above))
    return out


def references(line: str) -> list[tuple[str | None, str | None]]:
    """(file or none, heading or none) of each reference of a line. A heading of none stands for a mark with nothing to cite. Marks inside code are text; a bare mark after a file on the same line means that file."""
    out, file = [], None
    code = [m.span() for m in re.finditer(r"`[^`]*`", line)]
    for m in _REF.finditer(line):
        at = m.start(3)
        if any(a < at < b for a, b in code):
            continue
        if m[1] or m[2]:
            file = (m[1] or m[2]).split("#")[0]
        if not m[4]:
            out.append((file, None))
            continue
        found = re.findall(_CODE, m[4])
        out += [(file, h) for h in (found if m[3] == _MARK * 2 else found[:1])]
    return out


def read_file(rows: Rows, lines: list[str | None], faults: list[tuple[int, str]]) -> None:
    """Nodes: the document and its sections; references as rows of kind ref: id the heading cited, far the file named (null: this one)."""
    for n, why in faults:
        rows.finding(n, why)
    rows.node(0, rows.file, "document", {})
    fences, levels, at, refs = Fences(deep=True), [], [], []
    last = ""
    for n, line in enumerate((x or "" for x in lines), 1):
        if fences.inside(n, line):
            last = ""
            continue
        if (m := HEADING.fullmatch(line)) and m[1]:
            levels.append((len(re.match(r" *(#+)", line)[1]), m[1]))
            at.append(n)
        else:
            for file, heading in references(line):
                if heading is None:
                    rows.finding(n, f"{_MARK} cites nothing: a heading in backticks is expected after it")
                else:
                    refs.append((n, file, heading, file is None and bool(_PATH.fullmatch(last.strip()))))
        last = line
    if fences.open:
        rows.finding(fences.open[2], "fenced code is not closed")
    for (level, name), path, n in zip(levels, heading_paths(levels), at, strict=True):
        rows.node(n, f"{rows.file}#{path}", "section", {"heading": json.dumps(name, ensure_ascii=False), "level": str(level)})
    for n, file, heading, wrapped in refs:
        rows._add(n, what="ref", id=strip_emphasis(heading), far=file, kind="wrapped" if wrapped else "", attrs=[])


def nearest(lines: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """As-of join: lines (file, line, ...) with the value of the last mark (file, line, value) of the same file at or before the line; null before the first."""
    both = lines.withColumn("_is", F.lit(1)).unionByName(marks.select("file", "line", value).withColumn("_is", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("file").orderBy("line", "_is").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_near", F.last(F.when(F.col("_is") == 0, F.col(value)), True).over(w)).filter("_is = 1")
    return out.drop(value, "_is").withColumnRenamed("_near", value)


def _joined(*parts: Column) -> Column:
    return F.concat_ws("/", *(F.when(p != "", p) for p in parts))


def _normal(c: Column) -> Column:
    """normal() as a Column: . parts go and .. parts take the part before."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p))))
    return F.array_join(up, "/")


def read_prose(files: DataFrame, content_dirs: list[str]) -> Register:
    """files: file, content -> documents, sections and the cross-references between them.

    A file that a reference names is sought as written, beside the citing file, then in each content directory. A heading fits exactly (emphasis
    aside) or by the part before a qualifier; an exact fit wins; several are AMBIGUOUS_REF without an edge; none is an edge to file#heading, which validation reports as dangling."""
    inside = files.filter(F.col("file").rlike("|".join(rf"\A{re.escape(d.strip('/'))}/" for d in content_dirs))) if content_dirs else files
    rows = cut(scan(inside, read_file))
    names = rows.select("file").distinct()
    names = cut(names.repartitionByRange("file").withColumn("p", F.spark_partition_id()))
    names = names.withColumn("n", F.shiftleft(F.col("p").cast("long"), FILE_BITS) + F.row_number().over(Window.partitionBy("p").orderBy("file"))).select("file", "n")
    nodes = rows.filter("what = 'node'").join(names, "file").select("id", "kind", "attrs", "file", "line", (F.shiftleft(F.col("n"), AT_BITS) + F.col("at")).alias("ord"))
    seen = Window.partitionBy("id").orderBy("ord")
    first = nodes.withColumn("_n", F.row_number().over(seen))
    sections = nodes.filter("kind = 'section'")

    refs = rows.filter("what = 'ref'").select("file", "line", "at", F.col("id").alias("heading"), F.col("far").alias("named"), (F.col("kind") == "wrapped").alias("wrapped"))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    tries = [_joined(folder, F.col("named")), F.col("named"), *(_joined(F.lit(d.strip("/")), F.col("named")) for d in content_dirs)]
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("named").alias("to")), *(F.struct(F.lit(i + 1).alias("way"), t.alias("to")) for i, t in enumerate(tries)))
    tried = refs.filter("named is not null").select("file", "line", "at", F.explode(ways).alias("w")).select("file", "line", "at", "w.way", _normal(F.col("w.to")).alias("to"))
    hit = tried.join(names.select(F.col("file").alias("to")), "to", "left_semi").groupBy("file", "line", "at").agg(F.min_by("to", "way").alias("target"))
    refs = cut(refs.join(hit, ["file", "line", "at"], "left").withColumn("target", F.when(F.col("named").isNull(), F.col("file")).otherwise(F.col("target"))))
    lost = refs.filter("target is null")
    out_of = _normal(_joined(folder, F.col("named"))).startswith("..")
    why = F.when(out_of, F.concat(F.lit("target outside the register: "), "named")).otherwise(F.concat(F.lit("no file "), "named"))
    unresolved = lost.select(F.lit("error").alias("severity"), F.lit("PARSE_ERROR").alias("code"), F.concat("file", F.lit(": "), why).alias("message"), F.lit(None).cast("string").alias("node_id"), "file", "line")

    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("attrs")["heading"], F.lit("}")), "$.v")
    bare = F.regexp_replace(text, r"^(\*\*|__|\*|_)(.+)\1$", "$2")
    known = sections.select(F.col("file").alias("target"), "id", F.explode(F.array(F.struct(F.lit(0).alias("fit"), bare.alias("heading")), F.struct(F.lit(1).alias("fit"), F.regexp_extract(bare, _QUALIFIER.pattern.replace("—", "\\u2014"), 1).alias("heading")))).alias("h")).select("target", "id", "h.*").filter("heading <> ''")
    found = refs.filter("target is not null").join(known, ["target", "heading"], "left")
    best = found.groupBy("file", "line", "at", "heading", "target", "wrapped").agg(F.min("fit").alias("fit"), F.collect_set(F.struct("fit", "id")).alias("all"))
    best = cut(best.withColumn("ids", F.array_sort(F.transform(F.filter("all", lambda x: x.fit == F.col("fit")), lambda x: x.id))).withColumn("n", F.when(F.col("fit").isNull(), 0).otherwise(F.size("ids"))))
    told = lambda df, severity, code, message: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat("file", F.lit(": "), message).alias("message"), F.lit(None).cast("string").alias("node_id"), "file", "line")
    ambiguous = told(best.filter("n > 1"), "error", "AMBIGUOUS_REF", F.concat(F.lit("'"), "heading", F.lit("' fits several headings: "), F.array_join("ids", ", ")))
    wrapped = told(best.filter("n = 0 and wrapped"), "info", "WRAPPED_REF", F.concat(F.lit("'"), "heading", F.lit("' isn't a heading here, and the line before ends with a path; join the lines")))
    linked = best.filter("n < 2").withColumn("tgt", F.when(F.col("n") == 1, F.element_at("ids", 1)).otherwise(F.concat_ws("#", "target", "heading")))
    linked = nearest(linked.select("file", "line", "at", "tgt"), sections.select("file", "line", F.col("id").alias("section")), "section")
    none = F.create_map().cast("map<string,string>")
    edges = linked.join(names, "file").select(F.coalesce("section", "file").alias("src"), "tgt", F.lit("xref").alias("kind"), none.alias("attrs"), "file", "line", (F.shiftleft(F.col("n"), AT_BITS) + F.col("at")).alias("ord"))
    again = told(first.filter("_n > 1").select("*"), "error", "PARSE_ERROR", F.concat(F.lit("duplicate section "), "id"))
    read = rows.filter("what = 'finding'").select("severity", "code", "message", F.col("id").alias("node_id"), "file", "line")
    findings = read.unionByName(unresolved).unionByName(ambiguous).unionByName(wrapped).unionByName(again)
    return Register(first.filter("_n = 1").drop("_n"), edges, {}, findings)
