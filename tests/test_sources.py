"""Readers on hand-made texts: what they refuse, and odd lines."""

import pytest

from registra.functions import templates
from registra.sinks import render
from registra.model import NodeKind, Profile
from registra.plans import service
from registra.sources import files, markdown, profiles, prose, symbols, toml_tables
from registra.sources.files import Rows


def test_globs():
    import re

    fits = lambda g, p: bool(re.match(files.glob_regex(g).replace(r"\z", r"\Z"), p))
    assert fits("**/*.md", "a.md") and fits("**/*.md", "x/y/a.md") and not fits("*.md", "x/a.md")
    assert fits("a?[b].md", "ax[b].md") and not fits("a?.md", "a/.md")


def test_emphasis_and_targets():
    s = markdown.strip_emphasis
    assert [s(x) for x in ("**`1.1`**", "****", "**a** b **c**", "_x_", "plain")] == ["1.1", "****", "**a** b **c**", "x", "plain"]
    assert markdown.targets("R-1, [R-2, R-3](u), ,R-4") == ["R-1", "[R-2, R-3](u)", "R-4"]
    assert markdown.cells(r"| a \| b | c |") == ["a | b", "c"]


def test_fences():
    f = files.Fences()
    assert [f.inside(i, x) for i, x in enumerate(["```py", "````", "x", "~~~", "```a`b", "y"])] == [True, True, False, True, True, True]
    assert f.open[2] == 3


def test_markdown_faults():
    lines = "| ID | B |\n|---|---|\n| | x |\n| a | x | y |\n\n```\n| ID |".split("\n")
    rows = Rows("f.md")
    markdown.reader({"table": {"id_column": "ID", "column_map": {"C": "c"}}}, ["k"])(rows, lines, [])
    assert [(r["line"], r["message"].split(": ", 1)[1]) for r in rows.rows] == [
        (1, "configured column 'C' was not found in table headers"), (3, "table row has an empty ID"), (4, "table row has more columns than its header"), (6, "fenced code is not closed"),
    ]
    with pytest.raises(ValueError, match="exactly one"):
        markdown.reader({"table": {"id_column": "ID"}}, ["a", "b"])


def test_toml_faults():
    rows = Rows("f.toml")
    adapter = {"tables": {"item": {"kind": "item", "id_key": "id", "key_map": {"xs": "xs", "a.b": "ab"}}}}
    toml_tables.reader(adapter)(rows, '[[item]]\nid = "a"\nxs = [1,\n  [2],\n]\na = 3\n[[item]]\nid = 5\n[[other]]\nx = 1'.split("\n"), [])
    assert [(r["what"], r["line"]) for r in rows.rows] == [("finding", 4), ("finding", 1), ("node", 1), ("finding", 7), ("finding", 9)]
    bad = Rows("g.toml")
    toml_tables.reader(adapter)(bad, ["x = ", "y = 1"], [])
    assert bad.rows[0]["line"] == 1 and "not valid TOML" in bad.rows[0]["message"]
    with pytest.raises(ValueError, match="single table entry"):
        toml_tables.check_adapter({"mode": "directory", "tables": {"a": {"kind": "a", "id_key": "i"}, "b": {"kind": "b", "id_key": "i"}}})
    assert toml_tables.pathway(b'o = ["a", "b"]\nc = "b"', {"name": "p", "order_key": "o", "current_key": "c"}) == ("p", (["a", "b"], "b"))
    assert isinstance(toml_tables.pathway(b'o = ["a", "a"]\nc = "a"', {"name": "p", "order_key": "o", "current_key": "c"}), str)


def test_references():
    assert prose.references("`a.md` § `One` and § `Two`; [t](b.md#x) §§ `A`, `B` and `C`") == [("a.md", "One"), ("a.md", "Two"), ("b.md", "A"), ("b.md", "B"), ("b.md", "C")]
    assert prose.references("plain `§` mark, then § alone") == [(None, None)]
    assert prose.heading_paths([(1, "A"), (3, "B"), (2, "C"), (1, "D")]) == ["A", "A::B", "A::C", "D"]


def test_profile_names_all_faults():
    raw = {"profile_version": "1.0", "nod_kinds": {}, "node_kinds": {"a": {"id_pattern": "x", "attrs": {"e": {"type": "enum"}, "t": "text"}}}, "edge_kinds": {"e": {"allowed": [["a", "b"]]}}}
    raw["validations"] = [{"COVERAGE": {"target_kind": "a"}}, {"CONSTRAINT": {"kind": "a"}}, {"EDGE_COUNT": {"node_kind": "a", "edge_kind": "e", "min": 3, "max": 1}}, {"X": {"severity": "fatal", "message": "{oops}"}}, {"X": {"pathway": "p"}}]
    with pytest.raises(profiles.ProfileError) as e:
        profiles.compile_profile(raw)
    for part in ("X.Y.Z", "nod_kinds", "enum type requires", "unknown type 'text'", "undeclared node kind 'b'", "missing 'edge_kind'", "'expect' or 'reject'", "'min' is above 'max'", "unknown severity", "unknown placeholder", "go together"):
        assert part in str(e.value)
    assert profiles.merge({"a": {"x": 1, "y": [1]}, "b": 1}, {"a": {"y": [2]}}) == {"a": {"x": 1, "y": [2]}, "b": 1}
    with pytest.raises(profiles.ProfileError, match="majors"):
        profiles.check_version("profile_version", "2.0.0")


def test_templates():
    assert templates.parse("{{{id}}} {attrs.a.b}") == [("literal", "{"), ("id", ""), ("literal", "}"), ("literal", " "), ("attr", "a.b")]


def test_rendering():
    assert render.clean("a\x1b[31mb\x07") == "ab" and render.cut_to("abcdef", 4) == "abc…"
    assert render.to_json({"b": None, "a": {"é": 1, "d": 2}}) == '{"a": {"d": 2, "\\u00e9": 1}}'
    assert list(render.columns([["a", 1], ["bcd", 22]])) == ["a     1", "bcd  22"]


def test_definitions():
    assert symbols.go_chains("func A() {}\nfunc (t T) B() { func() {}() }\nfunc C[T any](x T) {}") == [["A"], ["C"]]
    assert symbols.rust_chains("fn a() {}\nmod m { mod n { fn b() { fn c() {} } } }\ntrait T { fn d(); }") == [["a"], ["m", "n", "b"]]
    assert symbols.python_chains("class A:\n  def m(self): pass\n  class B:\n    def n(self): pass\nif 1:\n  def f(): pass") == [["A"], ["A", "m"]]
    with pytest.raises(ValueError, match="preset"):
        symbols.form("nose")


def test_load_a_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("| ID |\n|---|\n| t/x.py::f |\n| t/x.py::g |\n| t/x.py::f |\n")
    (tmp_path / "t" / "x.py").write_text("def f(): pass\n")
    p = Profile({"k": NodeKind(names="pytest")}, {}, raw={"adapter": {"native": "md", "paths": {"files": ["**/*.md"]}, "table": {"id_column": "ID"}}})
    r = service.load(spark, p, str(tmp_path))
    assert sorted((x.id, x.file, x.line) for x in r.nodes.collect()) == [("t/x.py::f", "t/a.md", 3), ("t/x.py::g", "t/a.md", 4)]
    assert sorted((x.code, x.node_id, x.line) for x in r.findings.collect()) == [("PARSE_ERROR", "t/x.py::f", 5), ("SOURCE_MISSING", "t/x.py::g", 4)]
    none = service.load(spark, Profile({"k": NodeKind()}, {}, raw={"adapter": {"native": "md", "paths": {"files": ["*.txt"]}, "table": {"id_column": "ID"}}}), str(tmp_path))
    assert [x.code for x in none.findings.collect()] == ["NO_MATCHING_FILES"] and none.nodes.count() == 0
    astray = service.load(spark, Profile({"k": NodeKind()}, {}, raw={"adapter": {"native": "md", "paths": {"files": ["t/*.md"]}, "table": {"id_column": "ID"}}}), str(tmp_path / "t"))
    assert astray.findings.first().message.endswith(f"with the target {tmp_path} some do")
    with pytest.raises(ValueError, match="no adapter"):
        service.load(spark, Profile({}, {}), str(tmp_path))
