"""The register: nodes, edges, pathways and findings as DataFrames.

Attributes are a map from name to canonical JSON text, so equality is type-aware ("42" with quotes differs from 42), an absent
key differs from a null, and values can be grouped. ord keeps the order of declaration where it matters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "id string, kind string, attrs map<string,string>, file string, line bigint, ord bigint"
EDGE = "src string, tgt string, kind string, attrs map<string,string>, file string, line bigint, ord bigint"
FINDING = ["severity", "code", "message", "node_id", "file", "line"]


def literal(c: Column, kind: str) -> Column:
    """A column as JSON text: string, int, bool."""
    if kind == "string":
        return F.when(c.isNotNull(), F.substring(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6))
    return c.cast("string")


def attrs(**columns: Column) -> Column:
    """A map of JSON texts; null columns are absent keys. For an explicit null pass lit('null')."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in columns.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p.value.isNotNull()))


def node(df: DataFrame, id_: Column, kind: str, values: Column | None = None, file: str = "table", order: Column | None = None) -> DataFrame:
    values = F.create_map().cast("map<string,string>") if values is None else values
    return df.select(id_.alias("id"), F.lit(kind).alias("kind"), values.alias("attrs"), F.lit(file).alias("file"), F.lit(0).cast("bigint").alias("line"), (F.lit(0) if order is None else order).cast("bigint").alias("ord"))


def edge(df: DataFrame, src: Column, tgt: Column, kind: str, values: Column | None = None, file: str = "table", order: Column | None = None) -> DataFrame:
    values = F.create_map().cast("map<string,string>") if values is None else values
    return df.select(src.alias("src"), tgt.alias("tgt"), F.lit(kind).alias("kind"), values.alias("attrs"), F.lit(file).alias("file"), F.lit(0).cast("bigint").alias("line"), (F.lit(0) if order is None else order).cast("bigint").alias("ord"))


@dataclass
class Register:
    nodes: DataFrame
    edges: DataFrame
    pathways: dict[str, tuple[list[str], str]] = field(default_factory=dict)
    findings: DataFrame | None = None

    def __post_init__(self):
        for name, (order, current) in self.pathways.items():
            if len(set(order)) < len(order) or current not in order:
                raise ValueError(f"pathway '{name}': positions must be unique and hold the current one")


@dataclass(frozen=True)
class NodeKind:
    pattern: str = ".*"
    attrs: dict = field(default_factory=dict)  # name -> {"type", "required", "values", "items"}
    summary: str | None = None
    orphan_ok: bool = False
    texts: tuple | None = None  # attributes that a ranking reads; None: the summary
    chunk: str | None = None  # a text is cut at lines that start so
    names: object = None  # how an id is an address of something in the sources, if it is


@dataclass(frozen=True)
class Profile:
    node_kinds: dict[str, NodeKind]
    edge_kinds: dict[str, list[tuple[str, str]]]  # kind -> allowed (source kind, target kind)
    cross_source: frozenset = frozenset()
    validations: tuple = ()
    overrides: dict = field(default_factory=dict)  # code -> severity
    suppressions: tuple = ()  # (code, node ids or None)
    pathway_bindings: dict = field(default_factory=dict)  # code -> (pathway, attr)
    pathways: tuple = ()  # names that bindings and notes may use
    templates: dict = field(default_factory=dict)  # code -> message template
    notes: str | None = None  # a notes file
    name: str = "profile"
    raw: dict = field(default_factory=dict)
