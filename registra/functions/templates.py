"""Message templates: {message} {code} {severity} {id} {kind} {attrs.x}, compiled to a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import text_of

ABSENT = "<absent>"
PLACEHOLDER = re.compile(r"\{\{|\}\}|\{([^{}]*)\}|[{}]")


def parse(text: str) -> list[tuple[str, str]]:
    """(what, value) pieces: literal, attr, or one of message, code, severity, id, kind; {{ and }} are braces. Raises for anything else in braces."""
    out, at = [], 0
    for m in PLACEHOLDER.finditer(text):
        out.append(("literal", text[at : m.start()]))
        at, name = m.end(), m[1]
        if m[0] in ("{{", "}}"):
            out.append(("literal", m[0][0]))
        elif name in ("message", "code", "severity", "id", "kind"):
            out.append((name, ""))
        elif name and name.startswith("attrs.") and len(name) > 6:
            out.append(("attr", name[6:]))
        else:
            raise ValueError(f"unknown placeholder '{m[0]}' in a message")
    return [x for x in [*out, ("literal", text[at:])] if x != ("literal", "")]


def value_text(value: Column) -> Column:
    """A value as people read it: a string without quotes, another value as JSON; null and absent as <absent>."""
    return F.coalesce(F.when(value != "null", F.coalesce(text_of(value), value)), F.lit(ABSENT))


def render(text: str, kind: Column, attrs: Column) -> Column:
    """The message of a finding (message, code, severity, node_id) on a node of that kind and these attributes, both null if there is none."""
    node = F.when(kind.isNotNull(), F.col("node_id"))
    known = {"message": F.col("message"), "code": F.col("code"), "severity": F.col("severity"), "id": F.coalesce(node, F.lit(ABSENT)), "kind": F.coalesce(kind, F.lit(ABSENT))}
    return F.concat(F.lit(""), *(F.lit(v) if what == "literal" else value_text(attrs[v]) if what == "attr" else known[what] for what, v in parse(text)))
