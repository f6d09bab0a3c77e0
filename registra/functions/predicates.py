"""The predicate language over attributes, compiled to Columns that are never null."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "ne", "in", "lt", "gt", "lte", "gte", "matches", "present")
INT = r"\A-?[0-9]+\z"
#: Spellings in a filter, the longest first at each place.
SPELLINGS = {">=": "gte", "<=": "lte", "!=": "ne", "~=": "matches", ">": "gt", "<": "lt", "=": "eq"}


def text_of(value: Column) -> Column:
    """The string behind a JSON string literal; null for other values."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))


def integer_of(value: Column) -> Column:
    return F.when(value.rlike(INT), value.try_cast("decimal(20,0)"))


def json_type(value: Column) -> Column:
    """null, bool, int, float, string, list or object, from the literal's first characters."""
    c = F.substring(value, 1, 1)
    return F.when(c == '"', "string").when(c == "[", "list").when(c == "{", "object").when(c == "n", "null").when(c.isin("t", "f"), "bool").when(value.rlike(INT), "int").otherwise("float")


def has_type(value: Column, kind: str, values: list[str] | None = None) -> Column:
    if kind == "date":
        t = text_of(value)
        return F.coalesce(t.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))
    if kind == "int":
        n = integer_of(value)
        return F.coalesce((n >= F.lit("-9223372036854775808").cast("decimal(20,0)")) & (n <= F.lit("18446744073709551615").cast("decimal(20,0)")), F.lit(False))
    return json_type(value) == ("string" if kind == "enum" else kind)


def as_json(x) -> Column:
    """A value as the literal that attributes hold."""
    return F.lit(json.dumps(x, ensure_ascii=False, separators=(",", ":")))


def condition(attr: str, op: str, operand, attrs: Column | None = None) -> Column:
    """One condition. Absent keys fail all but ne and present: false; a type that doesn't fit fails the orderings."""
    attrs = F.col("attrs") if attrs is None else attrs
    value = attrs[attr]
    if op == "present":
        return F.map_contains_key(attrs, attr) == F.lit(bool(operand))
    if op == "eq":
        c = value == as_json(operand)
    elif op == "ne":
        return ~F.coalesce(value == as_json(operand), F.lit(False))
    elif op == "in":
        c = value.isin(*[json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in operand]) if operand else F.lit(False)
    elif op == "matches":
        scalar = F.when(json_type(value) == "string", text_of(value)).when(json_type(value).isin("int", "float", "bool"), value)
        c = scalar.rlike(f"(?U){operand}")
    else:
        is_int = isinstance(operand, int) and not isinstance(operand, bool)
        left = integer_of(value) if is_int else text_of(value)
        right = F.lit(str(operand)).cast("decimal(20,0)") if is_int else F.lit(operand)
        c = {"lt": left < right, "gt": left > right, "lte": left <= right, "gte": left >= right}[op]
    return F.coalesce(c, F.lit(False))


def block(conditions: dict, attrs: Column | None = None, expect: bool = True) -> Column:
    """All hold (expect), or none does (reject); an empty block holds both ways."""
    parts = [condition(a, *next(iter(c.items())), attrs) for a, c in conditions.items()]
    return reduce(lambda x, y: x & y, (p if expect else ~p for p in parts), F.lit(True))


def first_failing(conditions: dict, attrs: Column | None = None, expect: bool = True) -> Column:
    """'attr op' of the first condition that breaks the block, in its order; null if it holds."""
    parts = []
    for a, c in conditions.items():
        op, operand = next(iter(c.items()))
        ok = condition(a, op, operand, attrs)
        parts.append(F.when(~ok if expect else ok, F.lit(f"{a} {op} {json.dumps(operand)}")))
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def parse_block(raw: dict) -> dict:
    """A profile's condition block: attr -> value (eq) or {op: operand}. Every fault is named at once."""
    out, faults = {}, []
    for attr, spec in raw.items():
        spec = spec if isinstance(spec, dict) else {"eq": spec}
        if "not" in spec:
            faults.append(f"{attr}: 'not' is retired; use 'ne'")
            continue
        if len(spec) != 1:
            faults.append(f"{attr}: one operator expected")
            continue
        op, operand = next(iter(spec.items()))
        if op not in OPERATORS:
            faults.append(f"{attr}: unknown operator '{op}'")
        elif op in ("lt", "gt", "lte", "gte") and (isinstance(operand, bool) or not isinstance(operand, int | str)):
            faults.append(f"{attr}: {op} takes an integer or a string")
        else:
            out[attr] = {op: operand}
    if faults:
        raise ValueError("; ".join(faults))
    return out


def parse_filter(text: str) -> tuple[str, str, object]:
    """attr<op>value, split at the earliest operator, the longest there. Equality tries int, bool, string; orderings int, string."""
    found = re.search("|".join(re.escape(s) for s in SPELLINGS), text)
    if not found or not text[: found.start()].strip():
        raise ValueError(f"filter '{text}' isn't attr<op>value")
    attr, op, raw = text[: found.start()].strip(), SPELLINGS[found[0]], text[found.end() :].strip()
    if op == "matches":
        return attr, op, raw
    if re.fullmatch(r"-?[0-9]+", raw):
        return attr, op, int(raw)
    return attr, op, raw == "true" if op in ("eq", "ne") and raw in ("true", "false") else raw


def filters(texts: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (condition(*parse_filter(t)) for t in texts), F.lit(True))
