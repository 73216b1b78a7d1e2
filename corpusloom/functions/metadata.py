"""Metadata of any shape as VARIANT, and typed filters on paths inside it."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import col

_STEP = re.compile(r"\.[A-Za-z_][A-Za-z0-9_]*|\[[0-9]+\]|\[\"[^\"]*\"\]")

# What a filter may ask, beside equality with a plain value.
OPERATORS = {
    "=": lambda x, v: x == v, "<>": lambda x, v: x != v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v,
    ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "in": lambda x, v: x.isin(list(v)),
}


def from_columns(**columns: Column | str) -> Column:
    """One VARIANT object of several columns, which may be structs, arrays or maps; null ones are left out as nulls."""
    return F.to_variant_object(F.struct(*[col(c).alias(name) for name, c in columns.items()]))


def from_json_text(text: Column | str) -> Column:
    """The VARIANT of a JSON text; null when it is none."""
    return F.try_parse_json(col(text))


def _path(path: str) -> str:
    full = path if path.startswith("$") else f"$.{path}"
    if not re.fullmatch(rf"\$(?:{_STEP.pattern})+", full):
        raise ValueError(f"not a path: {path!r}")
    return full


def _type_of(value: object) -> str:
    if isinstance(value, (list, tuple, set)):
        kinds = {_type_of(v) for v in value}
        if len(kinds) != 1:
            raise ValueError("values of one kind are needed")
        return kinds.pop()
    if isinstance(value, bool):
        return "boolean"
    return {int: "double", float: "double", str: "string"}[type(value)]


def value_at(meta: Column | str, path: str, kind: str) -> Column:
    """What stands at ``path`` (such as ``a.b[0]``) if it is of the type ``kind`` or can be read as one; else null."""
    return F.try_variant_get(col(meta), _path(path), kind)


def matches(meta: Column | str, filters: Mapping[str, object]) -> Column:
    """All filters hold: ``{path: value}`` or ``{path: (operator, value)}``; None asks for a missing or null value.

    Numbers are compared as numbers and texts as texts, so ``{"size": (">", 9)}``
    takes 10. A number never equals a text or a boolean that looks like it.
    """
    meta = col(meta)

    def one(path: str, wanted: object) -> Column:
        operator, value = wanted if isinstance(wanted, tuple) else ("=", wanted)
        if operator not in OPERATORS:
            raise ValueError(f"operator must be one of {list(OPERATORS)}")
        if value is None:
            stored = F.try_variant_get(meta, _path(path), "variant")
            missing = stored.isNull() | F.is_variant_null(stored)
            return missing if operator == "=" else ~missing
        kind = _type_of(value)
        stored = F.schema_of_variant(F.try_variant_get(meta, _path(path), "variant"))
        fits = {
            "string": stored == "STRING", "boolean": stored == "BOOLEAN", "double": stored.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
        }[kind]
        return fits & OPERATORS[operator](value_at(meta, path, kind), value)

    keep = reduce(and_, [one(p, w) for p, w in filters.items()], F.lit(True))
    return F.coalesce(keep, F.lit(False))
