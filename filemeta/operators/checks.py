"""Checks of dictionaries: each gives the offending rows, an empty frame is a pass."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_names(df: DataFrame, name: str = "canonical_name", index: str = "idx") -> DataFrame:
    """Names that occur more than once, whatever their case: name, n, first index."""
    found = df.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("n"), F.min(index).alias("first_idx"))
    return found.where("n > 1")


def alias_collisions(df: DataFrame, alias: str = "alias", canonical: str = "canonical") -> DataFrame:
    """Aliases that stand for several names, whatever their case: alias, how many, the first of them."""
    found = df.groupBy(F.lower(alias).alias("alias")).agg(F.countDistinct(canonical).alias("n"), F.min(canonical).alias("first_canonical"))
    return found.where("n > 1")


def unknown_targets(df: DataFrame, known: DataFrame, target: str, name: str) -> DataFrame:
    """Rows whose target is no known name."""
    names = known.select(F.col(name).alias("__n")).distinct()
    return df.where(F.col(target).isNotNull()).join(names, F.col(target) == F.col("__n"), "left_anti")


# What an entry of a studio dictionary may have.
_NAMES = {"oneOf": [{"type": "null"}, {"type": "string"}, {"type": "array", "items": {"type": "string"}}]}
_TEXT = {"type": ["string", "null"]}
STUDIO_SCHEMA = {
    "type": "array",
    "items": {
        "type": "object", "additionalProperties": False, "required": ["canonical_name"],
        "properties": {"canonical_name": {"type": "string", "minLength": 1}, "abbr": _NAMES, "aliases": _NAMES, "url": _TEXT, "gevi_id": _TEXT, "stash_id": _TEXT, "iafd_id": _TEXT},
    },
}
_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def _faults(v, schema: dict, path: tuple) -> list[tuple[tuple, str]]:
    """(path, message) of what a value breaks of a JSON schema: types, enumerations, bounds, patterns, properties, items,
    and allOf, anyOf and oneOf. References are not followed."""
    out: list[tuple[tuple, str]] = []

    def bad(message: str) -> None:
        out.append((path, message))

    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](v) for k in kinds):
        bad(f"{v!r} is not of type {' or '.join(kinds)}")
    if "enum" in schema and v not in schema["enum"]:
        bad(f"{v!r} is not one of {schema['enum']}")
    for word, size in (("Length", len(v) if isinstance(v, str) else None), ("Items", len(v) if isinstance(v, list) else None)):
        if size is not None and not schema.get(f"min{word}", 0) <= size <= schema.get(f"max{word}", size):
            bad(f"{v!r} is too short or too long")
    if _KINDS["number"](v) and not schema.get("minimum", v) <= v <= schema.get("maximum", v):
        bad(f"{v!r} is out of bounds")
    if isinstance(v, str) and "pattern" in schema and not re.search(schema["pattern"], v):
        bad(f"{v!r} does not match {schema['pattern']!r}")
    if isinstance(v, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        for name in schema.get("required", []):
            if name not in v:
                bad(f"{name!r} is missing")
        for name, x in v.items():
            if name in known:
                out += _faults(x, known[name], (*path, name))
            elif more is False:
                bad(f"{name!r} is not allowed")
            elif isinstance(more, dict):
                out += _faults(x, more, (*path, name))
    if isinstance(v, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(v):
            out += _faults(x, schema["items"], (*path, i))
    for part in schema.get("allOf", []):
        out += _faults(v, part, path)
    for word, fits in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if word in schema and not fits(sum(not _faults(v, part, path) for part in schema[word])):
            bad(f"{v!r} does not fit the schemas of {word}")
    return out


def schema_errors(data, schema: dict, label: str) -> list[str]:
    """Messages `label: path: what is wrong`, in order of their paths; indices sort as numbers."""
    found = sorted(_faults(data, schema, ()), key=lambda f: [(isinstance(p, str), p) for p in f[0]])
    return [f"{label}: {' > '.join(map(str, path)) or 'root'}: {message}" for path, message in found]
