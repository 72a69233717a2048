"""Scans of name lists, labelled rows and dictionaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from . import workbook

#: Columns of a labelled scan, in order.
LABELLED = ["input", "removed", "filename_cleaned", "filename_pattern", "studio", "title", "performers", "date", "studio_code", "sequence", "group", "unlabeled_filename_tokens", "match_stats"]
#: Encodings tried in order.
ENCODINGS = ["utf-8", "utf-8-sig", "latin-1", "cp1252", "iso-8859-1"]
_CACHE: dict[str, object] = {}


def names(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(row_id, name): stripped lines without blanks and headings; row_id ascends with files and lines. A limit that
    is not positive is none; limited lines are the first."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("row_id"), text.strip(F.col("value")).alias("name"))
    found = lines.where((F.col("name") != "") & ~F.col("name").isin(values.SENTINELS))
    return found.orderBy("row_id").limit(limit) if limit and limit > 0 else found


def _sheet(path: str, sheet: str | None) -> list[list]:
    book = workbook.read(path)
    if sheet and sheet not in book:
        raise ValueError(f"no sheet {sheet!r}; there are {[n for n in book if n]}")
    return book.get(sheet or None, [])


def workbook_names(spark: SparkSession, path: str, sheet: str | None = None, limit: int | None = None) -> DataFrame:
    """Names of the `input` column, whatever its case, of a sheet or the active one. The driver reads the file."""
    rows = _sheet(path, sheet)
    header = [str(c or "").strip().lower() for c in (rows[0] if rows else [])]
    if "input" not in header:
        raise ValueError("no column `input`")
    at = header.index("input")
    found = [str(r[at]).strip() for r in rows[1:] if len(r) > at and r[at] is not None and str(r[at]).strip()]
    return spark.createDataFrame(list(enumerate(found[: limit if limit and limit > 0 else None])), "row_id long, name string")


def labelled(spark: SparkSession, path: str, sheet: str = "Reference") -> DataFrame:
    """Labelled rows of a CSV, or of a workbook's sheet, whose header is exactly LABELLED: empty cells are null;
    sequence a map, tokens a list, statistics a struct, all from JSON."""
    if path.lower().endswith(".xlsx"):
        rows = _sheet(path, sheet)
        if not rows or rows[0] != LABELLED:
            raise ValueError(f"header {rows[0] if rows else []} is not {LABELLED}")
        cells = [[None if i >= len(r) or r[i] in (None, "") else str(r[i]) for i in range(len(LABELLED))] for r in rows[1:]]
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(cells) if any(r)], "row_id long, " + ", ".join(f"`{c}` string" for c in LABELLED))
    else:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        if df.columns != LABELLED:
            raise ValueError(f"header {df.columns} is not {LABELLED}")
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    made = {
        "sequence": F.from_json("sequence", "map<string,bigint>"),
        "unlabeled_filename_tokens": F.from_json("unlabeled_filename_tokens", "array<string>"),
        "match_stats": F.from_json("match_stats", "filename_tokens int, matched_tokens int, match_rate double"),
    }
    return df.withColumns(made)


def dictionary(spark: SparkSession, path: str, cache: bool = True):
    """A JSON dictionary, read on the driver as whole text through Spark, so that any store works; the first encoding
    that reads it counts; None if it is not there or is no JSON."""
    if cache and path in _CACHE:
        return _CACHE[path]
    found = None
    try:
        row = spark.read.format("binaryFile").load(path).select("content").first()
        for e in ENCODINGS if row else []:
            try:
                found = json.loads(bytes(row.content).decode(e))
                break
            except (UnicodeError, ValueError):
                continue
    except Exception:  # noqa: BLE001  no such file, no access: the dictionary is absent
        found = None
    if cache:
        _CACHE[path] = found
    return found


def section(spark: SparkSession, path: str, name: str, default=None):
    found = dictionary(spark, path)
    return found.get(name, default) if isinstance(found, dict) else default


def preload(spark: SparkSession, *paths: str) -> dict[str, bool]:
    return {p: dictionary(spark, p) is not None for p in paths}


def clear() -> None:
    _CACHE.clear()


def metrics(spark: SparkSession, path: str) -> dict:
    """Key metrics of a metrics file, rounded to whole numbers."""
    found = dictionary(spark, path, cache=False)
    if not isinstance(found, dict) or "key_metrics" not in found:
        raise ValueError(f"no metrics in {path}")
    return {k: int(round(v)) for k, v in found["key_metrics"].items()}
