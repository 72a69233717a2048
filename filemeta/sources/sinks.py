"""Where results go: Parquet and JSON by Spark; a workbook, a page of cards or a metrics file by the driver, for
results of bounded size."""

from __future__ import annotations

import json
import tempfile
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import workbook

#: Rows that a sheet can have.
SHEET_ROWS = 1_048_575
WIDEST = 50


def scratch(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only where it is unset and all runs in one
    process, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="filemeta-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(metrics: dict, path: str) -> None:
    Path(path).write_text(json.dumps(metrics, indent=2, default=str, ensure_ascii=False))


def report_path(explicit: str | None = None, folder: str | None = None, plugin: str | None = None, now: datetime | None = None) -> Path:
    """The explicit path; else reports/report-<time>.xlsx in the first folder that is given, else here."""
    if explicit:
        return Path(explicit)
    root = Path(folder) if folder else Path(plugin or ".") / "reports"
    return root / f"report-{(now or datetime.now()):%Y%m%d-%H%M%S}.xlsx"


@dataclass
class Sheet:
    name: str
    df: DataFrame
    bold: str | None = None  # a column of booleans by cell
    highlight: object = None  # a predicate on a cell's value
    headers: list[str] = field(default_factory=list)


def sheet_rows(sheet: Sheet) -> tuple[list[str], list[list], list[list[bool]]]:
    """Header, cells and bold flags; more rows than a sheet holds are an error, not cut."""
    shown = [c for c in sheet.df.columns if c != sheet.bold]
    rows = sheet.df.limit(SHEET_ROWS + 1).collect()
    if len(rows) > SHEET_ROWS:
        raise ValueError(f"{sheet.name}: more than {SHEET_ROWS} rows; write Parquet instead")
    return sheet.headers or shown, [[r[c] for c in shown] for r in rows], [list(r[sheet.bold] or []) if sheet.bold else [] for r in rows]


def widths(header: list[str], cells: list[list]) -> list[int]:
    return [min(WIDEST, 2 + max(len(str(h)), *(len("" if r[i] is None else str(r[i])) for r in cells), 0)) for i, h in enumerate(header)]


def write_workbook(path: str, sheets: list[Sheet]) -> str:
    """A sheet each, with bold and highlighted cells, fitted columns and a table over the rows."""
    if not sheets:
        raise ValueError("no sheets")
    grids = []
    for s in sheets:
        header, cells, bold = sheet_rows(s)
        marked = [[bool(s.highlight(v)) for v in r] for r in cells] if s.highlight else []
        grids.append(workbook.Grid(s.name, header, cells, bold, marked, widths(header, cells)))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    workbook.write(path, grids)
    return path


def write_cards(df: DataFrame, path: str, title: str = "Review") -> None:
    """(id, html) rows as one page, in their order, streamed to the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!DOCTYPE html><meta charset=utf-8><title>{title}</title><table>\n")
        for r in df.toLocalIterator():
            f.write(r.html + "\n")
        f.write("</table>\n")
