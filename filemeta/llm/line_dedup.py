"""Line deduplication by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a text are a window, known by two 64-bit hashes. A window seen more than once is
repeated; its first occurrence, by document id and then position, stays, and all lines that any later occurrence
covers are removed, their positions merged. Windows of nothing but blanks are not counted.

Plan: windows are hashed as they are made, counted with partial aggregation, and the repeated ones written as a table; the
windows' join with it has plain exchanges on both sides, so a hot window is split by adaptive execution. Texts are
shuffled once, to the join with their covered positions.

Defined results: a null text stays null, an empty one stays empty; texts of fewer than three lines are unchanged;
rows with the same id and text are one document, treated alike; a null id comes first; an empty table gives an empty
table; other columns pass through, and columns named like our outputs (n_lines, n_removed) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(id, mark, text) to (id, mark, pos, h1, h2), a row per window; pos counts from 0."""
    cut = docs.select("id", "mark", _lines(F.col("text")).alias("a")).where(F.size("a") >= lines)
    n = F.greatest(F.size("a") - (lines - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice("a", k + 1, n).alias(f"l{k}") for k in range(lines)))
    rows = cut.select("id", "mark", F.posexplode(shifted).alias("pos", "w"))
    parts = [F.col(f"w.l{k}") for k in range(lines)]
    rows = rows.where(F.trim(F.concat(*parts)) != "")
    return rows.select("id", "mark", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(LINES), *reversed(parts)).alias("h2"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """df with its text column cut, n_lines (before) and n_removed."""
    spark = df.sparkSession
    mark = F.xxhash64(F.col(text))
    found = windows(df.select(F.col(doc_id).alias("id"), mark.alias("mark"), F.col(text).alias("text")), lines)
    place = F.struct("id", "mark", "pos")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    repeated = common.stored(spark, repeated.select("h1", "h2", "first"), "repeated")
    later = found.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    spots = F.flatten(F.collect_list(F.array(*(F.col("pos") + k for k in range(lines)))))
    covered = later.groupBy("id", "mark").agg(F.array_distinct(spots).alias("__covered"))
    covered = common.stored(spark, covered, "covered").withColumnsRenamed({"id": "__id", "mark": "__mark"})

    # The split texts cross the join, so that no later expression splits a text for each of its lines.
    others = [c for c in df.columns if c not in (text, "n_lines", "n_removed")]
    base = df.select(*others, _lines(F.col(text)).alias("__lines"), mark.alias("__own"))
    # The same join at every size: a small table of covered lines would be broadcast, a large one is not.
    both = base.join(covered.hint("merge"), base[doc_id].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    last = F.greatest(F.size("__lines") - 1, F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), last), F.col("__covered"))
    cut = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    gone = F.when(F.col("__covered").isNull(), 0).otherwise(F.size("__covered"))
    columns = {
        text: F.when(F.col("__lines").isNull(), F.lit(None)).when(F.col("__covered").isNull(), F.array_join("__lines", "\n")).otherwise(cut),
        "n_lines": F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long"),
        "n_removed": gone.cast("long"),
    }
    order = [*(c for c in df.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    return both.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in order))


ORACLE_SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos FROM cut),
windows AS (
  SELECT doc_id, pos, line AS l0,
    lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(pos, 2) OVER w AS fin
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS k
  FROM windows WHERE fin IS NOT NULL AND trim(l0 || l1 || l2, ' ') <> ''),
covered AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM numbered, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN c.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text,
    count(*) AS n_lines, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
