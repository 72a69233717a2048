"""Updates of records from parsed metadata: build, resolve the studio, validate, count. A field that already has a
value is never part of an update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .compare import FIELDS, VALID_FORMATS, parse_date
from .studios import blocked, grams

# The limit of a title, and the cost model of an update run.
TITLE_MOST, BATCH, ROWS_A_SECOND, CALL_S, PAUSE_S = 500, 20, 2.0, 0.1, 0.5


def default_confidence(studio: Column, title: Column, code: Column, date: Column, given: Column | None = None) -> Column:
    """The given map if it has entries, else 0.9, 0.7, 0.8 and 0.8 for the fields that have a value."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.coalesce(c, F.lit("")) != "", F.lit(v)).alias("v")) for k, c, v in (("studio", studio, 0.9), ("title", title, 0.7), ("studio_code", code, 0.8), ("date", date, 0.8))))
    made = F.map_from_entries(F.filter(pairs, lambda p: p.v.isNotNull()))
    return made if given is None else F.when(F.size(given) > 0, given).otherwise(made)


def build_update(parsed: dict[str, Column], original: dict[str, Column], approved: Column | None = None, mark_organized: bool = False) -> Column:
    """(studio_name, title, date, code, organized), null where a field is not part of the update. A studio counts as
    present if it is not null, the other fields if they are not blank. approved: names of the fields to use."""
    has = {f: original[f].isNotNull() if f == "studio" else ~text.blank(original[f]) for f in FIELDS}
    ok = {f: F.coalesce(F.array_contains(approved, f), F.lit(False)) if approved is not None else F.lit(True) for f in FIELDS}
    value = {f: F.when(ok[f] & ~has[f] & (parsed[f] != ""), parsed[f]) for f in FIELDS}
    there = {f: ok[f] & parsed[f].isNotNull() for f in FIELDS}
    organized = F.when(there["studio"] & (there["title"] | there["date"] | there["studio_code"]), F.lit(True)) if mark_organized else F.lit(None).cast("boolean")
    return F.struct(value["studio"].alias("studio_name"), value["title"].alias("title"), value["date"].alias("date"), value["studio_code"].alias("code"), organized.alias("organized"))


def resolve_studios(df: DataFrame, studios: DataFrame, name: str = "studio_name") -> DataFrame:
    """Add studio_id: of the studio of this name, else of the one whose name holds it (the first by name, then id);
    null if none. Names, once each, that have no exact match meet only the studios that have their rarest run of three
    letters, by an equi join."""
    names = df.select(F.trim(name).alias("__n")).where("__n <> ''").distinct()
    first = lambda x: F.min(F.struct("name", "id")).alias("m")
    exact = names.join(studios, names["__n"] == studios["name"]).groupBy("__n").agg(first(0)).select("__n", F.col("m.id").alias("id"))
    rest = names.join(exact, "__n", "left_anti")
    runs = blocked(rest.select(F.lower("__n").alias("__low")).distinct(), "__low")
    low = rest.withColumn("__low", F.lower("__n")).join(runs, "__low")
    spots = studios.where("name <> ''").select("id", "name", F.explode(grams(F.lower("name"), [1, 2, 3])).alias("gram"))
    part = low.join(spots, "gram").where(F.contains(F.lower("name"), F.col("__low"))).groupBy("__n").agg(first(0)).select("__n", F.col("m.id").alias("id"))
    found = exact.unionByName(part).withColumnRenamed("id", "studio_id")
    return df.join(found, F.trim(F.col(name)) == F.col("__n"), "left").drop("__n")


def valid_date(c: Column) -> Column:
    return parse_date(c, VALID_FORMATS).isNotNull()


def validate(df: DataFrame, strict: bool = True, id: str = "id") -> DataFrame:
    """Add outcome (ready, skipped, failed) and error to updates (id, studio_id, title, date, code, organized). An
    update of nothing is skipped. strict=False drops a bad date instead of the whole row."""
    bad = ~text.blank(F.col("date")) & ~valid_date(F.col("date"))
    if not strict:
        df = df.withColumn("date", F.when(~bad, F.col("date")))
        bad = F.lit(False)
    nothing = F.coalesce("studio_id", "title", "date", "code", F.col("organized").cast("string")).isNull()
    error = (
        F.when(F.col(id).isNull(), "Missing scene ID")
        .when(nothing, F.lit(None).cast("string"))
        .when(F.length("title") > TITLE_MOST, f"Title too long (max {TITLE_MOST} characters)")
        .when(bad, F.concat(F.lit("Invalid date format: "), "date"))
        .when(F.col("studio_id") == "", "Studio ID could not be resolved")
    )
    return df.withColumn("error", error).withColumn("outcome", F.when(F.col("error").isNotNull(), "failed").when(nothing, "skipped").otherwise("ready"))


def totals(df: DataFrame) -> DataFrame:
    """One row: processed, successful (a dry run's ready rows), failed, skipped. Outcomes go by row, so a lost answer
    is never blamed on another row."""
    n = lambda s: F.count_if(F.col("outcome").isin(*s))
    return df.agg(F.count("*").alias("processed"), n(["ready", "done"]).alias("successful"), n(["failed"]).alias("failed"), n(["skipped"]).alias("skipped"))


def errors(df: DataFrame, id: str = "id") -> DataFrame:
    return df.where("outcome = 'failed'").select(F.col(id).alias("id"), "error", F.lit("validation").alias("type"))


def send(df: DataFrame, client, batch: int = BATCH, pause: float = PAUSE_S, workers: int | None = None) -> DataFrame:
    """Give ready rows to client(list of dicts) -> list of truthy or falsy answers, batch at a time with a pause,
    within each partition; workers sets the partitions. Rows come back with outcome done or failed."""
    kept = df.schema
    names = [f.name for f in kept.fields]

    def run(parts):
        import time

        for pdf in parts:
            outcome, error = pdf["outcome"].tolist(), pdf["error"].tolist()
            ready = [i for i, x in enumerate(outcome) if x == "ready"]
            for at in range(0, len(ready), batch):
                some = ready[at : at + batch]
                rows = [{k: v for k, v in pdf.iloc[i].items() if k in ("id", "studio_id", "title", "date", "code", "organized") and v is not None} for i in some]
                try:
                    answers = list(client(rows))
                except Exception as e:  # the batch fails, the run goes on
                    answers, why = [None] * len(rows), f"Bulk update failed: {e}"
                else:
                    answers, why = answers + [None] * (len(rows) - len(answers)), "API returned no result"
                for i, a in zip(some, answers):
                    outcome[i], error[i] = ("done", None) if a else ("failed", why)
                if at + batch < len(ready) and pause:
                    time.sleep(pause)
            yield pdf.assign(outcome=outcome, error=error)[names]

    return (df.repartition(workers) if workers else df).mapInPandas(run, kept)


def estimate(rows: Column) -> Column:
    """(batches, seconds) by the cost model."""
    batches = F.ceil(rows / BATCH)
    return F.struct(batches.alias("batches"), (rows / ROWS_A_SECOND + batches * (CALL_S + PAUSE_S)).alias("seconds"))
