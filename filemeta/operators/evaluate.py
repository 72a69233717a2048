"""Coverage and accuracy of parsed rows. Rates of no rows are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def as_text(df: DataFrame, fields: list[str] = values.FIELDS) -> DataFrame:
    """Maps and structs among the fields as JSON, so that all compare as text."""
    kinds = dict(df.dtypes)
    return df.withColumns({f: F.to_json(f) for f in fields if kinds[f].startswith(("map", "struct", "array"))})


def rate(n: Column, of: Column, places: int = 2, scale: float = 100.0) -> Column:
    return F.round(F.coalesce(F.try_divide(n.cast("double"), of.cast("double")) * scale, F.lit(0.0)), places)


def coverage(df: DataFrame, fields: list[str] = values.FIELDS) -> DataFrame:
    """One row: total_rows, the share of rows with each field, and the mean of the rows' match rates (4 places)."""
    shares = [F.coalesce(F.avg(F.when(_filled(F.col(f)), 1.0).otherwise(0.0)), F.lit(0.0)).alias(f) for f in fields]
    mean = [F.round(F.coalesce(F.avg(F.round("match_rate", 4)), F.lit(0.0)), 4).alias("avg_match_rate")] if "match_rate" in df.columns else []
    return as_text(df, fields).agg(F.count("*").alias("total_rows"), *shares, *mean)


def top_patterns(df: DataFrame, k: int = 20, pattern: str = "pattern", order: str = "row_id") -> DataFrame:
    """The k most frequent patterns; ties by first appearance."""
    found = df.where(_filled(F.col(pattern))).groupBy(F.col(pattern).alias("pattern")).agg(F.count("*").alias("n"), F.min(order).alias("first_row"))
    return found.orderBy(F.desc("n"), F.asc("first_row")).limit(k)


def anomalies(df: DataFrame, unlabeled: str = "unlabeled") -> DataFrame:
    n = F.size(F.array_distinct(F.coalesce(unlabeled, F.array().cast("array<string>"))))
    return df.agg(F.count_if(n > 0).alias("rows_with_unlabeled_tokens"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_unlabeled_tokens"))


def pair(parsed: DataFrame, reference: DataFrame, key: str = "row_id", check: bool = True) -> DataFrame:
    """Rows side by side: p_ and r_ columns. Both must have the same rows, unless check is off."""
    if check and (a := parsed.count()) != (b := reference.count()):
        raise ValueError(f"Row count mismatch: {a} parsed vs {b} reference")
    side = lambda df, p: df.select(F.col(key), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key))
    return side(parsed, "p").join(side(reference, "r"), key)


def long_form(pairs: DataFrame, fields: list[str] = values.FIELDS, key: str = "row_id") -> DataFrame:
    """(row, field, ord, parsed, expected): a row per field and file."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f"p_{f}").alias("parsed"), F.col(f"r_{f}").alias("expected")) for i, f in enumerate(fields)))
    return pairs.select(key, F.inline(rows))


def field_metrics(long: DataFrame) -> DataFrame:
    """Counts, opportunities and rates by field, and over all fields in the row `overall`: false negatives,
    false positives, accuracy. Presence takes null and '' alike."""
    p, r = _filled(F.col("parsed")), _filled(F.col("expected"))
    n = lambda c, name: F.count_if(c).alias(name)
    made = long.rollup("field").agg(n(r & ~p, "fn"), n(r, "fn_of"), n(~r & p, "fp"), n(~r, "fp_of"), n(r & (F.col("parsed") == F.col("expected")), "acc"), n(r, "acc_of"))
    return made.select(
        F.coalesce("field", F.lit("overall")).alias("field"), "fn", "fn_of", rate(F.col("fn"), F.col("fn_of")).alias("fn_rate"), "fp", "fp_of", rate(F.col("fp"), F.col("fp_of")).alias("fp_rate"),
        "acc", "acc_of", rate(F.col("acc"), F.col("acc_of")).alias("acc_rate"),
    )


def file_metrics(pairs: DataFrame, fields: list[str] = values.FIELDS) -> DataFrame:
    """One row: files, pattern matches and perfect files; perfect takes null and '' apart."""
    has = _filled(F.col("r_pattern"))
    perfect = F.lit(True)
    for f in fields:
        perfect = perfect & F.col(f"p_{f}").eqNullSafe(F.col(f"r_{f}"))
    c = pairs.agg(F.count("*").alias("files"), F.count_if(has).alias("pattern_of"), F.count_if(has & F.col("p_pattern").eqNullSafe(F.col("r_pattern"))).alias("pattern_matches"), F.count_if(perfect).alias("perfect"))
    return c.select("files", "pattern_matches", "pattern_of", rate(F.col("pattern_matches"), F.col("pattern_of")).alias("pattern_rate"), "perfect", rate(F.col("perfect"), F.col("files")).alias("perfect_rate"))


def scores(metrics: DataFrame) -> DataFrame:
    """Precision, recall and F1 by field (an extension): hits are accurate values, what was wrong counts on both sides."""
    hit, wrong = F.col("acc"), F.col("fn_of") - F.col("fn") - F.col("acc")
    precision = rate(hit, hit + wrong + F.col("fp"), 6, 1.0)
    recall = rate(hit, F.col("fn_of"), 6, 1.0)
    made = metrics.select("field", precision.alias("precision"), recall.alias("recall"))
    return made.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 6))


def mismatches(long: DataFrame, samples: int = 10, key: str = "row_id") -> DataFrame:
    """The first so many mismatches of each field in order of rows, of these the first 3 * samples in order of
    fields; one pass, in which Spark keeps each task's rows of a field bounded."""
    p, r = _filled(F.col("parsed")), _filled(F.col("expected"))
    kind = F.when(r & ~p, "false_negative").when(~r & p, "false_positive").when(r & (F.col("parsed") != F.col("expected")), "incorrect")
    found = long.withColumn("type", kind).where("type is not null")
    place = F.row_number().over(Window.partitionBy("field").orderBy(key))
    return found.withColumn("__place", place).where(F.col("__place") <= samples).drop("__place").orderBy("ord", key).limit(3 * samples)


def diff_cell(parsed: Column, expected: Column) -> Column:
    """The value both agree on, or a JSON object of what was expected and returned."""
    told = F.to_json(F.struct(expected.alias("expected"), parsed.alias("returned")), {"ignoreNullFields": "false"})
    return F.when(parsed.eqNullSafe(expected), parsed).otherwise(told)


def is_discrepancy(cell: Column) -> Column:
    return F.coalesce(cell.contains('"expected":'), F.lit(False))


def diff_rows(pairs: DataFrame, fields: list[str], key: str = "row_id") -> DataFrame:
    return pairs.select(key, *(diff_cell(F.col(f"p_{f}"), F.col(f"r_{f}")).alias(f) for f in fields))


def missing_values(pairs: DataFrame, field: str, incorrect: bool = False) -> DataFrame:
    """Distinct expected values of a field that were not found, sorted: entries that a dictionary lacks. With
    incorrect, also those in whose place another value was returned."""
    p = F.col(f"p_{field}")
    missed = ~_filled(p) | (p != F.col(f"r_{field}")) if incorrect else ~_filled(p)
    return pairs.where(_filled(F.col(f"r_{field}")) & missed).select(F.col(f"r_{field}").alias("value")).distinct().orderBy("value")


def suggestions(pairs: DataFrame) -> dict:
    """Missing studios, missing codes, and noisy groups with their counts."""
    listed = lambda df: [r.value for r in df.collect()]
    return {"missing_studios": listed(missing_values(pairs, "studio")), "missing_studio_codes": listed(missing_values(pairs, "studio_code", incorrect=True)), "noisy_groups": [(r.value, r.n) for r in false_groups(pairs).collect()]}


def false_groups(pairs: DataFrame) -> DataFrame:
    """Values returned as group where none was expected, most frequent first."""
    found = pairs.where(_filled(F.col("p_group")) & ~_filled(F.col("r_group"))).groupBy(F.col("p_group").alias("value")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "value")
