"""Field comparison of parsed metadata with existing records.

A null value is absent; an empty string is a value (it compares with similarity 0). Two profiles: `full` (status,
similarity, confidence, recommendation, reason) and `light` (status, similarity, confidence; stricter bounds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Bounds, base confidences, and how the reasons name a field.
THRESHOLDS = {"exact_match": 1.0, "minor_diff": 0.9, "major_diff": 0.5}
CONFIDENCE = {"studio": 0.9, "title": 0.7, "date": 0.8, "studio_code": 0.8}
SPOKEN = {"studio": ("studio", "Studio names"), "title": ("title", "Titles"), "date": ("date", "Dates"), "studio_code": ("studio code", "Studio codes")}
REVIEW_BELOW = 0.8
# Date formats, in order; the first that reads the whole value counts.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy", "M-yyyy"]
VALID_FORMATS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s"]
FIELDS = list(CONFIDENCE)
RESULT = "struct<status:string,similarity:double,confidence:double,recommendation:string,reason:string>"
_NORMAL = {"studio": text.normalize_studio, "title": text.normalize_title, "studio_code": text.normalize_code}


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """A timestamp by the first format that fits; null if none does. A format is tried only on values of its shape,
    as fields may be unpadded."""
    c = text.strip(c)
    cases = []
    for f in formats or DATE_FORMATS:
        shape = "".join({"y": r"\d{4}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}", "'": ""}.get(x, text.literal(x)) for x in f.replace("yyyy", "y"))
        cases.append(F.when(c.rlike(f"^{shape}\\z"), F.try_to_timestamp(c, F.lit(f))))
    return F.coalesce(*cases)


def _result(status, similarity, confidence, recommendation, reason) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(status).alias("status"), lit(similarity).cast("double").alias("similarity"), lit(confidence).cast("double").alias("confidence"), lit(recommendation).alias("recommendation"), lit(reason).alias("reason")).cast(RESULT)


def compare_field(field: str, parsed: Column, original: Column, confidence: Column | None = None, review_below: float = REVIEW_BELOW, thresholds: dict | None = None) -> Column:
    """The full profile's struct for one field."""
    t, (name, plural) = THRESHOLDS | (thresholds or {}), SPOKEN[field]
    base = F.coalesce(confidence if confidence is not None else F.lit(None).cast("double"), F.lit(CONFIDENCE[field]))
    both = _dates(parsed, original, base) if field == "date" else _strings(field, parsed, original, base, t, plural)
    return (
        F.when(parsed.isNull() & original.isNull(), _result("no_change", 1.0, 1.0, "accept_parsed", "Both values are empty"))
        .when(parsed.isNull(), _result("no_data", 0.0, 0.0, "keep_original", f"No parsed {name} available"))
        .when(original.isNull(), _result("new_data", 1.0, base, F.when(base >= review_below, "accept_parsed").otherwise("manual_review"), f"New {name} data where original was empty"))
        .otherwise(both)
    )


def _strings(field: str, parsed: Column, original: Column, base: Column, t: dict, plural: str) -> Column:
    def graded(s: Column) -> Column:
        longer = F.when(F.length(parsed) > F.length(original), "accept_parsed").otherwise("keep_original")
        sure = F.least(base, s)
        return (
            F.when(s >= t["exact_match"], _result("match", s, sure, "keep_original", f"{plural} match exactly"))
            .when(s >= t["minor_diff"], _result("minor_diff", s, sure, longer, f"{plural} are very similar"))
            .when(s >= t["major_diff"], _result("major_diff", s, sure, "manual_review", f"{plural} have significant differences"))
            .otherwise(_result("conflict", s, sure, "manual_review", f"{plural} are completely different"))
        )

    return text.let(text.similarity(_NORMAL[field](parsed), _NORMAL[field](original)), graded)


def _dates(parsed: Column, original: Column, base: Column) -> Column:
    def graded(x: Column) -> Column:
        seconds = x.p.cast("bigint") - x.o.cast("bigint")
        days = F.abs(F.floor(seconds / 86400))  # whole days between, counted down as a difference of times is
        plain = text.similarity(parsed, original)
        unread = _result(F.when(plain < 0.8, "conflict").otherwise("major_diff"), plain, F.when(x.p.isNull(), 0.0).otherwise(F.least(base, plain)), "manual_review", "Date format could not be normalized")
        row = lambda status, s, what, why: _result(status, s, F.least(base, F.lit(s)), what, why)
        return (
            F.when(x.p.isNull() | x.o.isNull(), unread)
            .when(x.p == x.o, row("match", 1.0, "keep_original", "Dates match exactly"))
            .when(days <= 1, row("minor_diff", 0.95, "accept_parsed", "Dates differ by 1 day or less"))
            .when(days <= 7, row("major_diff", 0.8, "manual_review", "Dates differ by less than a week"))
            .otherwise(row("conflict", 0.3, "manual_review", "Dates differ by more than a week"))
        )

    return text.let(F.struct(parse_date(parsed).alias("p"), parse_date(original).alias("o")), graded)


def compare_lightly(field: str, parsed: Column, original: Column) -> Column:
    """(status, similarity, confidence) of the light profile."""
    row = lambda s, x, c: F.struct(F.lit(s).alias("status"), x.cast("double").alias("similarity"), c.cast("double").alias("confidence"))
    none, a, b = F.lit(None), text.normalize_lightly(parsed, field), text.normalize_lightly(original, field)
    graded = lambda s: F.when(a == b, row("match", F.lit(1.0), F.lit(1.0))).when(s > 0.9, row("minor_diff", s, s)).when(s > 0.5, row("major_diff", s, s)).otherwise(row("conflict", s, s))
    return (
        F.when(parsed.isNull() & original.isNull(), row("no_change", none, F.lit(1.0)))
        .when(parsed.isNull(), row("no_data", none, F.lit(0.0)))
        .when(original.isNull(), row("new_data", none, F.lit(0.8)))
        .otherwise(text.let(text.similarity(a, b), graded))
    )


def overall_status(statuses: Column) -> Column:
    """(overall_status, auto_approve, requires_review) of an array of statuses."""
    major = F.exists(statuses, lambda s: s.isin("major_diff", "conflict"))
    minor = F.exists(statuses, lambda s: s == "minor_diff")
    status = F.when(major, "major_conflicts").when(minor, "minor_conflicts").otherwise("no_conflicts")
    return F.struct(status.alias("overall_status"), (~major & ~minor).alias("auto_approve"), (major | minor).alias("requires_review"))


def compare_rows(df: DataFrame, parsed: dict[str, str], original: dict[str, str], review_below: float = REVIEW_BELOW, thresholds: dict | None = None, confidence: str | None = None) -> DataFrame:
    """Add cmp_<field> structs, and overall_status, auto_approve, requires_review. parsed and original give the
    column of each field; confidence is a map column by field."""
    sure = lambda f: F.try_element_at(F.col(confidence), F.lit(f)) if confidence else None
    made = {f"cmp_{f}": compare_field(f, F.col(parsed[f]), F.col(original[f]), sure(f), review_below, thresholds) for f in FIELDS}
    df = df.withColumns(made).withColumn("__o", overall_status(F.array(*(F.col(f"cmp_{f}").status for f in FIELDS))))
    return df.select(*(c for c in df.columns if c != "__o"), "__o.*")
