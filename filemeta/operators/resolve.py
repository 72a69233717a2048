"""Fields from the file name and from its path brought together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of a value that the path gives.
PATH_CONFIDENCE = 0.6


def choose(name_value: Column, path_value: Column, confidence: Column, path_confidence: float = PATH_CONFIDENCE) -> Column:
    """(value, source, confidence): the name's value unless it is empty, or less sure than a path's that is there."""
    has_name, has_path = F.coalesce(name_value, F.lit("")) != "", F.coalesce(path_value, F.lit("")) != ""
    sure = F.coalesce(confidence, F.lit(1.0))
    by_path = has_path & (~has_name | (sure < path_confidence))
    return F.struct(
        F.when(by_path, path_value).when(has_name, name_value).alias("value"),
        F.when(by_path, "path").when(has_name, "filename").alias("source"),
        F.when(by_path, F.lit(path_confidence)).when(has_name, sure).otherwise(0.0).alias("confidence"),
    )


def resolve(fields: dict[str, Column], path_group: Column, confidences: Column | None = None) -> Column:
    """(values, sources, confidences): maps by field, entries for those with a value. Only the group can come from
    the path."""
    sure = lambda f: F.try_element_at(confidences, F.lit(f)) if confidences is not None else F.lit(None).cast("double")
    none = F.lit(None).cast("string")
    made = F.array(*(F.struct(F.lit(f).alias("k"), choose(c, path_group if f == "group" else none, sure(f)).alias("x")) for f, c in fields.items()))
    kept = F.filter(made, lambda p: p.x.source.isNotNull())
    as_map = lambda part: F.map_from_entries(F.transform(kept, lambda p: F.struct(p.k, p.x[part])))
    return F.struct(as_map("value").alias("values"), as_map("source").alias("sources"), as_map("confidence").alias("confidences"))
