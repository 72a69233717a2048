"""Columns computed once: a generator between two projections keeps the optimizer from inlining one in the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added or replaced. Long expressions over array functions would otherwise be copied to each
    place, and in each element of a later lambda, where the column is used; an inline() of one struct is a row's only
    pass and costs no shuffle."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def unpack(df: DataFrame, made: Column, *names: str) -> DataFrame:
    """df with the fields of one struct as columns of these names; the struct is made once a row. Fields of a struct
    column that stays whole must not be used above a generator: the optimizer loses them there."""
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(made)).alias(*names))
