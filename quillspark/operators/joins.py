"""Joins with guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def many_to_one(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """A left join that fails if the right side repeats a key, so the row count can't grow."""
    repeated = right.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"keys repeat on the right side: {[tuple(r)[:-1] for r in repeated]}")
    return left.join(right, list(keys), "left")


def fail_on_null(df: DataFrame, column: str, by: str) -> DataFrame:
    """Fails if a code is null where its label is not: an unmapped label."""
    bad = df.where(F.col(column).isNull() & F.col(by).isNotNull()).select(by).distinct().limit(5).collect()
    if bad:
        raise ValueError(f"unmapped labels of {by}: {[r[0] for r in bad]}")
    return df
