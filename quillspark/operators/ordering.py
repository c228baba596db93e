"""Places in a whole order, and what is computed from them, without a task that sees all rows.

Rows are cut into ranges, written once with their range's number, and counted by range; a row's place is what the earlier
ranges hold and its place in its own. Only one row a range is ordered by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import stored

_BEFORE = (Window.unboundedPreceding, -1)


def ahead(df: DataFrame, order: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """The rows with the sum of the weights (1 each if none is given) of all rows ahead of them: 0 for the first.

    Ascending, nulls first. Rows equal in all of `order` fall into one range and their own order is open, so the last
    column should tell rows of a frequent value apart. A null weight counts as 0. An empty table gives no rows.
    """
    own = F.coalesce(weight if weight is not None else F.lit(1), F.lit(0))
    rows = df.withColumn("_own", own).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    rows = stored(rows, "ordered")
    ranges = rows.groupBy("_range").agg(F.sum("_own").alias("_sum"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0)).alias("_earlier"))
    inside = F.sum("_own").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(*_BEFORE))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    # one row a range: the session's shuffle partitions bound it
    return rows.join(F.broadcast(ranges), "_range").select(*df.columns, (F.col("_earlier") + F.col("_inside")).alias(name))


def value_ranks(counts: DataFrame, value: str, n: str = "n", name: str = "rank") -> DataFrame:
    """(value, rank) from one row a value and its count: the mean of the places that the value's rows share, from 1."""
    return ahead(counts.select(value, n), [value], "_ahead", F.col(n)).select(value, (F.col("_ahead") + (F.col(n) + 1) / 2).alias(name))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, pearson, spearman) of the rows that have both values; null where a column is constant or n < 2.

    Rows are counted by pairs of values first, so a hot value is one row of each partner's when ranks are joined to it. Sums
    are taken about the means, which for ranks are (n + 1) / 2.
    """
    pairs = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")), "pairs")
    one = lambda v: value_ranks(pairs.groupBy(v).agg(F.sum("n").alias("n")), v, name=f"r{v}")
    ranked = pairs.join(one("x"), "x").join(one("y"), "y")
    n = F.col("n")
    means = pairs.agg(F.sum(n).alias("total"), (F.sum(n * F.col("x")) / F.sum(n)).alias("mx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    middle = (F.col("total") + 1) / 2
    rx, ry = F.col("rx") - middle, F.col("ry") - middle

    def r(a: Column, b: Column) -> Column:
        return F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b)))

    return ranked.crossJoin(F.broadcast(means)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), r(dx, dy).alias("pearson"), r(rx, ry).alias("spearman"))
