"""Association and agreement measures from grouped counts; rows are aggregated before anything else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def association(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Cramér's V (no correction) and the adjusted Rand index of two labelings."""
    t = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("o"))
    ra, rb = t.groupBy("a").agg(F.sum("o").alias("ra")), t.groupBy("b").agg(F.sum("o").alias("rb"))
    n = t.agg(F.sum("o").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    grid = ra.crossJoin(rb).join(t, ["a", "b"], "left").fillna(0, ["o"]).crossJoin(n)
    e = F.col("ra") * F.col("rb") / F.col("n")
    chi = grid.agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("chi"), F.max("n").alias("n"), F.least(F.count_distinct("a"), F.count_distinct("b")).alias("k"), F.sum(pairs(F.col("o"))).alias("both"))
    one = chi.crossJoin(ra.agg(F.sum(pairs(F.col("ra"))).alias("p"))).crossJoin(rb.agg(F.sum(pairs(F.col("rb"))).alias("q")))
    x = F.col("p") * F.col("q") / pairs(F.col("n"))
    return one.select(F.round(F.sqrt(F.col("chi") / (F.col("n") * (F.col("k") - 1))), 6).alias("cramers_v"), F.round(F.try_divide(F.col("both") - x, (F.col("p") + F.col("q")) / 2 - x), 6).alias("ari"))


def confusion(rows: DataFrame, truth: str, pred: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def kappa(counts: DataFrame, classes: int) -> DataFrame:
    """One row from counts (y, p, n): quadratic weighted kappa, accuracy, macro-F1 over the classes present, shares within one."""
    w = lambda i, j: (F.col(i) - F.col(j)) * (F.col(i) - F.col(j)) / float((classes - 1) ** 2)
    rows, cols = counts.groupBy("y").agg(F.sum("n").alias("rn")), counts.groupBy("p").agg(F.sum("n").alias("cn"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(w("y", "p") * F.col("n")).alias("seen"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("right"), F.sum(F.when(F.abs(F.col("y") - F.col("p")) <= 1, F.col("n")).otherwise(0)).alias("near"))
    chance = rows.crossJoin(cols).agg(F.sum(w("y", "p") * F.col("rn") * F.col("cn")).alias("chance"))
    hit = counts.where("y = p").select(F.col("y").alias("c"), F.col("n").alias("tp"))
    each = rows.select(F.col("y").alias("c"), "rn").join(cols.select(F.col("p").alias("c"), "cn"), "c", "full").join(hit, "c", "left").fillna(0)
    f1 = each.agg(F.avg(2 * F.col("tp") / (F.col("rn") + F.col("cn"))).alias("f1"))
    one = total.crossJoin(chance).crossJoin(f1)
    return one.select(F.col("n"), F.round(1 - F.try_divide(F.col("seen") * F.col("n"), F.col("chance")), 6).alias("qwk"), F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), F.round(F.col("near") / F.col("n"), 6).alias("within_one"), F.round("f1", 6).alias("macro_f1"))
