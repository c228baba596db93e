"""How two sides differ in coverage and in words: smoothed log-odds over equally weighted outlets, in long form.

Replicates (bootstrap, split halves, permutations, leave-one-out) are rows of a weight table: each metric takes a table
(rep, source, side, m) and is computed for all replicates in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import log_odds
from quillspark.sources.tables import sized, stored


def shares(counts: DataFrame) -> DataFrame:
    """(source, cluster, n, total, s) with all pairs of an outlet and a cluster, zeros kept. counts: source, cluster, n."""
    outlets = counts.groupBy("source").agg(F.sum("n").alias("total"))
    grid = outlets.crossJoin(F.broadcast(counts.select("cluster").distinct()))
    return grid.join(counts, ["source", "cluster"], "left").select("source", "cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "total", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("s"))


def delta(s: DataFrame, weights: DataFrame, alpha: float) -> DataFrame:
    """(rep, cluster, delta, z, zero): right minus left. weights: rep, source, side, m; other sides count for the prior only."""
    rows = s.join(weights, "source")
    on = lambda side, x: F.sum(F.when(F.col("side") == side, x))
    m = F.col("m")
    g = rows.groupBy("rep", "cluster").agg(
        (on("right", m * F.col("s")) / on("right", m)).alias("pr"), (on("left", m * F.col("s")) / on("left", m)).alias("pl"), on("right", m * F.col("total")).alias("nr"), on("left", m * F.col("total")).alias("nl"), (alpha * F.sum(m * F.col("s")) / F.sum(m)).alias("a"),
    )
    yr, yl = F.col("pr") * F.col("nr"), F.col("pl") * F.col("nl")
    d = log_odds(yr, F.col("nr"), F.col("a"), alpha) - log_odds(yl, F.col("nl"), F.col("a"), alpha)
    return g.select("rep", "cluster", d.alias("delta"), (d / F.sqrt(1 / (yr + F.col("a")) + 1 / (yl + F.col("a")))).alias("z"), ((yr == 0) | (yl == 0)).alias("zero"))


def framing_words(counts: DataFrame, sides: DataFrame, min_tokens: int, min_word: int) -> DataFrame:
    """(cluster, source, word, n, total, side) of the outlets with enough tokens and the words with enough use among them."""
    totals = counts.groupBy("cluster", "source").agg(F.sum("n").alias("total")).where(F.col("total") >= min_tokens)
    rows = counts.join(sized(stored(totals, "totals")), ["cluster", "source"]).join(sized(sides), "source")
    kept = rows.groupBy("cluster", "word").agg(F.sum("n").alias("u")).where(F.col("u") >= min_word).select("cluster", "word")
    return rows.join(kept, ["cluster", "word"])


def framing(rows: DataFrame, weights: DataFrame, alpha: float, least: int) -> DataFrame:
    """(rep, cluster, word, pi, delta, z): word log-odds, right minus left. weights: rep, cluster, source, side, m.

    The background is fixed from all outlets of the cluster and made to sum to one; a replicate only reweights the sides.
    Clusters need so many outlets a side.
    """
    cells, weights = stored(rows.select("cluster", "source", "total").distinct(), "cells"), sized(weights)
    outlets = cells.groupBy("cluster").agg(F.count("*").alias("k"))
    x = rows.select("cluster", "source", "word", (F.col("n") / F.col("total")).alias("x"))
    pi = x.groupBy("cluster", "word").agg(F.sum("x").alias("sx")).join(F.broadcast(outlets), "cluster").select("cluster", "word", (F.col("sx") / F.col("k")).alias("raw"))
    whole = pi.groupBy("cluster").agg(F.sum("raw").alias("whole"))
    pi = pi.join(F.broadcast(whole), "cluster").select("cluster", "word", (F.col("raw") / F.col("whole")).alias("pi"))
    on = lambda side, v: F.sum(F.when(F.col("side") == side, v).otherwise(0.0))
    m = F.col("m")
    side = weights.join(sized(cells), ["cluster", "source"]).groupBy("rep", "cluster").agg(
        on("right", m).alias("mr"), on("left", m).alias("ml"), on("right", m * F.col("total")).alias("nr"), on("left", m * F.col("total")).alias("nl"), F.count_if(F.col("side") == "right").alias("kr"), F.count_if(F.col("side") == "left").alias("kl")
    ).where((F.col("kr") >= least) & (F.col("kl") >= least))
    side = stored(side, "sides")
    used = x.join(weights, ["cluster", "source"]).groupBy("rep", "cluster", "word").agg(on("right", m * F.col("x")).alias("xr"), on("left", m * F.col("x")).alias("xl"))
    # words that neither side uses still count for the score
    grid = sized(side).join(pi, "cluster").join(used, ["rep", "cluster", "word"], "left").fillna(0.0, ["xr", "xl"])
    a, yr, yl = alpha * F.col("pi"), F.col("xr") / F.col("mr") * F.col("nr"), F.col("xl") / F.col("ml") * F.col("nl")
    d = log_odds(yr, F.col("nr"), a, alpha) - log_odds(yl, F.col("nl"), a, alpha)
    return grid.select("rep", "cluster", "word", "pi", d.alias("delta"), (d / F.sqrt(1 / (yr + a) + 1 / (yl + a))).alias("z"))


def divergence(words: DataFrame) -> DataFrame:
    return words.groupBy("rep", "cluster").agg(F.sum(F.col("pi") * F.abs("delta")).alias("score"))


def replicates(outlets: DataFrame, n: int) -> DataFrame:
    """outlets for each replicate 1 to n: both small by construction."""
    return outlets.crossJoin(F.broadcast(outlets.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("rep"))))


def shuffled(order: Column, *by: str):
    return F.row_number().over(Window.partitionBy(*by).orderBy(order, "source"))


def bootstrap(outlets: DataFrame, n: int) -> DataFrame:
    """(rep, source, side, m): m times each outlet is drawn, with replacement, within its side."""
    ranked = outlets.select("source", "side", F.row_number().over(Window.partitionBy("side").orderBy("source")).alias("k"), F.count("*").over(Window.partitionBy("side")).alias("size"))
    draws = replicates(ranked, n)
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("side"), F.col("rep").cast("string"), F.col("k").cast("string"))), 1, 6), 16, 10).cast("long") % F.col("size") + 1
    hits = draws.select("rep", "side", pick.alias("k")).groupBy("rep", "side", "k").agg(F.count("*").alias("m"))
    return hits.join(ranked.select("source", "side", "k"), ["side", "k"]).select("rep", "source", "side", "m")
