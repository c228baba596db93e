"""Cluster quality and agreement from grouped sums: nothing of the size of the data is collected or compared in pairs."""

from __future__ import annotations

from itertools import combinations
from math import exp, lgamma, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import association


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    """(label, i, n, s, m): size, sum and mean of each cluster in each dimension."""
    rows = df.select(F.col(label_col).alias("label"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.avg("x").alias("m"))


def quality(df: DataFrame, vector_col: str, label_col: str) -> DataFrame:
    """One row: k, n, max_share, silhouette (of squared distances), calinski_harabasz, davies_bouldin.

    A row's mean squared distance to a cluster follows from the cluster's sums, so the silhouette is that of all rows.
    The clusters' sums, k rows, are broadcast.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(label_col).alias("label"), v.alias("v"), _dot(v, v).alias("q"))
    sums = centroids(df, label_col, vector_col).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("s"))
    parts = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("q").alias("q")).join(sums, "label")
    every = F.broadcast(parts.agg(F.array_sort(F.collect_list(F.struct("label", "n", "q", "s"))).alias("cs")))
    one = rows.crossJoin(every)
    far = lambda c: F.when(c["label"] == F.col("label"), F.try_divide(c["n"] * F.col("q") - 2 * _dot(F.col("v"), c["s"]) + c["q"], c["n"] - 1)).otherwise(F.col("q") + (c["q"] - 2 * _dot(F.col("v"), c["s"])) / c["n"])
    one = one.withColumn("ds", F.transform("cs", lambda c: F.struct((c["label"] == F.col("label")).alias("own"), far(c).alias("d"))))
    a = F.element_at(F.filter("ds", lambda x: x["own"]), 1)["d"]
    b = F.array_min(F.transform(F.filter("ds", lambda x: ~x["own"]), lambda x: x["d"]))
    mine = F.element_at(F.filter("cs", lambda c: c["label"] == F.col("label")), 1)
    one = one.select("label", a.alias("a"), b.alias("b"), F.sqrt(_dot(*[F.zip_with("v", mine["s"], lambda x, s: x - s / mine["n"])] * 2)).alias("r"))
    found = one.groupBy("label").agg(F.avg("r").alias("r"), F.sum(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("sil"))
    rows_ = sorted(((c.label, c.n, c.q, c.s, c.r, c.sil) for c in parts.join(found, "label").collect()), key=lambda c: c[0])  # k rows
    n, k = sum(c[1] for c in rows_), len(rows_)
    within = sum(c[2] - sum(x * x for x in c[3]) / c[1] for c in rows_)
    total = sum(c[2] for c in rows_) - sum(sum(c[3][i] for c in rows_) ** 2 for i in range(len(rows_[0][3]))) / n if rows_ else 0.0
    worst = [max(((x[4] + y[4]) / sum((s / x[1] - t / y[1]) ** 2 for s, t in zip(x[3], y[3])) ** 0.5 for y in rows_ if y is not x), default=0.0) for x in rows_]
    ch = ((total - within) / (k - 1)) / (within / (n - k)) if 1 < k < n else None
    values = (k, n, round(max(c[1] for c in rows_) / n, 6), round(sum(c[5] for c in rows_) / n, 6), None if ch is None else round(ch, 6), round(sum(worst) / k, 6)) if rows_ else (0, 0, None, None, None, None)
    return df.sparkSession.createDataFrame([values], "k long, n long, max_share double, silhouette double, calinski_harabasz double, davies_bouldin double")


def _fit(df: DataFrame, id_col: str, vector_col: str, k: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(id_col, vector_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select(id_col, vector_col, F.col("prediction").alias("label"))


def sweep(df: DataFrame, id_col: str, vector_col: str, ks, limit: float = 0.15, seed: int = 1) -> DataFrame:
    """(k, silhouette, calinski_harabasz, davies_bouldin, max_share, picked): the pick has the best silhouette of those
    whose largest cluster is within the limit; none is picked if all exceed it."""
    rows = [quality(_fit(df, id_col, vector_col, k, seed), vector_col, "label").first() for k in ks]
    fit = [r for r in rows if r.max_share <= limit]
    best = max(fit, key=lambda r: r.silhouette).k if fit else None
    out = [(r.k, r.silhouette, r.calinski_harabasz, r.davies_bouldin, r.max_share, r.k == best) for r in rows]
    return df.sparkSession.createDataFrame(out, "k long, silhouette double, calinski_harabasz double, davies_bouldin double, max_share double, picked boolean")


def stability(df: DataFrame, id_col: str, vector_col: str, k: int, seeds: tuple[int, ...]) -> DataFrame:
    """(a, b, ari) of each pair of starts."""
    fits = {s: _fit(df, id_col, vector_col, k, s).select(id_col, F.col("label").alias(f"l{s}")) for s in seeds}
    out = None
    for a, b in combinations(seeds, 2):
        part = association(fits[a].join(fits[b], id_col), f"l{a}", f"l{b}").select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ari")
        out = part if out is None else out.unionAll(part)
    return out


def adjusted_mutual_information(table: list[list[int]]) -> float:
    """Of two labelings with these counts: information less that of random labelings of the same sizes, by their mean entropy."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table)]
    n = sum(rows)
    entropy = lambda xs: -sum(x / n * log(x / n) for x in xs if x)
    seen = sum(x / n * log(n * x / (a * b)) for r, a in zip(table, rows) for x, b in zip(r, cols) if x)
    fact = lambda x: lgamma(x + 1)
    chance = 0.0
    for a in rows:
        for b in cols:
            for x in range(max(1, a + b - n), min(a, b) + 1):
                p = fact(a) + fact(b) + fact(n - a) + fact(n - b) - fact(n) - fact(x) - fact(a - x) - fact(b - x) - fact(n - a - b + x)
                chance += x / n * log(n * x / (a * b)) * exp(p)
    half = (entropy(rows) + entropy(cols)) / 2
    return 1.0 if half - chance == 0 else (seen - chance) / (half - chance)


def agreement_by(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, ami, ari) of two labelings within each group, from counts of their pairs of labels."""
    counts = df.groupBy(by, a, b).agg(F.count("*").alias("n")).collect()  # pairs of labels, however many rows
    out = []
    for g in sorted({r[0] for r in counts}):
        own = {(r[1], r[2]): r.n for r in counts if r[0] == g}
        xs, ys = sorted({x for x, _ in own}), sorted({y for _, y in own})
        t = [[own.get((x, y), 0) for y in ys] for x in xs]
        pairs = lambda v: v * (v - 1) / 2
        rows, cols, n = [sum(r) for r in t], [sum(c) for c in zip(*t)], sum(own.values())
        p, q, both = sum(map(pairs, rows)), sum(map(pairs, cols)), sum(pairs(v) for r in t for v in r)
        expected = p * q / pairs(n) if n > 1 else 0.0
        ari = 1.0 if (p + q) / 2 == expected else (both - expected) / ((p + q) / 2 - expected)
        out.append((g, n, round(adjusted_mutual_information(t), 6), round(ari, 6)))
    return df.sparkSession.createDataFrame(out, f"{by} {dict(df.dtypes)[by]}, n long, ami double, ari double")
