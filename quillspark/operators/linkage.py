"""Agglomerative clustering by rounds of mutual nearest neighbours, with a cut into a number of clusters.

Vectors are first gathered into micro-clusters, so that the table of distances, a row a pair of them, has a size of its own
and not the data's. In a round every cluster finds its nearest other one, all pairs that are each other's nearest merge, and
distances to what merged follow from those to its parts (Lance-Williams), by joins and grouped sums; each round is written.
For Ward's, complete and average linkage such merges, in whatever order, give the tree that merging one pair at a time gives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import removed, stored

METHODS = ("ward", "complete", "average")


def micro_clusters(df: DataFrame, id_col: str, vector_col: str, most: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((id, i), (i, n, v)): the micro-cluster of each vector, and each one's size and mean; repeated vectors are in one.

    Up to `most` different vectors are micro-clusters each; of more, k-means makes `most`.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = stored(df.where(v.isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")), "vectors")
    kinds = rows.select("v").distinct()
    if kinds.limit(most + 1).count() <= most:
        number = {tuple(r.v): i for i, r in enumerate(sorted(kinds.collect(), key=lambda r: tuple(r.v)))}  # at most `most`
        names = df.sparkSession.createDataFrame([(i, list(k)) for k, i in number.items()], "i int, v array<double>")
        placed = rows.join(F.broadcast(names), "v").select("id", "i", "v")
    else:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        data = rows.withColumn("features", array_to_vector("v"))
        placed = KMeans(k=most, seed=seed, maxIter=20).fit(data).transform(data).select("id", F.col("prediction").alias("i"), "v")
    placed = stored(placed, "placed")
    each = placed.select("i", F.posexplode("v").alias("p", "x")).groupBy("i", "p").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    means = each.groupBy("i").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v"))
    removed(rows)
    return placed.select("id", "i"), stored(means, "means")


def tree(means: DataFrame, method: str) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) by height: the clusters that hold micro-clusters a and b become one. Of equal distances the
    smallest pair of names is nearest."""
    if method not in METHODS:
        raise ValueError(f"linkage must be one of {', '.join(METHODS)}")
    side = lambda k: means.select(F.col("i").alias(k), F.col("v").alias(f"v{k}"), F.col("n").alias(f"n{k}"))
    gap = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    start = F.sqrt(2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * gap) if method == "ward" else F.sqrt(gap)
    # micro-clusters are few by construction, so their pairs are too
    d = stored(side("a").join(F.broadcast(side("b")), F.col("a") != F.col("b")).select("a", "b", "na", "nb", start.alias("d")), "distances")
    merges: list[tuple[int, int, float]] = []
    while True:
        near = d.groupBy("a").agg(F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("m"))
        pairs = near.groupBy("m.lo", "m.hi").agg(F.count("*").alias("k"), F.min("m.d").alias("d")).where("k = 2")
        got = [(r.lo, r.hi, r.d) for r in pairs.collect()]  # at most half the clusters
        if not got:
            removed(d)
            return sorted(merges, key=lambda m: (m[2], m[0], m[1]))
        merges += got
        merged = F.broadcast(d.sparkSession.createDataFrame([(x, lo, hi, h) for lo, hi, h in got for x in (lo, hi)], "old int, to int, other int, height double"))
        for this, that in (("a", "b"), ("b", "a")):  # rows that merge, then columns that do
            x = d.join(merged, F.col(this) == F.col("old"), "left")
            n, m, h = F.col(f"n{this}"), F.col(f"n{that}"), F.max("height")
            key, total = [F.coalesce("to", this).alias(this), F.col(that)], F.sum(n)
            if method == "complete":
                new = F.max("d")
            elif method == "average":
                new = F.sum(n * F.col("d")) / total
            else:
                new = F.when(h.isNull(), F.max("d")).otherwise(F.sqrt(F.greatest(F.lit(0.0), (F.sum((n + m) * F.col("d") * F.col("d")) - F.max(m) * h * h) / (total + F.max(m)))))
            x = x.where(F.col("to").isNull() | (F.coalesce("to", this) != F.col(that)) & (F.col(that) != F.col("other")))
            d_ = x.groupBy(*key).agg(total.alias(f"n{this}"), F.max(m).alias(f"n{that}"), new.alias("d"))
            if this == "b":  # both directions of a pair get one distance, whatever the order of additions was
                first = F.col("a") < F.col("b")
                own = lambda x, y: F.max(F.when(first, F.col(x)).otherwise(F.col(y)))
                d_ = d_.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(own("na", "nb").alias("nl"), own("nb", "na").alias("nh"), F.min("d").alias("d"))
                ways = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(x).alias("na"), F.col(y).alias("nb")) for p, q, x, y in (("lo", "hi", "nl", "nh"), ("hi", "lo", "nh", "nl"))])
                d_ = d_.select("d", F.explode(ways).alias("w")).select("w.*", "d")
            old, d = d, stored(d_.select("a", "b", "na", "nb", "d"), "distances")
            removed(old)


def cut(merges: list[tuple[int, int, float]], names: list[int], k: int) -> dict[int, int]:
    """The cluster, from 0 by its smallest micro-cluster, of each micro-cluster once the lowest merges have left k."""
    parent = {i: i for i in names}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in merges[: max(0, len(names) - k)]:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    number = {r: i for i, r in enumerate(sorted({find(i) for i in names}))}
    return {i: number[find(i)] for i in names}


def clustered(df: DataFrame, id_col: str, vector_col: str, k: int, methods: tuple[str, ...] = METHODS, most: int = 500) -> DataFrame:
    """(id, method, cluster): the clusters of every vector under each linkage."""
    placed, means = micro_clusters(df, id_col, vector_col, most)
    names = sorted(r.i for r in means.select("i").collect())
    rows = [(i, m, c) for m in methods for i, c in cut(tree(means, m), names, k).items()]
    labels = df.sparkSession.createDataFrame(rows, "i int, method string, cluster int")
    return placed.join(F.broadcast(labels), "i").select("id", "method", "cluster")
