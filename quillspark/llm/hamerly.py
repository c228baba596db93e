"""Centroid clustering with Hamerly bounds, in whole numbers.

Every vector keeps two bounds from round to round: an upper one on the distance to its own centroid and a lower one on the
distance to the second nearest. When centroids move, the upper bound grows by the own centroid's drift and the lower one
shrinks by the largest drift of the others. A vector whose upper bound stays below its lower one, or below half the way
from its centroid to the next centroid, keeps its cluster unseen; otherwise the upper bound is made exact, and if that is
not enough the vector is ambiguous and all centroids are scanned in exact whole numbers. Bounds are doubles, and compared
with a margin for their rounding, so a skipped vector is never a tie.

A round is one pass over a table in the shared folder: it reads vectors with their bounds and writes them with the new
ones, and each task adds one row a cluster with its vectors' count and sums. The driver gets the sums of these rows, k
times the dimensions, whatever the number of vectors. The round before is removed once the next is written.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; rows
without an id are clustered but no centroid starts from them unless ids run out; rows that repeat an id are vectors each;
of equal distances the smaller cluster wins; fewer vectors than k give fewer centroids; a centroid without vectors stays;
an empty table gives no rows. Components whose squared distances could leave 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, written
from .topk import _matrix

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Relative and absolute margin of a bound: far above the rounding of a few hundred additions of doubles.
MARGIN = 1e-9
_STATE = "vec_id long, v array<long>, cluster int, upper double, lower double, distance long, n long, scanned long, sums array<long>, inertia long"


def vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id long, v array of longs): components times the scale, rounded down, of the rows that take part."""
    v = F.col(vector_col)
    fit = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    most = int((2**61 / dimensions) ** 0.5 / 2)
    whole = lambda x: F.when(F.abs(x) <= most, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("squared distances may not fit in 64 bits")).cast("long"))
    return df.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: whole(x.cast("double") * scale)).alias("v"))


def starts(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k first vectors by the SHA-256 of `seed:vec_id`: only these k come to the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids: in doubles where every sum stays below 2^53, else in 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most**2 < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


class Centroids:
    """Where the centroids are, how far each has drifted, and half the way from each to its next."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None) -> None:
        self.now, k = now, len(now)
        moved = np.zeros(k) if before is None else np.array([squares(a[None], b[None])[0, 0] for a, b in zip(now, before)], np.float64)
        self.drift = np.sqrt(moved) * (1 + MARGIN)
        order = np.argsort(-self.drift, kind="stable")
        self.others = np.full(k, self.drift[order[0]])  # the largest drift of all others
        self.others[order[0]] = self.drift[order[1]] if k > 1 else 0.0
        apart = squares(now, now).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(1)) / 2

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower) of this round and how many vectors were scanned; cluster -1: not assigned yet."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        old = np.maximum(cluster, 0)
        upper += self.drift[old]
        lower -= self.others[old]
        reach = np.maximum(lower, self.half[old])
        clear = lambda rows: upper[rows] * (1 + MARGIN) + MARGIN < reach[rows] * (1 - MARGIN)
        rows = np.flatnonzero((cluster < 0) | ~clear(slice(None)))
        known = rows[cluster[rows] >= 0]
        for c in np.unique(cluster[known]):  # exact distances to the own centroid
            own = known[cluster[known] == c]
            upper[own] = np.sqrt(squares(x[own], self.now[c : c + 1])[:, 0].astype(np.float64))
        rows = rows[(cluster[rows] < 0) | ~clear(rows)]
        if len(rows):
            d = squares(x[rows], self.now)
            cluster[rows] = d.argmin(1)  # the first of equal ones
            two = np.partition(d, 1, axis=1)[:, :2].astype(np.float64) if d.shape[1] > 1 else np.column_stack([d[:, 0], np.full(len(d), np.inf)])
            upper[rows], lower[rows] = np.sqrt(two[:, 0]), np.sqrt(two[:, 1])
        return cluster, upper, lower, len(rows)


def _round(state: DataFrame, centroids: Centroids, last: bool, name: str) -> DataFrame:
    """The state after one assignment, written; each task adds a row a cluster with its counts and sums."""
    k, width = centroids.now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, inertia, scanned = np.zeros(k, np.int64), np.zeros((k, width), np.int64), [0] * k, 0
        names = [f.split()[0] for f in _STATE.split(", ")]
        nulls, longs = pa.nulls, pa.list_(pa.int64())
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), width)
            cluster, upper, lower = (b.column(i).to_numpy() for i in (2, 3, 4))
            cluster, upper, lower, full = centroids.assign(x, cluster, upper, lower)
            scanned += full
            distance = nulls(len(x), pa.int64())
            for c in np.unique(cluster):
                own = x[cluster == c]
                counts[c] += len(own)
                sums[c] += own.sum(0)
            if last:
                d = np.zeros(len(x), np.int64)
                for c in np.unique(cluster):
                    own = cluster == c
                    d[own] = squares(x[own], centroids.now[c : c + 1])[:, 0]
                    inertia[c] += int(d[own].sum())
                distance = pa.array(d)
            n = len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), distance, *[nulls(n, pa.int64())] * 2, nulls(n, longs), nulls(n, pa.int64())], names)
        own = np.flatnonzero(counts)
        if len(own):
            n, doubles = len(own), nulls(len(own), pa.float64())
            yield pa.RecordBatch.from_arrays([nulls(n, pa.int64()), nulls(n, longs), pa.array(own, pa.int32()), doubles, doubles, nulls(n, pa.int64()), pa.array(counts[own]), pa.array(np.where(own == own[0], scanned, 0)), pa.array(sums[own].tolist(), longs), pa.array([inertia[c] for c in own], pa.int64())], names)

    return written(state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, _STATE), name)


def clustered(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scans: list | None = None) -> DataFrame:
    """(vec_id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string) of rows (vec_id, v).

    scans: if given, gets the number of vectors that each assignment scanned in full.
    """
    spark = rows.sparkSession
    prepare(spark)
    now = starts(rows, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(now):
        return spark.createDataFrame([], schema)
    state, before = rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), None
    old, whole = None, lambda c: F.sum(c.cast("decimal(38,0)"))
    for r in range(rounds + 1):
        table = _round(state, Centroids(now, before), r == rounds, "hamerly")
        if old is not None:
            released(old)
        old, state, parts = table, table.where("n IS NULL"), table.where("n IS NOT NULL")
        if scans is not None:
            scans.append(parts.agg(F.sum("scanned")).first()[0])
        if r == rounds:
            break
        each = parts.select("cluster", F.posexplode(F.concat("sums", F.array("n"))).alias("i", "s")).groupBy("cluster", "i").agg(whole(F.col("s")).alias("s"))
        sums = {(x.cluster, x.i): int(x.s) for x in each.collect()}  # k times the dimensions, and the counts
        before, now = now, now.copy()
        for (c, i), s in sums.items():
            if i < now.shape[1]:
                now[c, i] = s // sums[c, now.shape[1]]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    each = parts.groupBy("cluster").agg(whole(F.col("inertia")).cast("long").alias("cluster_inertia"))
    total = each.agg(whole(F.col("cluster_inertia")).cast("long").alias("inertia"))
    sha = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    about = F.broadcast(each.crossJoin(total).join(sha, "cluster"))  # k rows
    return state.select("vec_id", "cluster", "distance").join(about, "cluster").select([c.split()[0] for c in schema.split(", ")])


def op12(spark, sf_dir: str) -> DataFrame:
    return clustered(vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL of the same rows: one pair of steps a round."""
    nearest = "SELECT DISTINCT ON (r) r, c AS cluster, d FROM (SELECT x.r, c.c, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x, {0} c) ORDER BY r, d, c"
    parts = [
        f"""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM x) QUALIFY c < {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(f'c{r}')})")
        parts.append(
            f"""m{r} AS MATERIALIZED (SELECT cluster, i, sum(s) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(x.v) AS s, unnest(range({dimensions})) AS i FROM x JOIN a{r} a USING (r)) GROUP BY ALL),
            c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT cluster AS c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY cluster) m USING (c))"""
        )
    parts.append(f"f AS MATERIALIZED ({nearest.format(f'c{rounds}')})")
    return f"""WITH {', '.join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN x USING (r) JOIN c{rounds} c ON c.c = f.cluster"""
