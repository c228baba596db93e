"""Exact top-k search by inner product, without random access (NRA).

Vectors lie in blocks. A block keeps a list for each dimension, sorted by the component; a query reads each list from
the end that its own component's sign favours. After each depth the entries read bound every vector's score from below
and above: unread components lie between the list's frontier and its far end. Vectors whose upper bound is below the
k-th best lower bound can't qualify; a query stops when few enough are left, and only for those the rest of the entries is
read. The next depth follows from what the last one left: a query that still has most vectors open after a quarter of the
lists reads them to the end, where the bounds are the scores. All queries of a batch go through a depth together, as
matrix products.

Every block has the queries stream past it in batches, so a task holds one block and one batch; neither side is
broadcast. Each vector is sent once, each query once a block.

Scores are whole numbers. Where no sum can reach 2^53 they are computed as doubles, which are then exact, and otherwise as
64-bit integers; where a component or a sum could leave 64 bits the search fails with an error rather than give a wrong score.

Defined results: vectors that are null, empty or hold null or non-finite components, or that have no id, take no part;
vectors that are shorter than others count as having zeros; of equal scores the smaller id wins; a query's own id is left
out (with all rows that repeat it); candidates that repeat an id are candidates each; queries that repeat an id and its
vector count once, and with different vectors they are queries each; fewer candidates than k give fewer rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Shares of the lists that are read at most before all of them, and how many vectors a query may leave open to stop.
DEPTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2)
FEW = 64
BLOCK = 4096


def number_kind(x: np.ndarray, queries: np.ndarray) -> type:
    """Doubles where no sum of products can reach 2^53, 64-bit integers where none can reach 2^63; else an error."""
    most = lambda a: max(int(a.max(initial=0)), -int(a.min(initial=0)))
    bound = 2 * x.shape[1] * most(x) * most(queries)  # twice, as bounds add two such sums
    if bound < 1 << 53:
        return np.float64
    if bound < 1 << 63:
        return np.int64
    raise OverflowError("inner products may not fit in 64 bits")


class Lists:
    """A block's vectors, and a sorted list of each dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.ids = x, ids
        order = np.argsort(x, 0, kind="stable")
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], 0)
        self.sorted = np.take_along_axis(x, order, 0)


def search(lists: Lists, queries: np.ndarray, query_ids: np.ndarray, k: int, few: int = FEW, read: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, score) of each query's k best in the block. All values are whole numbers.

    read: if given, gets (query position, entries read of each list, vectors resolved) of each query.
    """
    n = len(lists.x)
    kind = number_kind(lists.x, queries)
    x, ends, ids = lists.x.astype(kind), lists.sorted.astype(kind), lists.ids
    queries = queries.astype(kind)
    least = kind(-np.inf) if kind is np.float64 else np.iinfo(kind).min
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_ = np.arange(len(queries))

    def resolve(q: int, rows: np.ndarray, t: int, scores: np.ndarray | None = None) -> None:
        scores = x[rows] @ queries[q] if scores is None else scores
        best = np.lexsort((ids[rows], -scores))[:k]
        found.append((np.full(len(best), q), rows[best], scores[best]))
        if read is not None:
            read.append((int(q), t, len(rows)))

    for depth in DEPTHS:
        t = min(n, max(1, int(n * depth)))
        high, low = lists.rank >= n - t, lists.rank < t
        upper = up[open_] @ np.where(high, x, ends[n - t]).T + down[open_] @ np.where(low, x, ends[t - 1]).T
        lower = up[open_] @ np.where(high, x, ends[0]).T + down[open_] @ np.where(low, x, ends[n - 1]).T
        own = ids[None, :] == query_ids[open_][:, None]
        lower[own] = least
        reach = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), least)
        can = (upper >= reach[:, None]) & ~own
        left = can.sum(1)
        for i in np.flatnonzero(left <= max(k, few)):
            resolve(open_[i], np.flatnonzero(can[i]), t)
        on = left > max(k, few)
        if depth >= 0.25:  # most vectors are still open: their lists are read to the end
            on &= left <= n // 2
        ended = np.flatnonzero((left > max(k, few)) & ~on)
        _to_the_end(open_[ended], x, queries, query_ids, ids, n, resolve)
        open_ = open_[on]
        if not len(open_):
            break
    _to_the_end(open_, x, queries, query_ids, ids, n, resolve)
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64)
    q, r, s = (np.concatenate(c) for c in zip(*found))
    return q, r, s.astype(np.int64)


def _to_the_end(open_: np.ndarray, x: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, n: int, resolve) -> None:
    """Queries whose lists are all read: the bounds are the scores."""
    for q, scores in zip(open_, queries[open_] @ x.T):
        rows = np.flatnonzero(ids != query_ids[q])
        resolve(q, rows, n, scores[rows])


def _matrix(v: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(v), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(v)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vector_block: int = BLOCK) -> DataFrame:
    """(query_id, rank int, vec_id, score long); both sides are (vec_id long, v array of longs)."""
    prepare(vectors.sparkSession)
    longs = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    vectors, queries = longs(vectors), longs(queries).dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-vectors.count() // vector_block))
    # a query is known by its id and vector
    name = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    left = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("side"), "vec_id", "v", F.lit("").alias("name"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("side"), "vec_id", "v", name.alias("name"))
    rows = left.unionAll(right).repartition(min(blocks, 20_000), "b").sortWithinPartitions("b", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, lists = None, [], None
        for batch in batches:
            b, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(side) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if b[start] != block:
                    block, held, lists = b[start], [], None
                if side[start] == 0:
                    held.append(part)
                    continue
                if lists is None and held:
                    t = pa.Table.from_batches(held)
                    lists, held = Lists(_matrix(t.column("v")), t.column("vec_id").to_numpy()), []
                if lists is None:
                    continue
                q = _matrix(part.column("v"), lists.x.shape[1])
                if q.shape[1] > lists.x.shape[1]:
                    wide = np.zeros((len(lists.x), q.shape[1]), np.int64)
                    wide[:, : lists.x.shape[1]] = lists.x
                    lists = Lists(wide, lists.ids)
                own = part.column("vec_id").to_numpy()
                for i in range(0, len(q), 512):
                    at, row, score = search(lists, q[i : i + 512], own[i : i + 512], k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i + at]), part.column("name").take(pa.array(i + at)), pa.array(lists.ids[row]), pa.array(score)], ["query_id", "name", "vec_id", "score"])

    each = rows.mapInArrow(run, "query_id long, name string, vec_id long, score long")
    order = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components times the scale, rounded down; rows that take no part are left out."""
    v = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return df.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: _floor(x.cast("double") * scale)).alias("v"))


def _floor(x):
    """Rounded down; what a 64-bit integer cannot hold is an error, as a rounded-off value would give wrong scores."""
    return F.when(F.abs(x) < float(1 << 63), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a component may not fit in 64 bits")).cast("long"))


def op10(spark, sf_dir: str) -> DataFrame:
    vectors = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))
