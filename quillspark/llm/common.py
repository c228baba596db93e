"""What the training-data operators share: the shared folder, written tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent.parent)


#: Most bytes of a batch that goes to Python: buffers on both sides grow with it, also outside the JVM's heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Lets a Python worker, which outlives its tasks, give large freed blocks back to the system.
ALLOCATION = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4000000", "MALLOC_TRIM_THRESHOLD_": "16000000", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Lets Python workers of this session import the package (on a cluster it is also installed or shipped).

    Arrow batches of this session are kept to BATCH_BYTES, unless the session has set a size of its own.
    """
    if spark.conf.get(BATCH) == "67108864b":  # Spark's default
        spark.conf.set(BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    for k, v in ALLOCATION.items():
        env.setdefault(k, v)
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([ROOT, *parts])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a folder of our own only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def released(*tables: DataFrame) -> None:
    """Removes written tables from the shared folder; nothing may read them any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._shared_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def given_back() -> None:
    """Gives a Python worker's free memory back to the system; the worker goes on to other operators' tasks."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_HELD: dict = {}


def held(name, make):
    """What a Python worker keeps from task to task: one thing at a time, as the worker goes on to other operators' tasks."""
    if name not in _HELD:
        let_go()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Drops what the worker keeps of an operator whose tasks are over."""
    if _HELD:
        _HELD.clear()
        given_back()


def row_of(columns: list[str]):
    """The columns as one struct, whatever their names hold; names that occur twice are ambiguous and an error."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in columns]).alias("row")


def text_of(column: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def labelled_sample(texts: DataFrame, known: DataFrame, per_class: int, longest: int) -> list:
    """Rows (i, y, t) of at most per_class labelled rows of each class 0 and 1, with texts of at most so many bytes.

    texts: (i, t); known: (i, y), i once. Ids are picked first, by a hash, so that only the picked texts are sent: at most
    2 * per_class * longest bytes.
    """
    fit = texts.where(F.octet_length("t") <= longest)
    ids = fit.select("i").distinct().join(known, "i")
    picked = [r for y in (0, 1) for r in ids.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class).collect()]
    if not picked:
        return []
    columns = [[r.i for r in picked], pa.array([r.y for r in picked], pa.int32())]
    chosen = texts.sparkSession.createDataFrame(pa.table(columns, ["i", "y"])).select(F.col("i").cast(dict(ids.dtypes)["i"]).alias("i"), "y")
    return sorted(fit.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect(), key=lambda r: (r.y, r.i))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end at group borders, from batches sorted by the keys. A group that spans batches is put together."""
    import numpy as np

    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(max(0, b.num_rows - 1), bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = np.flatnonzero(change)
        if rest and any(rest[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*rest, b.slice(0, last)])
            rest = [b.slice(last)]
        else:
            rest.append(b)
    if rest:
        yield pa.Table.from_batches(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node that it reaches.

    edges: (a long, b long), either order, repeats allowed, a = b ignored. Alternating large-star and small-star
    rounds over tables; each round is written to the shared folder, nothing is collected but two sums a round.
    The rounds grow with the logarithm of the longest path. An empty edge table gives no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        old, now = now, written(small.where("u <> v").distinct(), "edges")
        released(old)
        if (is_ := state(now)) == was:
            break
        was = is_
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
