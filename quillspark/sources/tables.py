"""Table access: Parquet by folder, views, delimited text, schema inspection and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEXICON_SCHEMA = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("valence", T.DoubleType()), T.StructField("arousal", T.DoubleType()), T.StructField("dominance", T.DoubleType())]
)

#: Rows at most of a small table that is broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns are pruned by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet below spark.checkpoint.dir and read again: for what several parts of a plan read.

    A local session without that setting (as in tests) gets a folder of its own; a cluster must have a shared one.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for a broadcast if it has few enough rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def removed(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def attach(spark: SparkSession, folder: str, names: list[str], prefix: str = "") -> None:
    """Registers tables as temporary views, as an attached read-only catalogue."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(prefix + n)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated lexicon: no quoting, and no text stands for a missing value."""
    return spark.read.csv(path, sep="\t", header=True, schema=LEXICON_SCHEMA, quote="", nullValue="\u0000", mode="FAILFAST")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema=schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet in global key order: one range shuffle, then sorted runs."""
    df.sort(*keys).write.mode("overwrite").parquet(path)


def write_csv_fixed(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with a fixed number of decimals for floating-point columns."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def describe_schema(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Schema as rows: table, position, column, type."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def discover_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files under a folder, recursively, with their sizes; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fails early if columns are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, a function that makes its paths)."""
    context = spark.sparkContext
    make = context._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(context._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a versioned table, oldest first."""
    system, make = _files(spark, path)
    if not system.exists(make(path)):
        return []
    names = [s.getPath().getName() for s in system.listStatus(make(path))]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n.removeprefix("version=").isdigit())


def write_version(df: DataFrame, path: str, report: list[str] = ()) -> int:
    """Writes the rows as the next version and returns its number; earlier ones stay, the first run included.

    Rows and report lines are written to a folder of their own, which gets the version's name in the end: readers see a version
    whole or not at all, and a failed write leaves the last one as it was.
    """
    spark = df.sparkSession
    system, make = _files(spark, path)
    draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{draft}/rows")
        spark.createDataFrame([(i, line) for i, line in enumerate(report)], "k int, line string").coalesce(1).sort("k").write.parquet(f"{draft}/report")
        number = (versions(spark, path) or [0])[-1] + 1
        while not system.rename(make(draft), make(f"{path.rstrip('/')}/version={number}")):  # another writer was first
            if number not in versions(spark, path):
                raise OSError(f"cannot name version {number} of {path}")
            number += 1
        return number
    except BaseException:
        system.delete(make(draft), True)
        raise


def read_version(spark: SparkSession, path: str, number: int | None = None, part: str = "rows") -> DataFrame:
    """Rows, or report lines, of a version: the last whole one, or the one asked for."""
    number = number or (versions(spark, path) or [0])[-1]
    if not number:
        raise FileNotFoundError(f"no whole version in {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/version={number}/{part}")


def profile_files(spark: SparkSession, folder: str, pattern: str = "*", sep: str = "\t") -> DataFrame:
    """(path, length, lines, terms of several words, longest line) of text files under a folder; a first field is a term.
    Files without a byte are not listed."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    several = F.split_part("value", F.lit(sep), F.lit(1)).rlike(r"\S\s+\S")
    found = lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(several).alias("several"), F.max(F.length("value")).alias("longest"))
    files = discover_files(spark, folder, pattern)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.select(plain(F.col("path")).alias("path"), "length").join(found.withColumn("path", plain(F.col("path"))), "path", "left").fillna(0, ["lines", "several"])
