"""Sources and sinks: written, read again and compared."""

import pytest
from pyspark.sql import types as T

from quillspark.functions import text as tx
from quillspark.functions.stats import mean_rank
from quillspark.sources import tables


def test_views_and_profiles(spark, small):
    tables.attach(spark, small, ["nation", "region"], "t_")
    assert spark.sql("SELECT count(*) AS n FROM t_nation JOIN t_region ON n_regionkey = r_regionkey").first().n == 25
    rows = tables.describe_schema(spark, spark.table("t_region"), "region").collect()
    assert [(r.position, r.column_name) for r in rows][0] == (0, "r_regionkey")
    files = tables.discover_files(spark, small, "re*.parquet").collect()
    assert len(files) == 1 and files[0].length > 0
    with pytest.raises(ValueError, match="missing columns: b, c"):
        tables.require_columns(spark.range(1), "id", "b", "c")


def test_texts(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text('term\tvalence\tarousal\tdominance\nnan\t0.1\t0.2\t0.3\n"quoted\t1\t2\t3\nnull\t0\t0\t0\n')
    got = tables.read_lexicon(spark, str(tmp_path / "lex.tsv")).collect()
    assert [r.term for r in got] == ["nan", '"quoted', "null"] and got[0].dominance == 0.3
    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;\n")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    assert [tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "a.csv"), schema, ";").collect()] == [(1, "x"), (2, None)]
    assert tables.read_lines(spark, str(tmp_path / "a.csv")).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, 1 / 3), (1, 2.0), (2, None)], "k int, x double")
    tables.write_sorted(df.repartition(3), str(tmp_path / "sorted"), "k")
    files = sorted((tmp_path / "sorted").glob("part-*"))
    assert [r.k for f in files for r in spark.read.parquet(str(f)).collect()] == [1, 2, 3]
    tables.write_csv_fixed(df, str(tmp_path / "csv"), 3)
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} >= {("3", "0.333"), ("1", "2.000")}
    again = tables.stored(df, "rows")
    assert again.schema == df.schema and sorted(r.k for r in again.collect()) == [1, 2, 3]


def test_small_expressions(spark):
    df = spark.createDataFrame([("The Post!", 1), ("AB-c 9", 2), ("x", 2), ("y", 5)], "s string, v int")
    got = df.select(tx.letters_key(df.s).alias("k"), mean_rank(df.v).alias("r"), mean_rank(df.v, down=True).alias("d")).collect()
    assert sorted((r.k, r.r, r.d) for r in got) == [("abc", 2.5, 2.5), ("thepost", 1.0, 4.0), ("x", 2.5, 2.5), ("y", 4.0, 1.0)]
