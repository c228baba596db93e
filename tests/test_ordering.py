"""Places in a whole order against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest

from quillspark.operators.ordering import ahead, correlations, value_ranks


@pytest.fixture
def many_ranges(spark):
    """Without merged ranges, so that places cross borders; a third of the rows hold one value."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(n: int) -> list[tuple]:
    r = random.Random(4)
    return [(i, 7 if i % 3 == 0 else r.randrange(40), r.choice([None, 0.5, 2.0, -1.0]), r.randrange(5)) for i in range(n)]


def test_places_cross_ranges(many_ranges):
    from pyspark.sql import functions as F

    rows = rows_of(500)
    df = many_ranges.createDataFrame(rows, "id long, v long, w double, z long").repartition(5)
    got = {r.id: (r.k, r.s) for r in ahead(ahead(df, ["v", "id"], "k"), ["v", "id"], "s", F.col("w")).collect()}
    total = 0.0
    for place, (i, _, w, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0]))):
        assert got[i] == (place, total)
        total += w or 0.0


def test_nulls_come_first_and_empty_tables_stay_empty(many_ranges):
    df = many_ranges.createDataFrame([(3,), (None,), (1,)], "v long")
    assert sorted((r.k, r.v) for r in ahead(df, ["v"], "k").collect()) == [(0, None), (1, 1), (2, 3)]
    assert ahead(df.limit(0), ["v"], "k").collect() == []
    assert correlations(df.limit(0).selectExpr("v", "v AS w"), "v", "w").first().asDict() == {"n": 0, "pearson": None, "spearman": None}


def test_ranks_of_values(many_ranges):
    rows = rows_of(500)
    df = many_ranges.createDataFrame(rows, "id long, v long, w double, z long")
    got = dict(value_ranks(df.groupBy("v").count(), "v", "count").collect())
    want = pd.Series([r[1] for r in rows]).rank()
    assert all(got[r[1]] == x for r, x in zip(rows, want))


def test_correlations(many_ranges):
    rows = rows_of(400)
    df = many_ranges.createDataFrame(rows, "id long, v long, w double, z long")
    got = correlations(df, "v", "w").first()
    p = pd.DataFrame(rows, columns=["id", "v", "w", "z"]).dropna(subset=["w"])
    assert got.n == len(p)
    assert np.isclose(got.pearson, np.corrcoef(p.v, p.w)[0, 1])
    assert np.isclose(got.spearman, np.corrcoef(p.v.rank(), p.w.rank())[0, 1])
    flat = correlations(df.selectExpr("v", "1 AS one"), "v", "one").first()
    assert (flat.n, flat.pearson, flat.spearman) == (400, None, None)
