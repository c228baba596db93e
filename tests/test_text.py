"""Unit cases of the text functions, models and guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import models, sampling
from quillspark.operators.joins import fail_on_null, many_to_one


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_names(spark):
    p = lambda t: [x.w for x in one(spark, t, tx.proper_flags(F.col("t")).alias("p")).p if x.proper]
    assert p("Yesterday Minister Okafor met the Senate in Lagos. Okafor smiled. The senate rose.") == ["Minister", "Okafor", "Senate", "Lagos", "Okafor"]
    assert p("We saw Mary O'Brien and McKay there; McKay left. MARY SHOUTED at FIFA, O'Brien too.") == ["Mary", "O'Brien", "McKay", "McKay", "MARY", "O'Brien"]
    assert p("* Bullet one. (Paris is far) \"Rain fell\" they said") == ["Rain"]
    assert p("A cat and I") == [] and p("") == []


def test_clean(spark):
    clean = lambda t: one(spark, t, tx.cleaned(F.col("t")))[0]
    assert clean("Storm hits coast\n  Two   ferries stopped,\n<twitter>\n\nall safe!") == "Storm hits coast. Two ferries stopped, all safe!"
    assert clean("&#8220;Fish &amp; chips&#8221; aren&#8217;t cheap") == "“Fish & chips” aren't cheap."
    assert clean("one\rtwo\r\nthree <URL> four") == "one. two. three four." and clean(None) == "" and clean(" \n ") == ""
    assert one(spark, "a <url> selfrefs <selfref> b", tx.masked(F.col("t")))[0] == 2


@pytest.mark.parametrize(
    "title,hit",
    [
        ("Voters in three Okafors strongholds stay home", True),
        ("quotNo recountquot says Okaforaposs deputy", True),
        ("Mayor aposWe winapos and Iaposm not sorry", True),
        ("The mayonnaise quotation nobody wanted", False),
        ("Surveys of taxidermy and votership", False),
        ("", False),
        (None, False),
    ],
)
def test_headlines(spark, title, hit):
    pattern = tx.term_pattern(["okafor", "mayor", "tax", "vote", "i'm not"], frozenset({"okafor"}))
    assert one(spark, title, tx.repaired(F.col("t")).rlike(pattern))[0] is hit


def test_pattern_round_trip():
    terms = ["u.s.", "white house", "trump", "a|b", "g-7"]
    assert sorted(tx.pattern_terms(tx.term_pattern(terms))) == sorted(terms)


def test_repair(spark):
    assert one(spark, "Winnipegaposs &quot;No&#8230;&quot; Iaposm endquot &amp;amp;", tx.repaired(F.col("t")))[0] == "winnipeg's \"no...\" i'm end\" &amp;"


def test_mtld_and_grades(spark):
    assert tx.mtld_of([]) is None and tx.mtld_of(["a", "b", "c"]) is None
    assert tx.mtld_of(["a"] * 10) == pytest.approx(2.0)
    assert one(spark, "beautiful", tx.syllables(F.col("t")))[0] == 3
    assert one(spark, "One. Two! Three?", tx.sentences(F.col("t")))[0] == 3


def test_allocation(spark):
    counts = spark.createDataFrame([("a", y, n) for y, n in ((1, 7), (2, 7), (3, 7), (4, 100))] + [("b", 1, 3)], "g string, y int, n long")
    rows = sampling.allocation(counts, "g", "y", 20).collect()
    for g, total in (("a", 20), ("b", 3)):
        own = [r for r in rows if r.g == g]
        whole = sum(r.n for r in own)
        assert sum(r.alloc for r in own) == total and all(abs(r.alloc - total * r.n / whole) < 1 for r in own)


def test_grouped_folds():
    rng = np.random.default_rng(0)
    counts = [(f"g{i}", c, int(rng.integers(1, 30))) for i in range(20) for c in (0, 1)]
    fold = sampling.grouped_folds(counts, 4)
    size = [sum(n for g, _, n in counts if fold[g] == f) for f in range(4)]
    assert set(fold.values()) == {0, 1, 2, 3} and max(size) < 1.5 * min(size)


def test_guards(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeat"):
        many_to_one(left, right, "k")
    assert many_to_one(left, right.limit(1), "k").count() == 2
    with pytest.raises(ValueError, match="unmapped"):
        fail_on_null(right.withColumn("c", F.lit(None).cast("int")), "c", "v")


def test_variances():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=60) * 2, rng.normal(size=40)
    cells = []
    for i in range(60):
        for j in range(40):
            y = 5 + a[i] + b[j] + rng.normal(size=3) * 0.5
            cells.append((f"{i:02}", f"{j:02}", 3.0, y.sum(), (y * y).sum()))
    va, vb, ve = models.fit_variances(cells)
    assert va == pytest.approx(a.var(ddof=1), rel=0.05) and vb == pytest.approx(b.var(ddof=1), rel=0.05) and ve == pytest.approx(0.25, rel=0.05)


def test_ordinal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    y = np.digitize(x @ np.array([1.5, -0.7]) + rng.logistic(size=3000), [-1, 0.5, 2])
    b, cuts, se = models.fit_ordinal(y, x)
    assert np.allclose(b, [1.5, -0.7], atol=0.15) and np.allclose(cuts, [-1, 0.5, 2], atol=0.2) and (se < 0.1).all()


def test_streaming(spark, small, tmp_path):
    from quillspark.streaming import events as ev

    batch = spark.read.parquet(f"{small}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    ev.run_to_end(ev.windowed(ev.read_events(spark, str(tmp_path / "in"), batch.schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ev.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert got.count() > 0 and got.exceptAll(want).count() == 0


def test_two_way_effects_equal_least_squares(spark):
    rng = np.random.default_rng(4)
    n = 600
    g, a, b = rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 3, n)
    y = 0.5 * g + a - 2 * b + rng.normal(size=n)
    df = spark.createDataFrame([(f"g{i}", f"a{j}", f"b{k}", float(v)) for i, j, k, v in zip(g, a, b, y)], "g string, a string, b string, y double")
    x = np.column_stack([np.ones(n), *[(a == j) for j in range(1, 4)], *[(b == j) for j in range(1, 3)]]).astype(float)
    rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r.g: r for r in models.two_way_effects(df, "y", "g", "a", "b").collect()}
    for i in range(6):
        assert got[f"g{i}"].residual == pytest.approx(rest[g == i].mean(), abs=2e-6) and got[f"g{i}"].raw == pytest.approx(y[g == i].mean(), abs=2e-6)
    assert got["g0"].r2 == pytest.approx(1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum(), abs=2e-6) and 0.2 < got["g0"].icc < 0.6
    assert models.two_way_effects(df.limit(0), "y", "g", "a", "b").count() == 0


def test_mixed_model_with_covariates(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=40), rng.normal(size=30) * 0.5
    rows = []
    for i in range(40):
        for j in range(30):
            x = rng.normal() + a[i]
            rows.append((f"a{i:02}", f"b{j:02}", float(x), float(1 + 2 * x + a[i] + b[j] + rng.normal() * 0.5)))
    df = spark.createDataFrame(rows, "a string, b string, x double, y double")
    got = {r.part: r for r in models.mixed_model(df, "y", ["x"], "a", "b").collect()}
    assert got["x"].value == pytest.approx(2, abs=0.05) and 0 < got["x"].se < 0.05
    assert got["variance of a"].value == pytest.approx(a.var(ddof=1), rel=0.15) and got["variance of residual"].value == pytest.approx(0.25, rel=0.1)
    assert got["variance of residual"].absorbed > 0.9


def test_proportional_odds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=1500)
    y = np.digitize(1.2 * x + rng.logistic(size=1500), [-1, 0.5, 2])
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(y, x)], "y int, x double")
    rows = models.proportional_odds(df, "y", "x").collect()
    assert len(rows) == 3 and all(abs(r.coef - 1.2) < 0.25 and r.se < 0.2 for r in rows) and rows[0].spread < 0.4
    r = models.ordinal_logit(df, "y", ["x"]).first()
    assert r.lo < r.odds_ratio < r.hi and r.p < 0.001 and 0.05 < r.pseudo_r2 < 0.4
