"""Boosting, grouped evaluation, mixed and ordinal models against plain versions on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import boosting as bo
from quillspark.operators import evaluation as ev
from quillspark.operators import logistic as lg
from quillspark.operators import mixed as mx
from quillspark.operators import models as md
from quillspark.operators import ordinal as od

FEATURES = ["a", "b", "c"]


def made_rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=n) * 0.5, [0.0, 1.0])
    rows = [(i, f"g{i % 23}", int(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, x))]
    rows[3] = (*rows[3][:4], None, *rows[3][5:])
    return rows


SCHEMA = "id long, g string, y int, a double, b double, c double"


def plain_boosting(x, y, train, valid, edges, s, classes):
    """One model, node by node: no passes ahead, no sums by task. Probabilities of all rows and validation losses."""
    bins = np.column_stack([[0 if v is None else 1 + int(np.sum(e < v)) for v in col] for col, e in zip(zip(*x), edges)])
    counts = np.bincount(y[train], minlength=classes)
    w = [len(train) / (sum(counts > 0) * c) if c else 0.0 for c in counts]
    share = np.array([a * b for a, b in zip(w, counts)])
    with np.errstate(divide="ignore"):
        score = np.tile(np.log(share / share.sum()), (len(y), 1))
    unit, losses, rounds = 2.0**24, [], 0
    soft = lambda: np.exp(score - score.max(1, keepdims=True)) / np.exp(score - score.max(1, keepdims=True)).sum(1, keepdims=True)
    while True:
        p = soft()
        if len(valid):
            ww = np.array([w[k] for k in y[valid]])
            losses.append(np.rint(unit * -np.log(p[valid, y[valid]]) * ww).sum() / np.rint(unit * ww).sum())
        late = s.patience is not None and len(losses) > s.patience and min(losses[-s.patience :]) >= min(losses[: -s.patience]) - 1e-7
        if rounds >= s.rounds or late:
            return p, losses, rounds
        change = np.zeros_like(score)
        for k in range(classes):
            if not w[k]:
                continue
            g = {i: float(np.rint(unit * w[y[i]] * (p[i, k] - (y[i] == k)))) / unit for i in train}
            h = {i: float(np.rint(unit * w[y[i]] * p[i, k] * (1 - p[i, k]))) / unit for i in train}

            def best(rows):
                sums = lambda r: (sum(g[i] for i in r), sum(h[i] for i in r), len(r))
                part = lambda t: t[0] ** 2 / (t[1] + s.penalty)
                found = None
                for f in range(bins.shape[1]):
                    for cut in range(int(bins[:, f].max())):
                        a, b = [i for i in rows if bins[i, f] <= cut], [i for i in rows if bins[i, f] > cut]
                        if min(len(a), len(b)) < s.least:
                            continue
                        gain = part(sums(a)) + part(sums(b)) - part(sums(rows))
                        if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                            found = (gain, f, cut)
                return found

            leaves = [(list(train), list(range(len(y))))]
            splits = [best(leaves[0][0])]
            while len(leaves) < s.leaves and any(splits):
                at = max(range(len(leaves)), key=lambda i: splits[i][0] if splits[i] else -1)
                _, f, cut = splits[at]
                (own, every), _ = leaves.pop(at), splits.pop(at)
                for side in (True, False):
                    part = ([i for i in own if (bins[i, f] <= cut) == side], [i for i in every if (bins[i, f] <= cut) == side])
                    leaves.append(part)
                    splits.append(best(part[0]))
            for own, every in leaves:
                change[every, k] = -sum(g[i] for i in own) / (sum(h[i] for i in own) + s.penalty) * s.rate
        score += change
        rounds += 1


@pytest.fixture(scope="module")
def small_rows(spark):
    df = spark.createDataFrame(made_rows(), SCHEMA)
    return df, ev.Rows(df, "id", "g", "y", FEATURES, 3)


def test_boosting_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(bo, "EDGES", 7)
    monkeypatch.setattr(bo, "WRITE", 2)
    rows = made_rows(160)
    df = spark.createDataFrame(rows, SCHEMA)
    edges = bo.edges_of(df, FEATURES, 7)
    table = bo.binned(df.repartition(5), "id", "g", "y", FEATURES, edges)
    held, valid = {"g1", "g2"}, {"g3", "g4", "g5"}
    parts = [({f"g{i}" for i in range(23)} - held - valid, valid, held), ({f"g{i}" for i in range(23)} - held, set(), held)]
    roles = ev._roles(parts)
    settings = [bo.Setting(0.3, 5, 12, 2, 8, 1.0), bo.Setting(0.2, 3, 4, None, 15, 2.0)]
    models = bo.fitted(table, roles, 3, settings, 3, 9)
    got = {(r.model, r.id): r.p for r in bo.predicted(table, models, roles).collect()}
    y = np.array([r[2] for r in rows])
    for j, (s, (a, b, c)) in enumerate(zip(settings, parts)):
        own = lambda names: np.array([i for i, r in enumerate(rows) if r[1] in names], int)
        p, losses, rounds = plain_boosting([r[3:] for r in rows], y, own(a), own(b), edges, s, 3)
        assert len(models[j].rounds) == rounds
        assert np.allclose(models[j].losses, losses, atol=1e-7)
        assert {i for m, i in got if m == j} == set(own(c).tolist())
        for i in own(c):
            assert np.allclose(got[j, i], p[i], atol=1e-7)
    assert models[0].rounds and len(models[0].losses) > 2


def test_boosting_does_not_depend_on_partitions_and_lacks_no_class(spark):
    df = spark.createDataFrame([r if r[2] < 2 or r[1] == "g0" else (*r[:2], 0, *r[3:]) for r in made_rows(120)], SCHEMA)
    edges = bo.edges_of(df, FEATURES)
    roles = ev._roles([({f"g{i}" for i in range(1, 23)}, set(), {"g0"})])  # class 2 is in the held-out group only
    found = []
    for n in (1, 6):
        table = bo.binned(df.repartition(n), "id", "g", "y", FEATURES, edges)
        fit = bo.fitted(table, roles, 3, [bo.Setting(rounds=3, patience=None, least=5)], 3, 66)
        found.append(sorted((r.id, tuple(r.p)) for r in bo.predicted(table, fit, roles).collect()))
    assert found[0] == found[1] and found[0] and all(p[2] == 0 and abs(sum(p) - 1) < 1e-12 for _, p in found[0])


def test_metrics_by_hand():
    c = np.array([[[3, 1, 0], [0, 2, 0], [1, 0, 0]], [[4, 0, 0], [0, 4, 0], [0, 0, 0]]])
    m = ev.metrics(c)
    truth, pred = [0] * 4 + [1] * 2 + [2], [0, 0, 0, 1, 1, 1, 0]
    seen = sum((a - b) ** 2 for a, b in zip(truth, pred)) / 7
    chance = sum((a - b) ** 2 for a in truth for b in pred) / 49
    assert m["qwk"][0] == pytest.approx(1 - seen / chance) and m["qwk"][1] == 1
    assert m["accuracy"].tolist() == pytest.approx([5 / 7, 1])
    assert m["macro_f1"].tolist() == pytest.approx([(6 / 8 + 4 / 5 + 0) / 3, 1])


def test_nested_search_cuts_no_group_and_chooses_as_a_loop_would(small_rows):
    _, rows = small_rows
    grid = [bo.Setting(0.3, n, 4, 2, 10) for n in (2, 6)]
    calls, fit = [], rows.fit
    rows.fit = lambda roles, settings: (calls.append(roles), fit(roles, settings))[1]
    choices, predictions = ev.nested_search(rows, grid, outer=3, inner=2, together=5)
    rows.fit = fit
    assert len(calls) == 3 + 2  # 12 models in blocks of 5, the early stops and the refits
    seen = predictions.collect()
    assert len({r.id for r in seen}) == len(seen) == 400
    outer = {}
    for r in seen:
        assert outer.setdefault(r.g, r.fold) == r.fold
    for c in choices:
        left = {g for g, f in outer.items() if f != c["fold"]}
        inner, scores = ev.grouped_folds(rows.of(left), 2), []
        for s in grid:
            one = []
            for i in range(2):
                held = {g for g, f in inner.items() if f == i}
                valid = rows.split(left - held)
                assert not held & valid
                roles = ev._roles([(left - held - valid, valid, held)])
                one.append(float(ev.metrics(ev.counts_of(bo.predicted(rows.table, rows.fit(roles, [s]), roles), "model", 3)[0])["qwk"]))
            scores.append(np.mean(one))
        assert c["setting"] == grid[int(np.argmax(scores))] and c["inner_qwk"] == pytest.approx(max(scores))
    found = ev.tally(choices, grid)
    assert sum(n for name, _, n, _ in found if name == "leaves") == 3
    assert [n for name, v, n, edge in found if name == "rate"] == [3] and all(edge for name, _, _, edge in found if name == "leaves")


def test_importance_of_planted_and_useless_features(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"g{i % 20}", int(a > 0), float(a), float(b), 1.0) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))]
    table = ev.Rows(spark.createDataFrame(rows, SCHEMA), "id", "g", "y", FEATURES, 2)
    names = {f"g{i}" for i in range(20)}
    folds = [{f"g{i}" for i in range(f, 20, 2)} for f in range(2)]
    roles = ev._roles([(names - f, set(), f) for f in folds])
    models = table.fit(roles, [bo.Setting(0.3, 3, 5, None, 10)] * 2)
    got = {r.feature: r.drop for r in ev.importance(table, models, roles, {"a": [0], "b": [1], "c": [2], "GROUP": [1, 2]}).collect()}
    assert got["a"] > 0.5 and got["c"] == 0 and abs(got["b"]) < 0.1 and abs(got["GROUP"]) < 0.1


def test_ranks_in_ranges(spark):
    df = spark.createDataFrame([(i % 2, (i * 7) % 50, i) for i in range(200)], "f int, o int, i int")
    got = ev.ranked_in(df.repartition(7), "f", ["o", "i"], "k").collect()
    for f in (0, 1):
        assert [(r.o, r.i) for r in sorted((r for r in got if r.f == f), key=lambda r: r.k)] == sorted((r.o, r.i) for r in got if r.f == f)
        assert sorted(r.k for r in got if r.f == f) == list(range(1, 101))


def test_out_of_bag_votes(spark):
    df = spark.createDataFrame(made_rows(300), SCHEMA)
    votes = {r.id: r for r in ev.out_of_bag(df, "id", "y", FEATURES, 3, trees=6).collect()}
    bags = df.select("id", F.array(*[ev.bag(F.col("id"), t) for t in range(6)]).alias("b")).collect()
    assert len(votes) == 299  # one row has a null feature
    for r in bags:
        if r.id in votes:
            assert votes[r.id].votes == sum(b == 0 for b in r.b)
            assert (votes[r.id].p is None) == (votes[r.id].votes == 0)
            assert votes[r.id].p is None or sum(votes[r.id].p) == pytest.approx(1)
    share = np.mean([b == 0 for r in bags for b in r.b])
    assert abs(share - math.exp(-1)) < 0.05 and abs(np.mean([b for r in bags for b in r.b]) - 1) < 0.1
    right = [max(range(3), key=lambda k: v.p[k]) == v.y for v in votes.values() if v.p]
    assert np.mean(right) > 0.6


def test_placed_probabilities(spark):
    row = spark.range(1).select(ev.placed(F.array(F.lit(0.25), F.lit(0.75)), [0, 3], 5).alias("p")).first()
    assert row.p == [0.25, 0, 0, 0.75, 0]


def test_fold_features_come_from_training_rows_only(spark):
    train = spark.createDataFrame([("red blue blue", 1.0), ("red green", 3.0), ("red blue", None)], "t string, x double")
    z = [r.x for r in train.select(*ev.scaled(train, ["x"])).collect()]
    assert z == [-1.0, 1.0, 0.0]
    weigh = ev.word_weights(train, 100, 2)
    own = weigh(spark.createDataFrame([("blue blue red unseen", 9.0)], "t string, x double")).first().words
    # two words in two documents and more; idf = ln((n + 1) / (df + 1))
    blue, red = (1 + math.log(2)) * math.log(4 / 3), math.log(4 / 4)
    size = math.hypot(blue, red)
    assert own.size == 2 and sorted(own.toArray().tolist()) == pytest.approx(sorted([blue / size, red / size]))


@pytest.mark.parametrize("sums", [32, 2])
def test_models_of_a_fold_equal_single_models_in_shared_passes(spark, monkeypatch, sums):
    """The coefficients are those of Spark's own model, one a class and set of features, from a few passes for all."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng, names = np.random.default_rng(6), ["ab", "cd", "ef", "gh", "ij", "kl"]
    rows = [(i % 3, f"g{i}", int(rng.integers(0, 3)), " ".join(rng.choice(names, rng.integers(0, 9))), float(rng.normal())) for i in range(150)]
    df = spark.createDataFrame(rows, "fold int, g string, y int, t string, x double").repartition(5)
    words, weights = lg.vocabulary(df, 3, 100, 2)
    assert words.to_pylist() == names
    train = [r for r in rows if r[0] != 1]
    held = sum("cd" in r[3].split() for r in train)
    assert weights[1, 1] == pytest.approx(math.log((len(train) + 1) / (held + 1)))
    monkeypatch.setattr(lg, "SUMS", sums)
    passes, summed = [], lg._summed
    monkeypatch.setattr(lg, "_summed", lambda *a: passes.append(1) or summed(*a))
    table = lg.blocks(df.select("fold", "g", "y", "t", "x", F.col("x").alias("a"), F.col("x").alias("b")), ["x", "a", "b"], words, weights)
    size = {k: sum(r[2] == k for r in train) for k in range(3)}
    models = [(kind, k) for kind in ("words", "both", "dense") for k in range(3)]
    got = lg.fitted(table, 1, 3, weights, 1, models, size, tolerance=1e-10)
    assert len(passes) < 60
    n, data = len(train), []
    for _, _, y, t, x in train:
        c = np.array([t.split().count(w) for w in names])
        v = np.where(c > 0, (1 + np.log(np.maximum(c, 1))) * weights[1], 0)
        data.append((y, [*(v / (np.linalg.norm(v) or 1)).tolist(), x]))
    for j, (kind, k) in enumerate(models):
        on = {"words": slice(0, 6), "both": slice(0, 7), "dense": slice(6, 7)}[kind]
        one = spark.createDataFrame([(float(y == k), n / (2 * (size[k] if y == k else n - size[k])), v[on]) for y, v in data], "label double, w double, v array<double>").coalesce(1)
        fit = LogisticRegression(featuresCol="x", weightCol="w", regParam=1 / n, standardization=False, tol=1e-12, maxIter=500).fit(one.withColumn("x", array_to_vector("v")))
        want = np.zeros(8)
        want[:7][on], want[7] = fit.coefficients.toArray(), fit.intercept
        assert np.abs(got[:, j] - want).max() < 2e-3


def test_text_in_folds_finds_words(spark):
    rng = np.random.default_rng(4)
    words = [["alpha", "álpha beta"], ["gamma", "delta"], ["eta", "theta"]]
    rows = [(f"g{i % 12}", int(k), " ".join(rng.choice(words[k] + ["noise", "more"], 8)), float(rng.normal())) for i, k in enumerate(rng.integers(0, 3, 240))]
    got = ev.text_in_folds(spark.createDataFrame(rows, "g string, y int, t0 string, x double"), "t0", "y", "g", ["x"], 3, folds=2, least=2).collect()
    right = lambda kind: sum(r.n for r in got if r.features == kind and r.y == r.c) / 240
    assert all(sum(r.n for r in got if r.features == k) == 240 for k in ("words", "dense", "both"))
    assert right("words") > 0.95 and right("both") > 0.95 and right("dense") < 0.6


def dense(y, x, za, ga, zb, vb, residual, reml, w=None):
    """Minus twice the Gaussian log-likelihood, by the whole covariance matrix."""
    v = za @ ga @ za.T + vb * zb @ zb.T + residual * np.diag(1 / (np.ones(len(y)) if w is None else w))
    inverse = np.linalg.inv(v)
    xx = x.T @ inverse @ x
    beta = np.linalg.solve(xx, x.T @ inverse @ y)
    e = y - x @ beta
    out = np.linalg.slogdet(v)[1] + e @ inverse @ e + (len(y) - (x.shape[1] if reml else 0)) * math.log(2 * math.pi)
    return out + (np.linalg.slogdet(xx)[1] if reml else 0), beta, np.sqrt(np.diag(np.linalg.inv(xx)))


def mixed_rows(n=240, groups=15, seed=2, slope=0.6):
    rng = np.random.default_rng(seed)
    a, b, x = rng.integers(0, groups, n), rng.integers(0, 5, n), rng.normal(size=n)
    ua, us, ub = rng.normal(size=groups) * 0.7, rng.normal(size=groups) * slope, rng.normal(size=5) * 0.5
    y = 1 + 0.5 * x + ua[a] + us[a] * x + ub[b] + rng.normal(size=n) * 0.8
    return [(f"a{i:02}", f"b{j}", float(u), float(v), float(w)) for i, j, u, v, w in zip(a, b, x, y, rng.uniform(0.5, 2, n))]


@pytest.mark.parametrize("slope,weight", [(None, None), ("x", None), ("x", "w")])
@pytest.mark.parametrize("reml", [True, False])
def test_mixed_model_equals_dense_likelihood(spark, slope, weight, reml):
    rows = mixed_rows()
    df = spark.createDataFrame(rows + [("a00", "b0", None, 1.0, 1.0), (None, "b0", 1.0, 1.0, 1.0)], "a string, b string, x double, y double, w double").repartition(3)
    cells = mx.cells_of(df, {"m": mx.Spec("y", {"x": "x"}, weight=weight, slope=slope)}, "a", "b")["m"]
    fit = mx.Likelihood(cells, 1 if slope else None).fit(reml)
    assert fit.converged and fit.n == len(rows)
    y, x = np.array([r[3] for r in rows]), np.array([[1, r[2]] for r in rows])
    names = sorted({r[0] for r in rows})
    za = np.zeros((len(rows), len(names) * (2 if slope else 1)))
    for i, r in enumerate(rows):
        at = names.index(r[0]) * (2 if slope else 1)
        za[i, at : at + (2 if slope else 1)] = [1, r[2]][: 2 if slope else 1]
    zb = np.array([[float(r[1] == f"b{j}") for j in range(5)] for r in rows])
    w = np.array([r[4] for r in rows]) if weight else None
    value = lambda cov, vb, res: dense(y, x, za, np.kron(np.eye(len(names)), cov), zb, vb, res, reml, w)
    least, beta, se = value(fit.covariance, fit.variance, fit.residual)
    assert fit.deviance == pytest.approx(least, abs=1e-5) and np.allclose(fit.beta, beta, atol=1e-6) and np.allclose(fit.se, se, rtol=1e-5)
    for k in (0.93, 1.07):  # nowhere near is better
        for cov, vb, res in ((fit.covariance * k, fit.variance, fit.residual), (fit.covariance, fit.variance * k, fit.residual), (fit.covariance, fit.variance, fit.residual * k)):
            assert value(cov, vb, res)[0] > least


def test_mixed_model_recovers_and_reports_singular_fits(spark):
    schema = "a string, b string, x double, y double, w double"
    big = spark.createDataFrame(mixed_rows(6000, 60, 5), schema)
    fit = mx.Likelihood(mx.cells_of(big, {"m": mx.Spec("y", {"x": "x"}, slope="x")}, "a", "b")["m"], 1).fit()
    assert abs(fit.covariance[0, 0] - 0.49) < 0.25 and abs(fit.covariance[1, 1] - 0.36) < 0.2 and abs(fit.residual - 0.64) < 0.05 and not fit.singular
    flat = spark.createDataFrame([(r[0], r[1], r[2], 1 + r[2] + (i % 7) / 7, 1.0) for i, r in enumerate(mixed_rows(700, 7, 6))], schema)
    assert mx.Likelihood(mx.cells_of(flat, {"m": mx.Spec("y", {"x": "x"}, slope="x")}, "a", "b")["m"], 1).fit().singular
    got = {r.spec: r for r in mx.compared(big, {"null": mx.Spec("y"), "x": mx.Spec("y", {"x": "x"}), "slope": mx.Spec("y", {"x": "x"}, slope="x"), "few": mx.Spec("y", only="x > 0")}, "a", "b").collect()}
    assert [got[k].parameters for k in ("null", "x", "slope", "few")] == [4, 5, 7, 4]
    assert got["slope"].df == 2 and got["slope"].chi_squared == pytest.approx(got["x"].deviance - got["slope"].deviance, abs=1e-3) and got["slope"].p < 1e-6
    assert got["few"].p is None and got["null"].chi_squared is None


def test_chi_squared_tail():
    assert mx.tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert mx.tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert mx.tail(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-12) and mx.tail(0, 3) == 1


def test_bootstrap_of_mixed_model_equals_serial_loop(spark):
    rows = mixed_rows(150, 10, 8)
    df = spark.createDataFrame(rows, "a string, b string, x double, y double, w double")
    got = {r.term: r for r in mx.bootstrap(df, mx.Spec("y", {"x": "x"}), "a", "b", draws=12, parts=3).collect()}
    names, each = sorted({r[0] for r in rows}), []
    for k in range(12):
        drawn = [(f"{i}-{names[g]}", *r[1:]) for i, g in enumerate(mx.drawn(1000 + k, 10)) for r in rows if r[0] == names[g]]
        cells = mx.cells_of(spark.createDataFrame(drawn, df.schema), {"m": mx.Spec("y", {"x": "x"})}, "a", "b")["m"]
        each.append(mx.Likelihood(cells).fit(reml=False).beta[1])
    assert got["x"].converged == got["x"].draws == 12
    assert (got["x"].mean, got["x"].lo, got["x"].hi) == pytest.approx((np.mean(each), *np.percentile(each, [2.5, 97.5])), abs=2e-5)


def test_influence_equals_refits(spark):
    rows = mixed_rows(120, 6, 9)
    df = spark.createDataFrame(rows, "a string, b string, x double, y double, w double")
    spec = mx.Spec("y", {"x": "x"})
    got = {(r.kind, r.left_out): r for r in mx.influence(df, spec, "a", "b", 2).where("term = 'x'").collect()}
    assert set(got) == {("a", n) for n in {r[0] for r in rows}} | {("b", f"b{j}") for j in range(5)}
    whole = mx.Likelihood(mx.cells_of(df, {"m": spec}, "a", "b")["m"]).fit(False).beta[1]
    for kind, name in (("a", "a03"), ("b", "b2")):
        left = mx.cells_of(df.where(f"{kind} <> '{name}'"), {"m": spec}, "a", "b")["m"]
        assert got[kind, name].estimate == pytest.approx(mx.Likelihood(left).fit(False).beta[1], abs=1e-5)
        assert got[kind, name].shift == pytest.approx(got[kind, name].estimate - whole, abs=2e-6)


def test_ordinal_parts_are_derivatives():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(60, 2)), rng.integers(0, 4, 60), rng.integers(1, 4, 60).astype(float)
    t = np.array([0.3, -0.2, -1.0, 0.2, 1.1])
    ll, g, h = od.parts(t, x, y, w, 4)
    near = lambda i, e: od.parts(t + e * np.eye(5)[i], x, y, w, 4)
    assert ll == pytest.approx(-sum(k * md.ordinal_loss(np.array([v]), np.array([e]), t[2:]) for k, v, e in zip(w, y, x @ t[:2])))
    for i in range(5):
        assert g[i] == pytest.approx((near(i, 1e-5)[0] - near(i, -1e-5)[0]) / 2e-5, abs=1e-4)
        assert np.allclose(h[i], (near(i, 1e-5)[1] - near(i, -1e-5)[1]) / 2e-5, atol=1e-4)


def test_ordinal_bootstrap_equals_serial_loop(spark):
    rows = [(f"g{i % 9}", r[2], r[3], r[5]) for i, r in enumerate(made_rows(180, 7))]
    df = spark.createDataFrame(rows, "g string, y int, a double, c double").repartition(4)
    got = od.bootstrap(df, "g", "y", ["a", "c"], 3, draws=8, seed=5).collect()
    x = np.array([r[2:] for r in rows])
    x, y = (x - x.mean(0)) / x.std(0), np.array([r[1] for r in rows])
    assert [r.coef for r in got] == pytest.approx(md.fit_ordinal(y, x)[0].tolist(), abs=1e-4)
    each = []
    for pick in np.random.default_rng(5).integers(0, 9, (8, 9)):
        on = np.concatenate([np.flatnonzero([r[0] == f"g{i}" for r in rows]) for i in pick])
        each.append(md.fit_ordinal(y[on], x[on])[0])
    ends = np.exp(np.percentile(each, [2.5, 97.5], axis=0))
    assert [(r.lo, r.hi) for r in got] == [pytest.approx(tuple(e), rel=1e-3) for e in ends.T] and got[0].converged == got[0].draws == 8


@pytest.mark.parametrize("t", [-30.0, 0.01, 0.5, 1.0, 2.0, 12.7, 1000.0])
def test_student_tail_equals_closed_forms(t):
    from quillspark.functions.stats import student_tail

    assert student_tail(t, 1) == pytest.approx(2 / math.pi * math.atan(1 / abs(t)), rel=1e-9)
    assert student_tail(t, 2) == pytest.approx(2 / (2 + t * t + abs(t) * math.sqrt(2 + t * t)), rel=1e-9)


def test_student_tail_and_rank_correlation(spark, tmp_path):
    from quillspark.functions.stats import student_tail

    for t, df, p in ((12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05), (1.9839715184496334, 100, 0.05), (0.0, 7, 1.0), (-2.570581835636314, 5, 0.05)):
        assert student_tail(t, df) == pytest.approx(p, abs=1e-12)
    df = spark.createDataFrame([(0, i // 3, 2) for i in range(30)], "f int, o int, m int").distinct()
    got = ev.ranked_in(df.repartition(4), "f", ["o"], "k", "m").collect()
    assert {r.o: r.k for r in got} == {i: 2 * (i + 1) for i in range(10)}


def test_mixed_model_leaves_out_what_cannot_be_estimated(spark):
    df = spark.createDataFrame(mixed_rows(120, 8, 11), "a string, b string, x double, y double, w double")
    fit = lambda terms: mx.Likelihood(mx.cells_of(df, {"m": mx.Spec("y", terms)}, "a", "b")["m"]).fit()
    got, plain = fit({"none": "CAST(x > 99 AS DOUBLE)", "x": "x", "twice": "2 * x + 1"}), fit({"x": "x"})
    assert np.isnan(got.beta[[1, 3]]).all() and np.allclose(got.beta[[0, 2]], plain.beta) and got.parameters == plain.parameters
    assert mx.models(df, {"nothing": mx.Spec("y", only="x > 99")}, "a", "b").count() == 0
