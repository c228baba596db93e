"""Cluster measures against plain definitions."""

import numpy as np
import pytest

from quillspark.operators import clusters as cl
from quillspark.operators.sampling import greedy_sheet


def test_quality_equals_plain_definitions(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1.0, (20 + 5 * c, 3)) for c in range(4)])
    y = np.repeat(np.arange(4), [20, 25, 30, 35])
    df = spark.createDataFrame([(int(c), [float(v) for v in r]) for r, c in zip(x, y)], "label int, v array<double>")
    r = cl.quality(df, "v", "label").first()
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    sil = []
    for i in range(len(x)):
        a = d2[i, (y == y[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d2[i, y == c].mean() for c in range(4) if c != y[i])
        sil.append((b - a) / max(a, b))
    mean = np.array([x[y == c].mean(0) for c in range(4)])
    within = sum(((x[y == c] - mean[c]) ** 2).sum() for c in range(4))
    between = sum((y == c).sum() * ((mean[c] - x.mean(0)) ** 2).sum() for c in range(4))
    s = [np.sqrt(((x[y == c] - mean[c]) ** 2).sum(1)).mean() for c in range(4)]
    db = np.mean([max((s[a] + s[b]) / np.sqrt(((mean[a] - mean[b]) ** 2).sum()) for b in range(4) if b != a) for a in range(4)])
    assert r.silhouette == pytest.approx(np.mean(sil), abs=2e-6) and r.calinski_harabasz == pytest.approx(between / 3 / (within / (len(x) - 4)), rel=1e-6)
    assert r.davies_bouldin == pytest.approx(db, abs=2e-6) and r.max_share == pytest.approx(35 / 110, abs=1e-6)
    assert cl.quality(df.limit(0), "v", "label").first().n == 0


def test_mutual_information():
    assert cl.adjusted_mutual_information([[10, 0], [0, 7]]) == pytest.approx(1)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 4, 60)

    def information(u, v):
        t = np.array([[((u == i) & (v == j)).sum() for j in range(4)] for i in range(3)])
        p = t / t.sum()
        e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        return t, (p[p > 0] * np.log(p[p > 0] / e[p > 0])).sum()

    t, seen = information(a, b)
    chance = np.mean([information(a, rng.permutation(b))[1] for _ in range(3000)])
    h = lambda x: -sum(q * np.log(q) for q in x / x.sum() if q)
    want = (seen - chance) / ((h(t.sum(1)) + h(t.sum(0))) / 2 - chance)
    assert cl.adjusted_mutual_information(t.tolist()) == pytest.approx(want, abs=0.01)


def test_greedy_sheet():
    rows = [(c, o, i) for i, (c, o) in enumerate([("a", "x"), ("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), ("b", "z")])]
    assert greedy_sheet(rows, 3, 2) == [("a", "x", 0), ("a", "x", 1), ("a", "y", 4), ("b", "z", 5), ("b", "x", 3)]
