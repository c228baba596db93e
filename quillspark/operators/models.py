"""Models: MLlib where it has them; small dense fits on the driver from grouped sums, whose size depends on groups only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import grouped_folds


def best_kmeans(df: DataFrame, id_col: str, vector_col: str, k: int, seeds: tuple[int, ...]) -> DataFrame:
    """(id, cluster) of the seed with the least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")).cache()
    fits = [KMeans(k=k, seed=s, maxIter=20).fit(data) for s in seeds]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select(id_col, F.col("prediction").alias("cluster"))


def forest_by_group(df: DataFrame, features: list[str], label: str, group: str, folds: int = 5) -> DataFrame:
    """(fold, label, prediction, n): a balanced forest, fitted with no group on both sides."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = [(r[0], r[1], r.n) for r in df.groupBy(group, label).agg(F.count("*").alias("n")).collect()]
    spark = df.sparkSession
    fold = spark.createDataFrame(sorted(grouped_folds(counts, folds).items()), f"{group} string, fold int")
    size = {c: sum(n for _, k, n in counts if k == c) for c in {k for _, k, _ in counts}}
    total = sum(size.values())
    weight = F.create_map(*[F.lit(x) for c in sorted(size) for x in (c, total / (len(size) * size[c]))])
    rows = VectorAssembler(inputCols=features, outputCol="x").transform(df.join(F.broadcast(fold), group)).select("x", "fold", F.col(label).cast("double").alias("y"), weight[F.col(label)].alias("w")).cache()
    out = None
    for f in range(folds):
        m = RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="w", numTrees=20, minInstancesPerNode=5, seed=42).fit(rows.where(F.col("fold") != f))
        part = m.transform(rows.where(F.col("fold") == f)).groupBy("fold", "y", "prediction").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionAll(part)
    return out


def tfidf_one_vs_rest(df: DataFrame, text_col: str, label_col: str, size: int = 50_000) -> DataFrame:
    """(label, prediction, n) on a held-out third: sublinear TF-IDF of words, one logistic model a class.

    A count goes in as 1 + ln(count); at most `size` words are kept, the most frequent of those in 5 texts and more.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StringIndexer
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def dampened(v):
        return SparseVector(v.size, v.indices, 1 + np.log(v.values))

    held = F.pmod(F.crc32(F.md5(F.col(text_col)).cast("binary")), F.lit(3)) == 0
    rows = df.select(F.col(text_col).alias("t"), F.col(label_col).alias("l"), held.alias("held"))
    counts = Pipeline(stages=[StringIndexer(inputCol="l", outputCol="label", handleInvalid="skip"), RegexTokenizer(inputCol="t", outputCol="w", pattern=r"[^\p{L}]+"), CountVectorizer(inputCol="w", outputCol="n", minDF=5, vocabSize=size)]).fit(rows.where(~F.col("held")))
    rows = counts.transform(rows).select("l", "label", "held", dampened("n").alias("c"))
    stages = [IDF(inputCol="c", outputCol="i"), Normalizer(inputCol="i", outputCol="features"), OneVsRest(classifier=LogisticRegression(maxIter=20, regParam=0.01))]
    m = Pipeline(stages=stages).fit(rows.where(~F.col("held")))
    return m.transform(rows.where("held")).groupBy(F.col("l").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def two_way_effects(df: DataFrame, y: str, group: str, *factors: str) -> DataFrame:
    """(group, n, raw, residual, r2, icc): means of y by group, before and after the fixed effects of all factors.

    The factors' effects are fitted jointly from sums by cell of group and factors, of which the driver gets one row
    each; r2 is their share of the variance, icc that of groups in what is left.
    """
    names = [f"f{i}" for i in range(len(factors))]
    v = F.col(y)
    cells = df.groupBy(F.col(group).alias("g"), *[F.col(c).alias(k) for c, k in zip(factors, names)]).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).where("n > 0").orderBy("g", *names).collect()
    spark, schema = df.sparkSession, f"{group} string, n long, raw double, residual double, r2 double, icc double"
    if not cells:
        return spark.createDataFrame([], schema)
    levels = [{x: i for i, x in enumerate(sorted({r[k] for r in cells}))} for k in names]
    starts = np.cumsum([1, *[len(x) - 1 for x in levels]])
    m, rhs = np.zeros((starts[-1],) * 2), np.zeros(starts[-1])
    at = [[0, *[int(starts[j]) + levels[j][r[k]] - 1 for j, k in enumerate(names) if levels[j][r[k]]]] for r in cells]  # the first level of each is the constant's
    for r, own in zip(cells, at):
        m[np.ix_(own, own)] += r.n
        rhs[own] += float(r.s)
    beta = np.linalg.lstsq(m, rhs, rcond=None)[0]
    fit = np.array([beta[own].sum() for own in at])
    n, s, q = (np.array([float(r[c]) for r in cells]) for c in ("n", "s", "q"))
    left = (q - 2 * fit * s + n * fit * fit).sum()  # squares of what is left
    total = q.sum() - s.sum() ** 2 / n.sum()
    groups = np.array([r.g for r in cells])
    names_ = sorted(set(groups.tolist()))
    size = np.array([n[groups == g].sum() for g in names_])
    rest = np.array([(s - n * fit)[groups == g].sum() for g in names_])
    k, whole = len(names_), n.sum()
    between, n0 = (rest**2 / size).sum() - rest.sum() ** 2 / whole, (whole - (size**2).sum() / whole) / max(1, k - 1)
    msb, msw = between / max(1, k - 1), (left - (rest**2 / size).sum()) / max(1, whole - k)
    icc = (msb - msw) / (msb + (n0 - 1) * msw) if msb + (n0 - 1) * msw else 0.0
    rows = [(g, int(c), round(float(s[groups == g].sum() / c), 6), round(float(x / c), 6), round(float(1 - left / total), 6) if total else 0.0, round(float(icc), 6)) for g, c, x in zip(names_, size, rest)]
    return spark.createDataFrame(rows, schema)


def fit_ordinal(y: np.ndarray, x: np.ndarray, turns: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slopes, cut points, standard errors) of a proportional-odds model, by damped Newton steps on the log-likelihood."""
    k, d = int(y.max()) + 1, x.shape[1]
    share = np.cumsum(np.bincount(y, minlength=k) + 0.5)[:-1] / (len(y) + k / 2)
    theta = np.concatenate([np.zeros(d), np.log(share / (1 - share))])

    def logistic(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -35, 35)))

    def loss(t: np.ndarray) -> float:
        cuts = np.concatenate([[-np.inf], t[d:], [np.inf]])
        if (np.diff(t[d:]) <= 0).any():
            return np.inf
        eta = x @ t[:d]
        return -np.log(np.maximum(logistic(cuts[y + 1] - eta) - logistic(cuts[y] - eta), 1e-12)).sum() + 1e-6 * (t[:d] ** 2).sum()

    def slope(t: np.ndarray, e: float = 1e-5) -> np.ndarray:
        return np.array([(loss(t + e * u) - loss(t - e * u)) / (2 * e) for u in np.eye(len(t))])

    def curve(t: np.ndarray, e: float = 1e-4) -> np.ndarray:
        h = np.array([(slope(t + e * u) - slope(t - e * u)) / (2 * e) for u in np.eye(len(t))])
        return (h + h.T) / 2

    for _ in range(turns):
        g = slope(theta)
        if np.abs(g).max() < 1e-5:
            break
        move, step = np.linalg.lstsq(curve(theta) + 1e-8 * np.eye(len(theta)), g, rcond=None)[0], 1.0
        while step > 1e-6 and not loss(theta - step * move) < loss(theta):
            step /= 2
        theta = theta - step * move
    return theta[:d], theta[d:], np.sqrt(np.maximum(np.diag(np.linalg.pinv(curve(theta))), 0))[:d]


def _outlet_rows(df: DataFrame, y: str, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of y, z-scores of the features): one row an outlet goes in, so the driver gets as many rows as there are outlets."""
    rows = df.select(y, *features).dropna().orderBy(y, *features).collect()
    codes = {v: i for i, v in enumerate(sorted({r[0] for r in rows}))}
    x = np.array([[float(v) for v in r[1:]] for r in rows])
    return np.array([codes[r[0]] for r in rows]), (x - x.mean(0)) / x.std(0, ddof=1)


def ordinal_loss(y: np.ndarray, eta: np.ndarray, cuts: np.ndarray) -> float:
    """Minus the log-likelihood of a proportional-odds model."""
    ends = np.concatenate([[-np.inf], cuts, [np.inf]])
    p = 1 / (1 + np.exp(-np.clip(ends[y + 1] - eta, -35, 35))) - 1 / (1 + np.exp(-np.clip(ends[y] - eta, -35, 35)))
    return float(-np.log(np.maximum(p, 1e-12)).sum())


def ordinal_logit(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """(term, coef, se, z, p, odds_ratio, lo, hi, pseudo_r2): lo and hi are the ends of the odds ratio's 95 % interval."""
    from math import erfc

    codes, x = _outlet_rows(df, y, features)
    b, cuts, se = fit_ordinal(codes, x)
    share = np.bincount(codes) / len(codes)
    r2 = 1 - ordinal_loss(codes, x @ b, cuts) / -float(np.log(share[codes]).sum())
    rows = []
    for f, c, s in zip(features, b.tolist(), se.tolist()):
        z = c / s if s else 0.0
        ends = [float(np.exp(np.clip(c + k * 1.959964 * s, -50, 50))) for k in (-1, 1)]
        rows.append((f, round(c, 4), round(s, 4), round(z, 4), round(erfc(abs(z) / 2**0.5), 4), round(float(np.exp(c)), 4), round(ends[0], 4), round(ends[1], 4), round(float(r2), 4)))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, z double, p double, odds_ratio double, lo double, hi double, pseudo_r2 double")


def fit_logit(y: np.ndarray, x: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(constant and slopes, their standard errors) of a logistic model, by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return w, np.sqrt(np.diag(np.linalg.inv(h)))


def proportional_odds(df: DataFrame, y: str, feature: str) -> DataFrame:
    """(cut, n_above, coef, se, spread, ordinal): a logistic model for y above each cut; a proportional-odds model has one slope for all."""
    codes, x = _outlet_rows(df, y, [feature])
    slope = float(fit_ordinal(codes, x)[0][0])
    found = []
    for k in range(int(codes.max())):
        w, se = fit_logit((codes > k).astype(float), x)
        found.append((k, int((codes > k).sum()), float(w[1]), float(se[1])))
    spread = max(c for *_, c, _ in found) - min(c for *_, c, _ in found)
    return df.sparkSession.createDataFrame([(k, n, round(c, 4), round(s, 4), round(spread, 4), round(slope, 4)) for k, n, c, s in found], "cut int, n_above long, coef double, se double, spread double, ordinal double")


def fit_variances(cells: list[tuple[str, str, float, float, float]]) -> tuple[float, float, float]:
    """REML variances (a, b, residual) of y = mean + a + b + error with crossed random a and b, from cells (a, b, n, sum, sum of squares)."""
    full = [(ka, kb, np.array([[n]]), np.array([s]), q) for ka, kb, n, s, q in cells]
    return fit_mixed(full)[2]


def fit_mixed(cells: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float]]:
    """(fixed effects, their standard errors, REML variances (a, b, residual)) of y = x beta + a + b + error with crossed
    random a and b. cells: (a, b, X'X, X'y, y'y) summed by cell; the first column of x is the constant.

    The likelihood is that of Henderson's equations, whose size is the number of groups and of fixed effects, maximised
    over two log ratios by a shrinking pattern search.
    """
    a, b = ({v: i for i, v in enumerate(sorted({c[j] for c in cells}))} for j in (0, 1))
    f, p, q = len(cells[0][3]), len(a), len(b)
    m, r, n, ss = np.zeros((f + p + q,) * 2), np.zeros(f + p + q), 0.0, 0.0
    for ka, kb, xx, xy, yy in cells:
        for at in (f + a[ka], f + p + b[kb]):
            m[:f, at] += xx[0]
            m[at, :f] += xx[0]
            r[at] += xy[0]
            for other in (f + a[ka], f + p + b[kb]):
                m[at, other] += xx[0, 0]
        m[:f, :f] += xx
        r[:f] += xy
        n, ss = n + xx[0, 0], ss + yy

    def mixed(t: np.ndarray) -> tuple[float, float, np.ndarray]:
        h = m + np.diag(np.concatenate([np.zeros(f), np.full(p, np.exp(-t[0])), np.full(q, np.exp(-t[1]))]))
        beta = np.linalg.solve(h, r)
        sigma = (ss - r @ beta) / (n - f)
        return (n - f) * np.log(sigma) + np.linalg.slogdet(h)[1] + p * t[0] + q * t[1], sigma, h

    t, step = np.array([-2.0, -2.0]), 2.0
    best = mixed(t)[0]
    while step > 1e-4:
        tries = [t + step * np.array(u) for u in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        scores = [mixed(np.clip(x, -14, 6))[0] for x in tries]
        if min(scores) < best - 1e-9:
            best, t = min(scores), np.clip(tries[int(np.argmin(scores))], -14, 6)
        else:
            step /= 2
    _, sigma, h = mixed(t)
    inverse = np.linalg.inv(h)
    return (inverse @ r)[:f], np.sqrt(sigma * np.diag(inverse)[:f]), (float(np.exp(t[0]) * sigma), float(np.exp(t[1]) * sigma), float(sigma))


def mixed_model(df: DataFrame, y: str, features: list[str], a: str, b: str, specs: dict[str, tuple[list[str], str | None]] | None = None) -> DataFrame:
    """(spec, n, part, value, se, absorbed): fixed effects, and variances with the share that the features absorb of the
    null model's, for each spec: some of the features, and a condition on rows. Products are summed by cell in Spark."""
    out = []
    for name, (own, only) in (specs or {"all": (features, None)}).items():
        rows = df.where(only) if only else df
        null = None
        for terms in ([], own):
            cols = [F.lit(1.0), *[F.col(c).cast("double") for c in terms]]
            sums = [F.sum(x * z).alias(f"x{i}_{j}") for i, x in enumerate(cols) for j, z in enumerate(cols) if i <= j] + [F.sum(x * F.col(y)).alias(f"y{i}") for i, x in enumerate(cols)]
            cells = rows.dropna(subset=[y, a, b, *terms]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(*sums, F.sum(F.col(y) * F.col(y)).alias("q")).orderBy("a", "b").collect()
            k = len(cols)
            found = fit_mixed([(r.a, r.b, np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([r[f"y{i}"] for i in range(k)]), r.q) for r in cells])
            null = null or found[2]
        n = int(sum(r.x0_0 for r in cells))
        out += [(name, n, t, round(float(v), 6), round(float(s), 6), None) for t, v, s in zip(["constant", *own], found[0], found[1])]
        out += [(name, n, f"variance of {part}", round(v, 6), None, round(1 - v / w, 6) if w else None) for part, v, w in zip((a, b, "residual"), found[2], null)]
    return df.sparkSession.createDataFrame(out, "spec string, n long, part string, value double, se double, absorbed double")


def variance_shares(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """(part, variance, share) of the crossed random-effects model, from cell sums."""
    v = F.col(y)
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).orderBy("a", "b").collect()
    found = fit_variances([(r.a, r.b, float(r.n), float(r.s), float(r.q)) for r in cells])
    return df.sparkSession.createDataFrame([(k, round(x, 6), round(x / sum(found), 6)) for k, x in zip((a, b, "residual"), found)], "part string, variance double, share double")
