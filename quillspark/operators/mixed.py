"""Mixed models with crossed groups and random slopes, from sums by cell.

y = x beta + (intercept and, if asked for, a slope) of a row's group a + (intercept) of its group b + error. Spark sums the
products of the columns by specification and cell of groups, all specifications in one pass; what comes to the driver is a
row a cell, whatever the number of rows. The likelihood is profiled over the relative covariance factor of the groups'
effects, so that variances of zero are inside the range, and group a, however many there are, is eliminated group by group.

Refits of bootstrap draws and leave-one-out samples need nothing but the cells again: they are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import erfc, exp, lgamma, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """A model: y, the fixed terms beside the constant by name, a condition on rows, a weight, and the term with a random
    slope in group a. All are SQL expressions on the rows; rows with a null in any of them are left out."""

    y: str
    terms: dict[str, str] = field(default_factory=dict)
    only: str | None = None
    weight: str | None = None
    slope: str | None = None


@dataclass
class Cells:
    """Sums of products of (1, terms, y) by cell of groups a and b, weighted; n rows, log_weights their logarithms' sum."""

    a: np.ndarray
    b: np.ndarray
    sums: np.ndarray
    rows: np.ndarray
    log_weights: float
    names_a: list
    names_b: list

    def without(self, kind: str, index: int) -> Cells:
        keep = (self.a if kind == "a" else self.b) != index
        return Cells(self.a[keep], self.b[keep], self.sums[keep], self.rows[keep], self.log_weights, self.names_a, self.names_b)


def cells_of(df: DataFrame, specs: dict[str, Spec], a: str, b: str) -> dict[str, Cells]:
    """The cells of every specification. Rows are read once: each goes into the sums of all specifications that it fits."""
    width = max(len(s.terms) for s in specs.values()) + 2
    one = []
    for name, s in specs.items():
        cols = [F.lit(1.0), *[F.expr(e).cast("double") for e in s.terms.values()], F.expr(s.y).cast("double")]
        w = F.expr(s.weight).cast("double") if s.weight else F.lit(1.0)
        fit = F.expr(s.only) if s.only else F.lit(True)
        for c in [*cols, w]:
            fit = fit & c.isNotNull()
        one.append(F.when(fit, F.struct(F.lit(name).alias("spec"), w.alias("w"), F.array(*cols, *[F.lit(0.0)] * (width - len(cols))).alias("x"))))
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.explode(F.array(*one)).alias("s")).where("s IS NOT NULL")
    x = lambda i: F.element_at("s.x", i + 1)
    pairs = [(i, j) for i in range(width) for j in range(i + 1)]
    found = rows.groupBy("s.spec", "a", "b").agg(F.count("*").alias("n"), F.sum(F.ln("s.w")).alias("lw"), *[F.sum(F.col("s.w") * x(i) * x(j)).alias(f"p{i}_{j}") for i, j in pairs])
    by: dict = {name: [] for name in specs}
    for r in found.orderBy("spec", "a", "b").collect():  # as many as cells
        by[r.spec].append(r)
    out = {}
    for name, s in specs.items():
        p, own = len(s.terms) + 2, by[name]
        names = [sorted({r[c] for r in own}) for c in ("a", "b")]
        at = [{v: i for i, v in enumerate(n)} for n in names]
        sums = np.zeros((len(own), p, p))
        for k, r in enumerate(own):
            for i in range(p):
                for j in range(i + 1):
                    sums[k, i, j] = sums[k, j, i] = r[f"p{i}_{j}"]
        out[name] = Cells(np.array([at[0][r.a] for r in own], int), np.array([at[1][r.b] for r in own], int), sums, np.array([r.n for r in own], float), float(sum(r.lw for r in own)), *names)
    return out


class Likelihood:
    """The profiled deviance of a model over its cells; draws: which groups of a are in, repeats as groups of their own."""

    def __init__(self, cells: Cells, slope: int | None = None, draws: np.ndarray | None = None) -> None:
        za = [0] if slope is None else [0, slope]
        self.r, self.p, count = len(za), cells.sums.shape[1] - 1, len(cells.names_a)
        times = np.ones(count) if draws is None else np.bincount(draws, minlength=count).astype(float)
        there = np.unique(cells.a)
        draws = there if draws is None else draws[np.isin(draws, there)]
        levels, at = np.unique(cells.b[times[cells.a] > 0], return_inverse=True)
        use = times[cells.a] > 0
        a, sums, w = cells.a[use], cells.sums[use], times[cells.a[use]]
        q = self.q = len(levels)
        inner = np.zeros((count, self.r, self.r))
        np.add.at(inner, a, sums[:, za][:, :, za])
        outer = np.zeros((count, self.r, q + self.p + 1))
        np.add.at(outer, (a, slice(None), at), sums[:, za, 0])
        np.add.at(outer[:, :, q:], a, sums[:, za])
        self.inner, self.outer = inner[draws], outer[draws]
        h = self.whole = np.zeros((q + self.p + 1,) * 2)
        h[np.arange(q), np.arange(q)] = np.bincount(at, w * sums[:, 0, 0], q)
        rest = np.zeros((q, self.p + 1))
        np.add.at(rest, at, w[:, None] * sums[:, 0])
        h[:q, q:], h[q:, :q] = rest, rest.T
        h[q:, q:] = (w[:, None, None] * sums).sum(0)
        self._estimable()
        self.n, self.log_weights = float((times[cells.a] * cells.rows).sum()), cells.log_weights
        self.size = 2 if self.r == 1 else 4

    def _estimable(self) -> None:
        """Leaves out fixed effects that those before them determine, as a year that no row has; their estimates are nan."""
        q, keep = self.q, []
        xx = self.whole[q:, q:]
        for j in range(self.p):
            known = xx[np.ix_(keep, keep)]
            left = xx[j, j] - (xx[j, keep] @ np.linalg.solve(known, xx[keep, j]) if keep else 0.0)
            if left > 1e-8 * max(xx[j, j], 1e-300):
                keep.append(j)
        self.keep, self.all = np.array(keep, int), self.p
        on = np.concatenate([np.arange(q), q + self.keep, [q + self.p]])
        self.outer, self.whole, self.p = self.outer[:, :, on], self.whole[np.ix_(on, on)], len(keep)

    def factor(self, t: np.ndarray) -> np.ndarray:
        return np.array([[abs(t[0])]]) if self.r == 1 else np.array([[abs(t[0]), 0.0], [t[1], abs(t[2])]])

    def solved(self, t: np.ndarray, reml: bool) -> tuple[float, np.ndarray, float, np.ndarray]:
        """(deviance, fixed effects, residual variance, inverse of their information before that variance)."""
        f, q, p = self.factor(t), self.q, self.p
        d = f.T @ self.inner @ f + np.eye(self.r)
        scale = np.concatenate([np.full(q, abs(t[-1])), np.ones(p + 1)])
        e = (f.T @ self.outer) * scale
        s = self.whole * scale[:, None] * scale
        s[np.arange(q), np.arange(q)] += 1
        s -= np.einsum("irj,irk->jk", e, np.linalg.solve(d, e))
        rest = s[q:, q:] - s[q:, :q] @ np.linalg.solve(s[:q, :q], s[:q, q:])
        xx, xy, yy = rest[:p, :p], rest[:p, p], rest[p, p]
        beta = np.linalg.solve(xx, xy)
        left, over = max(yy - xy @ beta, 1e-300), self.n - p if reml else self.n
        logs = np.linalg.slogdet(d)[1].sum() + np.linalg.slogdet(s[:q, :q])[1] + (np.linalg.slogdet(xx)[1] if reml else 0.0)
        return logs + over * (1 + log(2 * pi * left / over)) - self.log_weights, beta, left / over, np.linalg.inv(xx)

    def fit(self, reml: bool = True) -> Fit:
        start = np.array([1.0, 1.0] if self.r == 1 else [1.0, 0.0, 1.0, 1.0])
        t, done = minimised(lambda x: self.solved(x, reml)[0], start)
        deviance, beta, sigma, inverse = self.solved(t, reml)
        f, effects = self.factor(t), np.full((2, self.all), np.nan)
        effects[:, self.keep] = beta, np.sqrt(np.maximum(sigma * np.diag(inverse), 0))
        return Fit(effects[0], effects[1], sigma * f @ f.T, sigma * t[-1] ** 2, sigma, deviance, self.n, self.p + self.size + 1, done, bool(min(*np.diag(f), abs(t[-1])) < 1e-4))


@dataclass
class Fit:
    beta: np.ndarray
    se: np.ndarray
    covariance: np.ndarray  # of group a's intercepts and slopes
    variance: float  # of group b's intercepts
    residual: float
    deviance: float
    n: float
    parameters: int
    converged: bool
    singular: bool


def minimised(f, start: np.ndarray, most: int = 2000) -> tuple[np.ndarray, bool]:
    """The lowest point found by a simplex that reflects, stretches and shrinks, started twice; whether it settled."""
    best = start
    for _ in range(2):
        points = [best] + [best + (0.4 if best[i] < 0.4 else -0.3) * np.eye(len(best))[i] for i in range(len(best))]
        values, settled = [f(x) for x in points], False
        for _ in range(most):
            order = np.argsort(values, kind="stable")
            points, values = [points[i] for i in order], [values[i] for i in order]
            if values[-1] - values[0] < 1e-9 and max(np.abs(x - points[0]).max() for x in points) < 1e-6:
                settled = True
                break
            mean = np.mean(points[:-1], 0)
            away = 2 * mean - points[-1]
            v = f(away)
            if v < values[0]:
                further = 3 * mean - 2 * points[-1]
                u = f(further)
                points[-1], values[-1] = (further, u) if u < v else (away, v)
            elif v < values[-2]:
                points[-1], values[-1] = away, v
            else:
                near = (mean + (away if v < values[-1] else points[-1])) / 2
                u = f(near)
                if u < min(v, values[-1]):
                    points[-1], values[-1] = near, u
                else:
                    points = [points[0]] + [(points[0] + x) / 2 for x in points[1:]]
                    values = [values[0]] + [f(x) for x in points[1:]]
        best = points[int(np.argmin(values))]
    return best, settled


def tail(x: float, df: int) -> float:
    """Probability that a chi-squared number with df degrees of freedom exceeds x."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = exp(a * log(z) - z - lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _slope(s: Spec) -> int | None:
    return None if s.slope is None else 1 + list(s.terms).index(s.slope)


def _p(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def _r(x: float, digits: int = 6) -> float | None:
    return round(float(x), digits) if np.isfinite(x) else None


def models(df: DataFrame, specs: dict[str, Spec], a: str, b: str) -> DataFrame:
    """(spec, n, groups_a, groups_b, part, value, se, p, share, singular, converged): restricted fits of all specifications.
    p is by the normal distribution; share is a variance's part of all variances, where covariances have none."""
    out = []
    for name, c in cells_of(df, specs, a, b).items():
        s = specs[name]
        if not len(c.rows):
            continue
        m = Likelihood(c, _slope(s)).fit()
        head = (name, int(m.n), len(c.names_a), len(c.names_b))
        out += [(*head, t, _r(v), _r(e), _r(_p(v / e)) if e > 0 else None, None, m.singular, m.converged) for t, v, e in zip(["constant", *s.terms], m.beta, m.se)]
        parts = [(f"variance of {a}", m.covariance[0, 0])] + ([(f"variance of {a}: {s.slope}", m.covariance[1, 1])] if s.slope else []) + [(f"variance of {b}", m.variance), ("variance of residual", m.residual)]
        total = sum(v for _, v in parts)
        out += [(*head, t, _r(v), None, None, _r(v / total), m.singular, m.converged) for t, v in parts]
        if s.slope:
            out.append((*head, f"covariance of {a} and {s.slope}", _r(m.covariance[0, 1]), None, None, None, m.singular, m.converged))
    return df.sparkSession.createDataFrame(out, "spec string, n long, groups_a int, groups_b int, part string, value double, se double, p double, share double, singular boolean, converged boolean")


def compared(df: DataFrame, specs: dict[str, Spec], a: str, b: str) -> DataFrame:
    """(spec, parameters, aic, bic, log_likelihood, deviance, chi_squared, df, p): fits by maximum likelihood, each against the
    one before it. Models are comparable only over the same rows; p is null where they are not or nothing is added."""
    out, last = [], None
    for name, c in cells_of(df, specs, a, b).items():
        if not len(c.rows):
            continue
        m = Likelihood(c, _slope(specs[name])).fit(reml=False)
        chi, more, p = None, None, None
        if last is not None and last.n == m.n and m.parameters > last.parameters:
            chi, more = max(0.0, last.deviance - m.deviance), m.parameters - last.parameters
            p = tail(chi, more)
        out.append((name, m.parameters, _r(m.deviance + 2 * m.parameters, 4), _r(m.deviance + log(m.n) * m.parameters, 4), _r(-m.deviance / 2, 4), _r(m.deviance, 4), None if chi is None else _r(chi, 4), more, None if p is None else _r(p)))
        last = m
    return df.sparkSession.createDataFrame(out, "spec string, parameters int, aic double, bic double, log_likelihood double, deviance double, chi_squared double, df int, p double")


def drawn(seed: int, groups: int) -> np.ndarray:
    """Groups drawn with replacement, as many as there are."""
    return np.random.default_rng(seed).integers(0, groups, groups)


def refitted(spark, cells: Cells, slope: int | None, tasks: DataFrame) -> DataFrame:
    """(kind, k, beta array, converged): maximum-likelihood refits of tasks (kind, k): draw number k of kind `draw`, or all but
    group k of kind `a` or `b`. The cells are sent to each executor once."""
    shared = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for kind, k in zip(*(x.to_pylist() for x in batch.columns)):
                try:
                    own, draws = (c, drawn(1000 + k, len(c.names_a))) if kind == "draw" else (c.without(kind, k), None)
                    m = Likelihood(own, slope, draws).fit(reml=False)
                    beta, ok = m.beta.tolist(), bool(m.converged and np.isfinite(m.beta).all())
                except np.linalg.LinAlgError:
                    beta, ok = None, False
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([k], pa.int32()), pa.array([beta], pa.list_(pa.float64())), pa.array([ok])], ["kind", "k", "beta", "converged"])

    return tasks.mapInArrow(run, "kind string, k int, beta array<double>, converged boolean")


def bootstrap(df: DataFrame, spec: Spec, a: str, b: str, draws: int = 500, parts: int = 32) -> DataFrame:
    """(term, estimate, mean, lo, hi, below_0, converged, draws): fixed effects over draws of groups of a. A group drawn twice
    is two groups. Draws that do not converge are counted and left out."""
    spark = df.sparkSession
    cells = cells_of(df, {"all": spec}, a, b)["all"]
    whole = Likelihood(cells, _slope(spec)).fit(reml=False).beta.tolist()
    fits = refitted(spark, cells, _slope(spec), spark.range(0, draws, 1, parts).select(F.lit("draw").alias("kind"), F.col("id").cast("int").alias("k")))
    names = F.array(*[F.lit(t) for t in ["constant", *spec.terms]])
    each = fits.select("converged", F.posexplode(F.when(F.col("converged"), F.col("beta")).otherwise(F.array_repeat(F.lit(None).cast("double"), len(whole)))).alias("i", "x"))
    p = lambda q: F.round(F.percentile("x", F.lit(q)), 6)
    found = each.groupBy("i").agg(F.round(F.avg("x"), 6).alias("mean"), p(0.025).alias("lo"), p(0.975).alias("hi"), F.round(F.avg((F.col("x") < 0).cast("int")), 6).alias("below_0"), F.sum(F.col("converged").cast("int")).alias("converged"), F.count("*").alias("draws"))
    return found.select(F.element_at(names, F.col("i") + 1).alias("term"), F.round(F.element_at(F.array(*[F.lit(x) for x in whole]), F.col("i") + 1), 6).alias("estimate"), "mean", "lo", "hi", "below_0", "converged", "draws")


def influence(df: DataFrame, spec: Spec, a: str, b: str, parts: int = 32) -> DataFrame:
    """(kind, left_out, term, estimate, shift): refits without one group of a, then of b, at a time; shift is the change."""
    spark = df.sparkSession
    cells = cells_of(df, {"all": spec}, a, b)["all"]
    whole = Likelihood(cells, _slope(spec)).fit(reml=False).beta.tolist()
    names = spark.createDataFrame([("a", i, a, str(v)) for i, v in enumerate(cells.names_a)] + [("b", i, b, str(v)) for i, v in enumerate(cells.names_b)], "kind string, k int, group string, left_out string")
    fits = refitted(spark, cells, _slope(spec), names.select("kind", "k").repartition(parts)).where("converged")
    terms = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x).alias("x")) for t, x in zip(["constant", *spec.terms], whole)])
    rows = fits.join(names, ["kind", "k"]).select("group", "left_out", F.posexplode("beta").alias("i", "v")).withColumn("w", F.element_at(terms, F.col("i") + 1))
    return rows.select(F.col("group").alias("kind"), "left_out", F.col("w.t").alias("term"), F.round("v", 6).alias("estimate"), F.round(F.col("v") - F.col("w.x"), 6).alias("shift"))
