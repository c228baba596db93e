"""Proportional-odds models of all rows, and of many draws of groups at once, by Newton steps from grouped sums.

A pass over the rows gives the log-likelihood, its slope and its curvature for every draw that has not settled, as sums that
are added up in Spark; rows stay where they are. The driver solves one small system a draw. All draws start from the fit of
all rows, so a few passes serve hundreds of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import removed, stored


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def parts(theta: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood, slope and curvature at theta = (slopes, cuts)."""
    d = x.shape[1]
    cuts = np.concatenate([[-np.inf], theta[d:], [np.inf]])
    eta = x @ theta[:d]
    a, b = _logistic(cuts[y + 1] - eta), _logistic(cuts[y] - eta)
    a, b = np.where(y == classes - 1, 1.0, a), np.where(y == 0, 0.0, b)
    p, fa, fb = np.maximum(a - b, 1e-300), a * (1 - a), b * (1 - b)
    ll, g, h = float(w @ np.log(p)), np.zeros(len(theta)), np.zeros((len(theta),) * 2)
    g[:d] = (w * (a + b - 1)) @ x
    h[:d, :d] = (x * (w * -(fa + fb))[:, None]).T @ x
    for k in range(classes - 1):
        up, low = y == k, y == k + 1  # rows whose upper or lower end cut k is
        g[d + k] = (w * fa / p)[up].sum() - (w * fb / p)[low].sum()
        h[d + k, d + k] = (w * (fa * (1 - 2 * a) / p - (fa / p) ** 2))[up].sum() + (w * (-fb * (1 - 2 * b) / p - (fb / p) ** 2))[low].sum()
        h[:d, d + k] = h[d + k, :d] = (w * fa)[up] @ x[up] + (w * fb)[low] @ x[low]
        if k + 1 < classes - 1:
            both = y == k + 1
            h[d + k, d + k + 1] = h[d + k + 1, d + k] = (w * fa * fb / p**2)[both].sum()
    return ll, g, h


class Climb:
    """A fit under way: steps are halved where they lose likelihood or cross cuts."""

    def __init__(self, theta: np.ndarray, d: int) -> None:
        self.theta, self.last, self.best, self.d, self.done, self.lost = theta, theta, -np.inf, d, False, False

    def told(self, ll: float, g: np.ndarray, h: np.ndarray) -> None:
        if ll < self.best - 1e-9 * max(1.0, abs(self.best)):
            self.theta = (self.theta + self.last) / 2
            self.lost = np.abs(self.theta - self.last).max() < 1e-10
            return
        self.last, self.best = self.theta, ll
        try:
            move = np.linalg.solve(h - 1e-9 * np.eye(len(g)), -g)
        except np.linalg.LinAlgError:
            self.lost = True
            return
        if np.abs(move).max() < 1e-8:
            self.done = True
            return
        size = min(1.0, 5.0 / np.abs(move).max())
        while (np.diff((self.theta + size * move)[self.d :]) <= 0).any() and size > 1e-6:
            size /= 2
        self.theta = self.theta + size * move
        self.lost = np.abs(self.theta).max() > 1e3  # a class that the draw lacks has no finite cut


def fits(df: DataFrame, group: str, y: str, features: list[str], classes: int, times: dict, passes: int = 60) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """(the fit of all rows, that of each draw or None where it does not settle). times: how often each draw has a group."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [((F.col(c).cast("double") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)).alias(f"x{i}") for i, c in enumerate(features)]
    rows = stored(df.select(F.col(group).alias("g"), F.col(y).cast("int").alias("y"), *z).dropna(), "ordinal")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = np.cumsum([counts.get(k, 0) for k in range(classes)])[:-1] / max(1, sum(counts.values()))
    d, draws = len(features), len(next(iter(times.values()), []))
    start = np.concatenate([np.zeros(d), np.log(share / (1 - share))])

    def climbed(climbs: list[Climb], weighted: bool) -> None:
        for _ in range(passes):
            live = [k for k, c in enumerate(climbs) if not (c.done or c.lost)]
            if not live:
                return
            shared = rows.sparkSession.sparkContext.broadcast(({k: climbs[k].theta for k in live}, times if weighted else None))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                thetas, times = shared.value
                sums = {k: np.zeros(1 + len(t) + len(t) ** 2) for k, t in thetas.items()}
                for b in batches:
                    x = np.column_stack([c.to_numpy() for c in b.columns[2:]])
                    y = b.column(1).to_numpy()
                    w = None if times is None else np.array([times.get(g, np.zeros(draws)) for g in b.column(0).to_pylist()])
                    for k, t in thetas.items():
                        own = np.ones(len(y)) if w is None else w[:, k]
                        on = own > 0
                        if on.any():
                            ll, g, h = parts(t, x[on], y[on], own[on], classes)
                            sums[k] += np.concatenate([[ll], g, h.ravel()])
                if sums:
                    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["k", "s"])

            total = rows.mapInArrow(run, "k int, s array<double>").select("k", F.posexplode("s").alias("i", "s")).groupBy("k", "i").agg(F.sum("s").alias("s")).toArrow()  # a row a draw and number
            q = len(start)
            table = np.zeros((len(climbs), 1 + q + q * q))
            table[total.column("k").to_numpy(), total.column("i").to_numpy()] = total.column("s").to_numpy()
            for k in live:
                climbs[k].told(table[k, 0], table[k, 1 : 1 + q], table[k, 1 + q :].reshape(q, q))

    whole = Climb(start, d)
    climbed([whole], False)
    many = [Climb(whole.theta, d) for _ in range(draws)]
    climbed(many, True)
    removed(rows)
    return whole.theta, [c.theta if c.done else None for c in many]


def bootstrap(df: DataFrame, group: str, y: str, features: list[str], classes: int, draws: int = 500, seed: int = 42) -> DataFrame:
    """(term, coef, odds_ratio, lo, hi, reading, converged, draws): odds ratios per standard deviation with 95 % intervals from
    draws of groups with all their rows. Draws that do not settle, as where a class is missing, are counted and left out."""
    names = sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().collect())  # groups
    picks = np.random.default_rng(seed).integers(0, len(names), (draws, len(names))) if names else np.zeros((draws, 0), int)
    times = {g: (picks == i).sum(1).astype(float) for i, g in enumerate(names)}
    theta, each = fits(df, group, y, features, classes, times)
    good = np.array([t for t in each if t is not None])
    out = []
    for i, f in enumerate(features):
        lo, hi = np.exp(np.percentile(good[:, i], [2.5, 97.5])) if len(good) else (np.nan, np.nan)
        reading = "higher" if lo > 1 else "lower" if hi < 1 else "no clear direction"
        out.append((f, round(float(theta[i]), 6), round(float(np.exp(theta[i])), 6), round(float(lo), 6), round(float(hi), 6), reading, len(good), draws))
    return df.sparkSession.createDataFrame(out, "term string, coef double, odds_ratio double, lo double, hi double, reading string, converged int, draws int")
