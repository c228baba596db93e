"""Histogram gradient boosting for several classes, many models at once.

Features become bins by quantile edges. A row has its bins, its class, what it is to each model (nothing, training,
validation, held out) and its scores so far. All models grow together: a pass over the rows gives the sums of gradients,
curvatures and counts by model, class, tree node, feature and bin, which are added up in Spark, so the driver gets one row
a bin however many rows there are. Trees grow best split first; a pass also covers the leaves that may be split next, so a
tree takes about as many passes as it is deep. Every few rounds the scores are written in the shared folder, which cuts the
lineage; between, the trees since then are applied again.

Gradients are rounded to whole 2^-24ths before they are added, so results do not depend on the order of rows or on retries.

A model with validation rows stops when its loss there has not improved for `patience` rounds. Nulls are a bin of their own
below all values. Classes that a model's training rows lack get probability 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import removed, sized, stored

TRAIN, VALIDATE, HELD = 1, 2, 3
#: Part of a unit to which gradients and losses are rounded.
UNIT = float(1 << 24)
#: Rounds after which scores are written.
WRITE = 8
EDGES = 63


@dataclass(frozen=True)
class Setting:
    rate: float = 0.1
    leaves: int = 15
    rounds: int = 60
    patience: int | None = 5
    least: int = 20  # rows of a leaf
    penalty: float = 1.0


@dataclass
class Tree:
    """feature[i] < 0: node i is a leaf. Rows with a bin of at most cut[i] go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> int:
        """Gives a leaf two leaves; the number of the left one, the right one is the next."""
        child = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, child
        for _ in range(2):
            self.feature.append(-1), self.cut.append(0), self.left.append(0), self.value.append(0.0)
        return child

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        f, c, left = (np.array(x) for x in (self.feature, self.cut, self.left))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = f[at] >= 0
            if not inner.any():
                return at
            own = at[inner]
            at[inner] = left[own] + (bins[rows[inner], f[own]] > c[own])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Model:
    setting: Setting
    weights: np.ndarray  # of each class
    base: np.ndarray  # scores before the first round
    rounds: list[list[Tree | None]] = field(default_factory=list)  # a tree a class
    losses: list[float] = field(default_factory=list)  # on validation rows, before each round and after the last
    done: bool = False

    def scores(self, bins: np.ndarray, start: np.ndarray | None = None, since: int = 0) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds[since:]:
            for k, t in enumerate(trees):
                if t is not None:
                    out[:, k] += t.values(bins)
        return out

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        return softmax(self.scores(bins))

    def stops(self) -> bool:
        """Whether the rounds are over: all done, or no better loss for as long as the patience lasts."""
        s = self.setting
        if len(self.rounds) >= s.rounds:
            return True
        return s.patience is not None and len(self.losses) > s.patience and min(self.losses[-s.patience :]) >= min(self.losses[: -s.patience]) - 1e-7


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def started(setting: Setting, counts: np.ndarray) -> Model:
    """A model before its first round: balanced class weights and the scores of the weighted shares."""
    there = counts > 0
    weights = np.where(there, counts.sum() / (there.sum() * np.maximum(counts, 1)), 0.0)
    share = weights * counts / max(1.0, (weights * counts).sum())
    with np.errstate(divide="ignore"):
        return Model(setting, weights, np.log(share))


def edges_of(df: DataFrame, features: list[str], most: int = EDGES) -> list[np.ndarray]:
    """Quantile edges of each feature, one pass for all; approximate beyond 10,000 values (percentile_approx)."""
    at = [i / (most + 1) for i in range(1, most + 1)]
    found = df.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), at, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(e or [], float)) for e in found]


def bins_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for nulls, else 1 and up; a value that equals an edge belongs below it."""
    return np.where(np.isnan(values), 0, np.searchsorted(edges, values, "left") + 1).astype(np.uint8)


def binned(df: DataFrame, id_col: str, group: str, label: str, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(id, g, y int, bins binary): label is a class from 0; rows without a class or group are left out."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.column_stack([bins_of(np.array(b.column(3 + i).to_numpy(zero_copy_only=False), float), e) for i, e in enumerate(edges)]) if b.num_rows else np.zeros((0, len(edges)), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in m], pa.binary())], ["id", "g", "y", "bins"])

    rows = df.where(F.col(label).isNotNull() & F.col(group).isNotNull()).select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(label).cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    return rows.mapInArrow(run, f"id {kinds[id_col]}, g {kinds[group]}, y int, bins binary")


def sums_of(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, width: int) -> np.ndarray:
    """(slot, feature, bin, 3): sums of g and h, and counts."""
    n, f = bins.shape
    flat = (slot[:, None] * f * width + np.arange(f) * width + bins).ravel()
    parts = [np.bincount(flat, np.repeat(x, f), slots * f * width) for x in (g, h)] + [np.bincount(flat, minlength=slots * f * width)]
    return np.stack(parts, 1).reshape(slots, f, width, 3)


def best_split(sums: np.ndarray, s: Setting) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, cut, sums left, sums right) of a node; of equal gains the first feature and the lowest cut."""
    total = sums[0].sum(0)
    left = np.cumsum(sums, 1)[:, :-1]
    right = total - left
    part = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.penalty)
    gain = part(left) + part(right) - part(total)
    ok = (left[..., 2] >= s.least) & (right[..., 2] >= s.least) & (left[..., 1] >= 1e-3) & (right[..., 1] >= 1e-3)
    gain = np.where(ok, gain, -np.inf)
    at = int(gain.argmax())
    if not gain.size or not gain.flat[at] > 1e-9:
        return None
    f, c = divmod(at, gain.shape[1])
    return float(gain[f, c]), f, c, left[f, c], right[f, c]


class Growing:
    """A tree whose leaves' splits are known, or asked for."""

    def __init__(self, s: Setting) -> None:
        self.s, self.tree, self.asked, self.best, self.kids, self.sums = s, Tree(), [0], {}, {}, {}

    def told(self, sums: list[np.ndarray]) -> None:
        """The sums of the nodes that were asked for; asks for further ones."""
        for node, x in zip(self.asked, sums):
            self.sums[node] = x[0].sum(0)
            self.best[node] = best_split(x, self.s)
        self.asked = []
        chosen, leaves = self.chosen()
        room = self.s.leaves - len(leaves)
        able = sorted((n for n in leaves if self.best.get(n)), key=lambda n: (-self.best[n][0], n))
        if room < 1 or not able:
            return
        for n in able[:room]:
            if n not in self.kids:
                _, f, c, left, right = self.best[n]
                self.kids[n] = self.tree.split(n, f, c)
                self.sums[self.kids[n]], self.sums[self.kids[n] + 1] = left, right
                if room > 1:
                    self.asked += [self.kids[n], self.kids[n] + 1]

    def chosen(self) -> tuple[list[int], list[int]]:
        """(nodes split best first, leaves), as far as it is known."""
        split, leaves = [], [0]
        while len(leaves) < self.s.leaves:
            able = [n for n in leaves if self.best.get(n)]
            if not able:
                break
            n = min(able, key=lambda n: (-self.best[n][0], n))
            if n not in self.kids:
                break
            split.append(n)
            leaves.remove(n)
            leaves += [self.kids[n], self.kids[n] + 1]
            if any(x not in self.best for x in leaves[-2:]) and len(leaves) < self.s.leaves:
                break
        return split, leaves

    def grown(self) -> Tree:
        split, _ = self.chosen()
        out, number = Tree(), {0: 0}
        value = lambda x: -x[0] / (x[1] + self.s.penalty) * self.s.rate
        out.value[0] = value(self.sums[0])
        for n in split:
            _, f, c, *_ = self.best[n]
            child = out.split(number[n], f, c)
            number[self.kids[n]], number[self.kids[n] + 1] = child, child + 1
            for i in (0, 1):
                out.value[child + i] = value(self.sums[self.kids[n] + i])
        return out


def gradients(p: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log-loss by class, in whole units."""
    w = weights[y][:, None]
    return np.rint(UNIT * w * (p - (y[:, None] == np.arange(p.shape[1])))), np.rint(UNIT * w * p * (1 - p))


def fitted(rows: DataFrame, roles: dict, classes: int, settings: list[Setting], features: int, width: int) -> list[Model]:
    """Models of binned rows, grown together. roles: group -> what its rows are to each model; a group that is not in it
    takes no part. The table of roles has a byte a group and model."""
    spark = rows.sparkSession
    g_kind = dict(rows.dtypes)["g"]
    table = spark.createDataFrame([(g, bytes(bytearray(r))) for g, r in sorted(roles.items())], f"g {g_kind}, roles binary")
    n_models = len(settings)
    counts = np.zeros((n_models, classes))
    for r in rows.groupBy("g", "y").agg(F.count("*").alias("n")).collect():  # groups times classes
        if r.g in roles:
            counts[np.array(roles[r.g]) == TRAIN, r.y] += r.n
    models = [started(s, c) for s, c in zip(settings, counts)]
    state = stored(rows.join(sized(table), "g").select("y", "bins", "roles", F.lit(b"").alias("scores")), "boosting")
    since = 0

    def decode(b: pa.RecordBatch, now: list[Model], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = b.num_rows
        raw = lambda i, kind: np.frombuffer(b"".join(b.column(i).to_pylist()), kind).reshape(n, -1)
        bins, parts, scores = raw(1, np.uint8), raw(2, np.uint8), raw(3, np.float64)
        start = scores.reshape(n, n_models, classes) if scores.size else None
        return b.column(0).to_numpy(), bins, parts, np.stack([m.scores(bins, None if start is None else start[:, j], first) if n else np.zeros((0, classes)) for j, m in enumerate(now)], 1)

    def rewritten() -> DataFrame:
        shared = spark.sparkContext.broadcast((models, since))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, first = shared.value
            for b in batches:
                if b.num_rows:
                    s = decode(b, now, first)[3]
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x.tobytes() for x in s], pa.binary())], ["y", "bins", "roles", "scores"])

        return stored(state.mapInArrow(run, "y int, bins binary, roles binary, scores binary"), "boosting")

    def passed(growing: dict, loss: bool) -> tuple[dict, dict]:
        """({(model, class): sums of each node asked for}, {model: loss on validation rows})."""
        shared = spark.sparkContext.broadcast((models, since, growing, loss))
        slots = max((len(t.asked) for t in growing.values()), default=1) or 1
        cells = slots * features * width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, first, growing, loss = shared.value
            sums = {mk: np.zeros((len(t.asked), features, width, 3), np.int64) for mk, t in growing.items() if t.asked}
            lost = np.zeros((n_models, 2), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                y, bins, parts, scores = decode(b, now, first)
                for j, m in enumerate(now):
                    own = [k for k in range(classes) if (j, k) in sums]
                    if own:
                        on = np.flatnonzero(parts[:, j] == TRAIN)
                        g, h = gradients(softmax(scores[on, j]), y[on], m.weights)
                        for k in own:
                            t = growing[j, k]
                            place = np.full(len(t.tree.feature), -1)
                            place[t.asked] = np.arange(len(t.asked))
                            slot = place[t.tree.nodes(bins[on])]  # the nodes asked for are leaves so far
                            hit = np.flatnonzero(slot >= 0)
                            if len(hit):
                                sums[j, k] += sums_of(bins[on[hit]], slot[hit], g[hit, k], h[hit, k], len(t.asked), width).astype(np.int64)
                    if loss and not m.done:
                        on = np.flatnonzero((parts[:, j] == VALIDATE) & (m.weights[y] > 0))
                        p = softmax(scores[on, j])[np.arange(len(on)), y[on]]
                        lost[j] += (int(np.rint(UNIT * -np.log(np.maximum(p, 1e-300)) * m.weights[y[on]]).sum()), int(np.rint(UNIT * m.weights[y[on]]).sum()))
            at, out = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
            for (j, k), s in sums.items():
                flat = s.reshape(-1, 3)
                some = np.flatnonzero(flat[:, 2])
                at.append((j * classes + k) * cells + some), out.append(flat[some])
            some = np.flatnonzero(lost[:, 1])
            at.append(-1 - some), out.append(np.column_stack([lost[some], np.zeros(len(some), np.int64)]))
            out = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), *[pa.array(out[:, i].copy()) for i in range(3)]], ["at", "g", "h", "n"])

        total = state.mapInArrow(run, "at long, g long, h long, n long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")]).toArrow()  # a row a bin
        at, values = total.column("at").to_numpy(), np.column_stack([total.column(c).to_numpy() for c in ("g", "h", "n")]).astype(float)
        values[:, :2] /= UNIT
        found = {mk: np.zeros((len(t.asked) * features * width, 3)) for mk, t in growing.items() if t.asked}
        mk, cell = np.divmod(at[at >= 0], cells)
        for j, k in found:
            own = mk == j * classes + k
            found[j, k][cell[own]] = values[at >= 0][own]
        lost = {int(-1 - i): v[0] / v[1] for i, v in zip(at[at < 0], values[at < 0])}
        return {mk: s.reshape(-1, features, width, 3) for mk, s in found.items()}, lost

    while not all(m.done for m in models):
        live = [j for j, m in enumerate(models) if not m.done]
        growing = {(j, k): Growing(models[j].setting) for j in live for k in range(classes) if models[j].weights[k] > 0}
        found, lost = passed(growing, True)
        for j in live:
            if j in lost:
                models[j].losses.append(lost[j])
            models[j].done = models[j].stops()
        growing = {mk: t for mk, t in growing.items() if not models[mk[0]].done}
        while True:
            for mk, t in growing.items():
                if t.asked:
                    t.told(list(found[mk]))
            if not any(t.asked for t in growing.values()):
                break
            found, _ = passed(growing, False)
        for j in live:
            if not models[j].done:
                models[j].rounds.append([growing[j, k].grown() if (j, k) in growing else None for k in range(classes)])
        now = max(len(m.rounds) for m in models)
        if now - since >= WRITE:
            old, state = state, rewritten()
            removed(old)
            since = now
    removed(state)
    return models


def predicted(rows: DataFrame, models: list[Model], roles: dict) -> DataFrame:
    """(model int, id, g, y, p array of doubles): each model's probabilities for the rows that it holds out."""
    kinds = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast((models, roles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, roles = shared.value
        none = [0] * len(models)
        for b in batches:
            if not b.num_rows:
                continue
            parts = np.array([roles.get(g, none) for g in b.column(1).to_pylist()])
            bins = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for j, m in enumerate(models):
                on = np.flatnonzero(parts[:, j] == HELD)
                if len(on):
                    p = m.probabilities(bins[on])
                    take = pa.array(on)
                    yield pa.RecordBatch.from_arrays([pa.array([j] * len(on), pa.int32()), *[b.column(i).take(take) for i in range(3)], pa.array(p.tolist(), pa.list_(pa.float64()))], ["model", "id", "g", "y", "p"])

    return rows.select("id", "g", "y", "bins").mapInArrow(run, f"model int, id {kinds['id']}, g {kinds['g']}, y int, p array<double>")
