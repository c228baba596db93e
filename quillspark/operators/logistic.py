"""Penalised logistic models on words and dense columns of texts, one a class; all models of a fold share their passes.

Words are counted once for all folds; what a fold keeps of them, and what they weigh there, follows from counts by fold, so
nothing of a held-out text is in its fold's features. Texts are written once as blocks: places and dampened counts of words,
and each fold's lengths and z-scores. A pass adds up loss and gradient of all models by task; what reaches the driver are sums
as long as the vocabulary, and more than SUMS of them are added up in tasks first.

The objective is the weighted log-loss plus half the squared coefficients, over the rows; constants are not penalised. Steps are
by limited-memory BFGS, until what a model can still gain is below `tolerance` of its loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import removed, stored

#: Rows of a block; sums that come to the driver without being added up first; steps that a model remembers.
BLOCK, SUMS, MEMORY = 1000, 32, 10
BLOCKS = "fold int, y binary, z binary, short binary, sizes binary, at binary, d binary"


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row, place among the words, count) of the words of texts, split at single spaces; rows ascend."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    own = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    flat = pc.list_flatten(parts)
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
    words, size = flat.dictionary, max(1, len(flat.dictionary))
    cells, n = np.unique(own * size + flat.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(cells, size)
    real = code != pc.index(words, "").as_py()
    return words, row[real], code[real], n[real]


def vocabulary(rows: DataFrame, folds: int, size: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """(words, weights by fold and word) from rows (fold, t): of the words in `least` training texts the `size` most frequent,
    ties by the word, as ln((texts + 1) / (texts with it + 1)). A word that a fold does not keep weighs 0 there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row, code, n = counted(b.column(1))
            cell = b.column(0).to_numpy()[row] * np.int64(max(1, len(words))) + code
            times, texts = np.bincount(cell, n).astype(np.int64), np.bincount(cell)
            at = np.flatnonzero(texts)
            fold, code = np.divmod(at, max(1, len(words)))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(code)), pa.array(fold.astype(np.int32)), pa.array(times[at]), pa.array(texts[at])], ["w", "fold", "n", "d"])

    found = rows.select("fold", "t").mapInArrow(run, "w string, fold int, n long, d long").groupBy("w")
    trained = lambda c, f: F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}")
    found = stored(found.agg(*[trained(c, f) for f in range(folds) for c in ("n", "d")]), "words")
    texts = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    kept = [found.where(F.col(f"d{f}") >= least).orderBy(F.desc(f"n{f}"), "w").limit(size).select("w", F.col(f"d{f}").alias("d")).toArrow() for f in range(folds)]
    removed(found)
    names = pa.array(sorted({w for k in kept for w in k.column("w").to_pylist()}), pa.string())
    weights = np.zeros((folds, len(names)))
    for f, k in enumerate(kept):
        at = pc.index_in(k.column("w"), value_set=names).to_numpy()
        weights[f, at] = np.log((1 + sum(n for x, n in texts.items() if x != f)) / (1 + k.column("d").to_numpy()))
    return names, weights


def blocks(rows: DataFrame, z: list[str], words: pa.Array, weights: np.ndarray) -> DataFrame:
    """Rows (fold, g, y, t, z...) as blocks of one fold each; z are the dense columns of the first fold, then of the next."""
    shared = rows.sparkSession.sparkContext.broadcast((words, weights))
    kind = dict(rows.dtypes)["g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(), kind="stable")))
            fold, y = b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int32)
            own, row, code, n = counted(b.column(3))
            place = pc.fill_null(pc.index_in(own, value_set=words), -1).to_numpy()[code]
            row, at, d = row[place >= 0], place[place >= 0].astype(np.int32), 1 + np.log(n[place >= 0])
            square = np.column_stack([np.bincount(row, (d * w[at]) ** 2, b.num_rows) for w in weights])
            short = np.divide(1, np.sqrt(square), out=np.zeros_like(square), where=square > 0)
            dense = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[4:]]) if z else np.zeros((b.num_rows, 0))
            borders = np.flatnonzero(np.diff(fold, prepend=fold[0] - 1, append=fold[-1] + 1))
            for first, last in zip(borders[:-1], borders[1:]):
                for s in range(first, last, BLOCK):
                    e = min(last, s + BLOCK)
                    lo, hi = np.searchsorted(row, (s, e))
                    sizes = np.bincount(row[lo:hi] - s, minlength=e - s).astype(np.int32)
                    parts = [x.tobytes() for x in (y[s:e], dense[s:e], short[s:e], sizes, at[lo:hi], d[lo:hi].astype(np.float32))]
                    g = b.column(1).slice(s, e - s)
                    yield pa.RecordBatch.from_arrays([pa.array([fold[s]], pa.int32()), *[pa.array([p], pa.binary()) for p in parts], pa.ListArray.from_arrays([0, len(g)], g)], ["fold", "y", "z", "short", "sizes", "at", "d", "g"])

    return stored(rows.select("fold", "g", "y", "t", *z).mapInArrow(run, f"{BLOCKS}, g array<{kind}>"), "text-blocks")


class Block:
    """One block as a fold sees it."""

    def __init__(self, b: pa.RecordBatch, i: int, fold: int, folds: int) -> None:
        raw = lambda name, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind)
        self.y, self.sizes, self.at, self.d = raw("y", np.int32), raw("sizes", np.int32), raw("at", np.int32).astype(np.intp), raw("d", np.float32).astype(float)
        self.n = len(self.y)
        self.z = raw("z", np.float64).reshape(self.n, folds, -1)[:, fold] if len(b.column("z")[i].as_buffer()) else np.zeros((self.n, 0))
        self.short = raw("short", np.float64).reshape(self.n, folds)[:, fold]
        self.full = np.flatnonzero(self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.full]

    def margins(self, words: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """words: coefficients times weights, a row a model that uses words; these models come first. rest: dense ones and
        constants, a column a model."""
        out = self.z @ rest[:-1] + rest[-1]
        for j, own in enumerate(words if len(self.full) else []):
            out[self.full, j] += np.add.reduceat(self.d * own[self.at], self.starts) * self.short[self.full]
        return out

    def pulled(self, r: np.ndarray, words: int, models: int) -> np.ndarray:
        """(models, words): sums over the rows of each word times r (rows, models), for the models that use words."""
        out = np.empty((models, words))
        for j in range(models):
            out[j] = np.bincount(self.at, self.d * np.repeat(r[:, j] * self.short, self.sizes), words)
        return out


def _sums(exact: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """A task's sums; those by word travel in single precision."""
    return pa.RecordBatch.from_arrays([pa.array([exact.tobytes()], pa.binary()), pa.array([words.astype(np.float32).tobytes()], pa.binary())], ["v", "w"])


def _summed(parts: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of rows (v, w), at most one a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.frombuffer(v.as_buffer()), np.frombuffer(w.as_buffer(), np.float32)) for b in batches for v, w in zip(*b.columns)]
        if got:
            yield _sums(sum(v for v, _ in got), sum(w.astype(float) for _, w in got))

    while tasks > SUMS:
        tasks = int(np.ceil(tasks**0.5))
        parts = parts.repartition(tasks).mapInArrow(add, "v binary, w binary")
    got = parts.toArrow()
    v, w = ([x.as_buffer() for x in c] for c in got.columns)
    return sum(np.frombuffer(x) for x in v), sum(np.frombuffer(x, np.float32).astype(float) for x in w)


class Steps:
    """The limited-memory steps of one model. curve: about the second derivative of each coefficient."""

    def __init__(self, curve: np.ndarray, tolerance: float) -> None:
        self.curve, self.tolerance, self.x, self.t, self.done = curve, tolerance, np.zeros(len(curve)), 0.0, False
        self.trial, self.way, self.loss, self.g, self.pairs = self.x, None, np.inf, None, []

    def told(self, loss: float, g: np.ndarray) -> None:
        """Loss and gradient at the trial point; sets the next one, unless the model is done."""
        slope = 0.0 if self.way is None else self.t * float(self.g @ self.way)
        if self.way is not None and not loss <= self.loss + 1e-4 * slope:
            # the lowest point of the parabola through what is known
            self.t *= min(0.5, max(0.1, -0.5 * slope / max(1e-300, loss - self.loss - slope)))
            self.done = -slope <= 1e-14 * abs(self.loss)  # no further by the precision of doubles
        else:
            if self.way is not None:
                s, y = self.trial - self.x, g - self.g
                if s @ y > 1e-12 * (y @ y):
                    s, y = s.astype(np.float32), y.astype(np.float32)  # a memory of curvature, not of the point
                    self.pairs = [*self.pairs[1 - MEMORY :], (s, y, 1 / float(s.astype(float) @ y))]
            self.x, self.loss, self.g, self.t = self.trial, loss, g, 1.0
            self.way = -self.turned(g)
            self.done = -float(g @ self.way) <= self.tolerance * loss
        self.trial = self.x + self.t * self.way

    def turned(self, g: np.ndarray) -> np.ndarray:
        q, by = g.copy(), []
        for s, y, r in reversed(self.pairs):
            by.append(r * float(s @ q))
            q -= by[-1] * y
        q /= self.curve
        if self.pairs:
            s, y, r = self.pairs[-1]
            q *= 1 / (r * float(y @ (y / self.curve)))
        for (s, y, r), a in zip(self.pairs, reversed(by)):
            q += s * (a - r * float(y @ q))
        return q


def fitted(table: DataFrame, fold: int, folds: int, weights: np.ndarray, dense: int, models: list[tuple[str, int]], size: dict[int, int], tolerance: float = 1e-6, turns: int = 500) -> np.ndarray:
    """(words + dense + 1, models): coefficients, and the constant last, of models (kind of features, class) on the other folds.

    kind: words, both or dense; models that use words come first. size: training rows of each class, 0 < size < all."""
    context, v, tasks = table.sparkSession.sparkContext, weights.shape[1], table.rdd.getNumPartitions()
    rows = sum(size.values())
    part = table.where(F.col("fold") != fold).select("y", "z", "short", "sizes", "at", "d")

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v + dense)
        for b in batches:
            for i in range(b.num_rows):
                x = Block(b, i, fold, folds)
                total[:v] += np.bincount(x.at, (x.d * np.repeat(x.short, x.sizes)) ** 2, v)
                total[v:] += (x.z**2).sum(0)
        yield _sums(total[v:], total[:v])

    others, total = _summed(part.mapInArrow(squares, "v binary, w binary"), tasks)
    total = np.concatenate([total * weights[fold] ** 2, others, [rows]])
    used = {k: np.concatenate([np.full(v, k != "dense"), np.full(dense, k != "words"), [True]]) for k in ("words", "both", "dense")}
    penalty = np.append(np.ones(v + dense), 0)
    states = [Steps((0.25 * total + penalty)[used[k]] / rows, tolerance) for k, _ in models]

    def full(x: np.ndarray, kind: str) -> np.ndarray:
        out = np.zeros(v + dense + 1)
        out[used[kind]] = x
        return out

    for _ in range(turns):
        live = [j for j, s in enumerate(states) if not s.done]
        if not live:
            return np.column_stack([full(s.x, k) for s, (k, _) in zip(states, models)])
        kinds, classes = [models[j][0] for j in live], np.array([models[j][1] for j in live])
        wordy = sum(k != "dense" for k in kinds)
        at = np.column_stack([full(states[j].trial, models[j][0]) for j in live])
        yes = np.array([rows / (2 * size[k]) for k in classes])
        no = np.array([rows / (2 * (rows - size[k])) for k in classes])
        shared = context.broadcast((np.ascontiguousarray(at[:v, :wordy].T) * weights[fold], at[v:], classes, yes, no))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, wordy=wordy) -> Iterator[pa.RecordBatch]:
            words, rest, classes, yes, no = shared.value
            pulled, others, loss = np.zeros((wordy, v)), np.zeros((dense + 1, len(classes))), np.zeros(len(classes))
            for b in batches:
                for i in range(b.num_rows):
                    x = Block(b, i, fold, folds)
                    own = x.y[:, None] == classes
                    sign, w = np.where(own, 1.0, -1.0), np.where(own, yes, no)
                    m = sign * x.margins(words, rest)
                    loss += (w * np.logaddexp(0, -m)).sum(0)
                    r = -sign * w * np.exp(-np.logaddexp(0, m))
                    others += np.vstack([x.z.T @ r, r.sum(0)])
                    pulled += x.pulled(r, v, wordy)
            yield _sums(np.concatenate([others.ravel(), loss]), pulled.ravel())

        others, pulled = _summed(part.mapInArrow(run, "v binary, w binary"), tasks)
        shared.destroy()
        others, loss = np.split(others, [(dense + 1) * len(live)])
        pulled, others = pulled.reshape(wordy, v) * weights[fold], others.reshape(dense + 1, len(live))
        for i, j in enumerate(live):
            on = used[kinds[i]]
            g = np.concatenate([pulled[i] if i < wordy else np.zeros(v), others[:, i]])[on]
            p = penalty[on] * states[j].trial
            states[j].told(float(loss[i] + 0.5 * p @ states[j].trial) / rows, (g + p) / rows)
    raise RuntimeError("logistic models did not settle")


def held_out(table: DataFrame, folds: int, weights: np.ndarray, dense: int, kinds: list[str], classes: int, fits: list[dict[tuple[str, int], np.ndarray]], alone: list[list[float]]) -> DataFrame:
    """(features, g, y, c, n): each row goes to the class whose model of its own fold is surest; of equal ones the first.

    fits: the models of each fold, by kind and class. alone: what a class without a model counts as."""
    shared = table.sparkSession.sparkContext.broadcast((weights, fits, alone))
    v, group = weights.shape[1], dict(table.dtypes)["g"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, fits, alone = shared.value
        for b in batches:
            for i in range(b.num_rows):
                fold = b.column("fold")[i].as_py()
                x, groups = Block(b, i, fold, folds), b.column("g")[i].values.dictionary_encode()
                for kind in kinds:
                    sure = np.tile(np.array(alone[fold], float), (x.n, 1))
                    known = [k for k in range(classes) if (kind, k) in fits[fold]]
                    if known:
                        at = np.column_stack([fits[fold][kind, k] for k in known])
                        # as probabilities, which can be equal where margins are not
                        sure[:, known] = 1 / (1 + np.exp(-np.clip(x.margins(np.ascontiguousarray(at[:v].T) * weights[fold], at[v:]), -700, 700)))
                    cell, n = np.unique((groups.indices.to_numpy() * np.int64(classes) + x.y) * classes + sure.argmax(1), return_counts=True)
                    cell, c = np.divmod(cell, classes)
                    g, y = np.divmod(cell, classes)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), groups.dictionary.take(pa.array(g)), pa.array(y.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], ["features", "g", "y", "c", "n"])

    return table.mapInArrow(run, f"features string, g {group}, y int, c int, n long").groupBy("features", "g", "y", "c").agg(F.sum("n").alias("n"))
