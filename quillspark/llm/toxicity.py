"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word goes in as two learned vectors: that of its hashed form and the sum of those of its hashed character n-grams, so
disguised and inflected forms are near the plain ones. Two gated recurrent layers read a window of words from both ends;
attention pools their states into one logit. Overlapping windows cover the whole text; a text's score is that of its
worst window. Labels are of texts, so in training a text stands for its worst window (first by the log-odds of its
n-grams, then by the network itself).

The training sample is bounded: at most `per_class` labelled rows a class, of at most `longest` bytes, picked by a hash
of the id. Labels of held-out rows are never read. Only the text goes into a score.

Defined results: null and empty texts are one empty window and have a score; very long texts are many windows; repeated
rows have equal scores; with no labelled rows of both classes scores are 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coded, slices
from .common import given_back, labelled_sample, let_go, prepare, row_of

WINDOW, STRIDE = 32, 16
WORDS, GRAMS, WIDE, HIDDEN = 1 << 13, 1 << 15, 8, 8
PER_CLASS, LONGEST = 1500, 4000
THRESHOLD = 0.7
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(piece: str) -> bytes:
    return _EDGE.sub("", piece.lower()).encode()


def word_features(words: list[bytes], most: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each word; n-gram buckets of all words, one after another; where each word's n-grams begin).

    So many words at a time, so that what is computed on the way stays small.
    """
    bucket = np.fromiter((zlib.crc32(w) % WORDS for w in words), np.int32, len(words))
    parts = [_grams(words[i : i + most]) for i in range(0, len(words), most)]
    if not parts:
        return bucket, np.zeros(0, np.int32), np.zeros(0, np.int64)
    counts = np.concatenate([n for _, n in parts])
    return bucket, np.concatenate([g for g, _ in parts]), np.cumsum(counts) - counts


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets of all words, one after another; number of each word's n-grams)."""
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    grams, owners = [], []
    for n in (3, 4, 5):
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) ^ data[k : len(data) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        code *= np.uint64(0x9E3779B97F4A7C15)
        grams.append((code >> np.uint64(49))[inside].astype(np.int32))
        owners.append(owner[: len(code)][inside])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    return grams[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; an empty run is zero."""
    out = np.zeros((len(starts), values.shape[1]), np.float32)
    full = np.append(starts[1:], len(values)) > starts
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], 0)
    return out


def _gathered(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sum of the rows of each)."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return own[starts], np.add.reduceat(values[order], starts, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def init(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = lambda *s, by=0.3: (rng.normal(size=s) * by).astype(np.float32)
    p = {"words": r(WORDS, WIDE, by=0.02), "grams": r(GRAMS, WIDE, by=0.02), "att": r(2 * HIDDEN), "out": r(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": r(2 * WIDE, 3 * HIDDEN), f"u{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def vectors(p: dict, features: tuple, most: int = 20_000) -> np.ndarray:
    """Input vectors of words; so many at a time, so that their n-grams' vectors stay few."""
    bucket, grams, starts = features
    ends = np.append(starts[1:], len(grams))
    out = np.empty((len(bucket), 2 * WIDE), np.float32)
    out[:, :WIDE] = p["words"][bucket]
    for i in range(0, len(bucket), most):
        a, b = starts[i : i + most], ends[i : i + most]
        out[i : i + most, WIDE:] = _sums(p["grams"][grams[a[0] : b[-1]]], a - a[0]) / np.sqrt(np.maximum(1, b - a))[:, None]
    return out


def _layer(gates: np.ndarray, rows: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (steps, windows, hidden). gates: input part of the gates by word; rows: (steps, windows) word of each step, the
    last word standing for no word."""
    steps, n = rows.shape
    h, none = np.zeros((n, HIDDEN), np.float32), len(gates) - 1
    states = np.empty((steps, n, HIDDEN), np.float32)
    uzr, uc = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g = gates[rows[t]]
        zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ uzr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        z = z * (rows[t] != none)[:, None]
        rh = r * h
        c = np.tanh(g[:, 2 * HIDDEN :] + rh @ uc)
        new = h + z * (c - h)
        if keep is not None:
            keep.append((t, h, z, r, rh, c))
        h = states[t] = new
    return states


def forward(p: dict, gates: dict[str, np.ndarray], rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window."""
    states = []
    for d in "fb":
        states.append(_layer(gates[d], rows, p[f"u{d}"], d == "b", None if keep is None else keep.setdefault(d, [])))
    s = np.concatenate(states, 2)
    a = s @ p["att"]
    a[rows == len(gates["f"]) - 1] = -30
    a -= a.max(0)
    np.exp(a, out=a)
    a /= a.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, s)
    if keep is not None:
        keep |= {"s": s, "a": a, "pooled": pooled}
    return pooled @ p["out"] + p["bias"][0]


def _gates(p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    return {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}


def step(p: dict, x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the parameters and of the word vectors x; the loss."""
    keep: dict = {}
    gates = _gates(p, x)
    logit = forward(p, gates, rows, keep)
    prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum())
    dlogit = (weight * (prob - y)).astype(np.float32)
    s, a = keep["s"], keep["a"]
    dpooled = dlogit[:, None] * p["out"]
    grad = {"out": keep["pooled"].T @ dlogit, "bias": dlogit.sum(keepdims=True)}
    da = np.einsum("tnh,nh->tn", s, dpooled)
    da = a * (da - (a * da).sum(0))
    grad["att"] = np.einsum("tn,tnh->h", da, s)
    ds = a[:, :, None] * dpooled + da[:, :, None] * p["att"]
    dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
    full = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    for d, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
        u = p[f"u{d}"]
        uz, ur, uc = u[:, :HIDDEN], u[:, HIDDEN : 2 * HIDDEN], u[:, 2 * HIDDEN :]
        du = np.zeros_like(u)
        dgates = np.zeros_like(gates[d])
        dh = np.zeros((rows.shape[1], HIDDEN), np.float32)
        each = np.empty((*rows.shape, 3 * HIDDEN), np.float32)
        for t, h, z, r, rh, c in reversed(keep[d]):
            dh = dh + part[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z) * (rows[t] != len(x))[:, None]
            drh = dc @ uc.T
            dr = drh * h * r * (1 - r)
            g = np.concatenate([dz, dr, dc], 1)
            du[:, : 2 * HIDDEN] += h.T @ g[:, : 2 * HIDDEN]
            du[:, 2 * HIDDEN :] += rh.T @ dc
            each[t] = g
            dh = dh * (1 - z) + drh * r + dz @ uz.T + dr @ ur.T
        used, total = _gathered(each.reshape(-1, 3 * HIDDEN), rows.reshape(-1))
        dgates[used] = total
        dgates[len(x)] = 0
        grad[f"u{d}"], grad[f"w{d}"], grad[f"c{d}"] = du, full.T @ dgates, dgates.sum(0)
        dx += dgates @ p[f"w{d}"].T
    return grad, dx[: len(x)], loss


def _formed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(a code for each word, borders of the texts, form of each code); forms are distinct."""
    codes, borders, pieces = coded(texts)
    known: dict[bytes, int] = {}
    to = np.fromiter((known.setdefault(normal(x), len(known)) for x in pieces), np.int32, len(pieces))
    return to[codes], borders, list(known)


def windows(borders: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of overlapping windows that cover every text; a text has one at least."""
    size = np.diff(borders)
    n = 1 + np.maximum(0, -(-(size - window) // stride))
    text = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return borders[:-1][text] + at * stride, text


def _rows(codes: np.ndarray, borders: np.ndarray, first: np.ndarray, text: np.ndarray, none: int) -> np.ndarray:
    at = first[None, :] + np.arange(WINDOW)[:, None]
    inside = at < borders[1:][text][None, :]
    return np.where(inside, codes[np.minimum(at, len(codes) - 1)], none)


def train(texts: list[str], labels: np.ndarray, rounds: int = 4, steps: int = 60, batch: int = 192, seed: int = 7) -> dict[str, np.ndarray]:
    p, rng = init(seed), np.random.default_rng(seed)
    y = labels.astype(np.float32)
    if len(set(labels.tolist())) < 2:
        p["out"][:] = 0
        return p
    codes, borders, forms = _formed(pa.array(texts, pa.string()))
    features = word_features(forms)
    bucket, grams, starts = features
    ends = np.append(starts[1:], len(grams))
    first, text = windows(borders)
    rows = _rows(codes, borders, first, text, len(forms)).astype(np.int32)
    # a first guess of the worst window: log-odds of n-grams by the texts that have them, of a word's best ones
    sizes = ends - starts
    counts = [np.zeros(GRAMS, np.int64), np.zeros(GRAMS, np.int64)]
    for i in range(len(texts)):
        word = np.unique(codes[borders[i] : borders[i + 1]])
        size = sizes[word]
        own = grams[np.repeat(starts[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        counts[int(labels[i])][np.unique(own)] += 1
    totals = [max(1, int((labels == k).sum())) for k in (0, 1)]
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    odds *= np.sqrt(counts[1] + 0.0)
    p["grams"][:, 0] += np.where(counts[1] > 1, np.clip(odds / 10, -0.5, 2), 0)
    best = np.zeros(len(forms) + 1)
    if len(grams):
        full = ends > starts
        best[:-1][full] = np.maximum.reduceat(odds[grams], starts[full])
    score = best[rows].max(0)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    t = 0
    for turn in range(rounds):
        order = np.lexsort((score, text))
        worst = order[np.append(text[order][1:] != text[order][:-1], True)]
        clean = np.flatnonzero(y[text] == 0)
        pools = [worst[y[text[worst]] == 1], worst[y[text[worst]] == 0], clean]
        rate = 0.02 * (1 - turn / rounds) + 0.002
        for _ in range(steps):
            own = np.concatenate([rng.choice(x, batch // 3) for x in pools])
            used, local = np.unique(rows[:, own], return_inverse=True)
            local = local.reshape(WINDOW, len(own))
            real = used[used < len(forms)]
            local = np.where(rows[:, own] == len(forms), len(real), local)
            size = sizes[real]
            flat = grams[np.repeat(starts[real] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            x = vectors(p, (bucket[real], flat, np.cumsum(size) - size))
            weight = np.where(y[text[own]] == 1, 2.0, 1.0)
            grad, dx, _ = step(p, x, local, y[text[own]], (weight / weight.sum()).astype(np.float32))
            t += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            spread = np.repeat(dx[:, WIDE:] / np.sqrt(np.maximum(1, size))[:, None], size, 0)
            for k, at_, g in (("words", bucket[real], dx[:, :WIDE]), ("grams", flat, spread)):
                if not len(at_):
                    continue
                rows_, total = _gathered(g, at_)
                v[k][rows_] += total * total
                # one scale for all rows: what few texts have moves little
                p[k][rows_] -= 4 * rate * total / (np.sqrt(v[k].max()) + 1e-6)
        if turn < rounds - 1:
            score = _window_logits(p, vectors(p, features), rows)
    return p


def _window_logits(p: dict, x: np.ndarray, rows: np.ndarray, batch: int = 2048) -> np.ndarray:
    gates = _gates(p, x)
    return np.concatenate([forward(p, gates, rows[:, i : i + batch]) for i in range(0, rows.shape[1], batch)])


def score_texts(p: dict, texts: pa.Array, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, number of windows, first word of the worst window) of each text."""
    codes, borders, forms = _formed(texts)
    gates = _gates(p, vectors(p, word_features(forms)))
    first, text = windows(borders)
    logits = np.empty(len(first), np.float32)
    for i in range(0, len(first), batch):
        logits[i : i + batch] = forward(p, gates, _rows(codes, borders, first[i : i + batch], text[i : i + batch], len(forms)))
    begin = np.searchsorted(text, np.arange(len(texts)))
    worst = np.maximum.reduceat(logits, begin)
    at = np.full(len(texts), len(first))
    np.minimum.at(at, text, np.where(logits == worst[text], np.arange(len(first)), len(first)))
    return 1 / (1 + np.exp(-worst.astype(np.float64))), np.bincount(text, minlength=len(texts)), first[at] - borders[:-1]


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, longest: int = LONGEST) -> dict[str, np.ndarray]:
    """The network, trained on a bounded sample of the labelled rows that aren't held out."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).groupBy("i").agg(F.max("y").alias("y"))
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = labelled_sample(texts, known, per_class, longest)
    return train([r.t for r in rows], np.array([r.y for r in rows], np.int64))


def score(df: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, score double, n_windows long, worst_word long)."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # of a fixed size, about 1.3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = 0
            for part in slices(b.column(1)):
                found = score_texts(shared.value, part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), *(pa.array(c) for c in found)], ["id", "score", "n_windows", "worst_word"])
                start += len(part)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double, n_windows long, worst_word long")


def kept(df: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, as they are, whose texts score below the threshold. Only texts go to Python, only scores come back."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for texts in batches:
            found = [score_texts(shared.value, part)[0] for part in slices(texts)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))
        given_back()

    rows = df.select(row_of(df.columns), F.arrow_udf(run, "double")(df[text_col].cast("string")).alias("score"))
    return rows.where(F.col("score") < threshold).select("row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows", "worst_word")
