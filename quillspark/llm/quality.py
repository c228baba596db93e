"""Quality: a document classifier's evidence, shrunk through host and path by hierarchical empirical Bayes.

A logistic classifier over a text's shape (shares of kinds of characters, repeated words and lines) gives each document
a probability. Grouped sums of these give each host and each path below it a posterior mean: a path is drawn towards its
host, a host towards the whole, the more the fewer documents it has. The strengths of the priors are estimated from the
groups themselves by moments. A document's score moves its own log-odds by how far its path's posterior is from the
overall mean.

The classifier's sample is bounded: at most `per_class` labelled rows a class, of at most `longest` bytes, by a hash of
the id. Groups may hold any share of all rows: only sums leave a task before the shuffle, and documents meet their
path's row in a join that can be split.

Defined results: null and empty texts have the features of an empty text; a null host or path is a group of its own;
documents without an address take any two nested columns for host and path (op9: source and language), and `site` gives
them for those with one; with no labels of both classes the classifier gives 0.5; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import coded, slices
from .common import labelled_sample, prepare, written

PER_CLASS, LONGEST = 2000, 20_000
KEEP = 0.5
#: Kinds of bytes: lower case, upper case, digit, space, line end, ordinary punctuation, bar, other signs, part of a longer character.
KINDS = 9


def _kinds() -> np.ndarray:
    table = np.full(256, 7, np.int64)
    for chars, kind in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((32, 9, 13), 3), ((10,), 4), (map(ord, ".,;:'\"()-?"), 5), ((124,), 6), (range(128, 256), 8)):
        table[list(chars)] = kind
    return table


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    kinds, out = _kinds(), []
    codes, borders, _ = coded(texts)
    n = np.diff(borders)
    owner = np.repeat(np.arange(len(n)), n)
    span = int(codes.max(initial=0)) + 1
    distinct = np.bincount(np.unique(owner * span + codes) // span, minlength=len(n)) / n
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    again = np.add.reduceat(same, borders[:-1]) / n
    for i, x in enumerate(texts):
        data = x.as_buffer() if x.is_valid else b""
        raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
        counts = np.bincount(kinds[raw], minlength=KINDS) if len(raw) < 512 else np.bincount(raw, minlength=256) @ np.eye(KINDS, dtype=np.int64)[kinds]
        share = counts / max(1, len(raw))
        lines = bytes(data).split(b"\n") if data is not None else [b""]
        out.append([*share, *np.sqrt(share), len(set(lines)) / len(lines), math.log1p(len(raw)), len(raw) / n[i] if n[i] else 0])
    out = np.array(out)
    size = out[:, -2]
    return np.column_stack([out[:, :-1], np.log1p(out[:, -1]), distinct, distinct**2, distinct * size / 10, again, np.sqrt(again), again > 0.01, out[:, 7] > 0.01, out[:, 6] > 0.004, out[:, 1] > 0.08, np.ones(len(out))]).astype(float)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 40) -> np.ndarray:
    """Weights of a logistic model, with the classes balanced, by Newton steps; the last is that of the constant."""
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1] if x.ndim == 2 and x.shape[1] else 1)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    weight, w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y), np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    out = w / scale
    out[-1] -= (w * mean / scale).sum()
    return out


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality", per_class: int = PER_CLASS, longest: int = LONGEST) -> np.ndarray:
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).groupBy("i").agg(F.max("y").alias("y"))
    texts = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = labelled_sample(texts, known, per_class, longest)
    if not rows:
        return np.zeros(1)
    return train(features(pa.array([r.t for r in rows], pa.string())), np.array([r.y for r in rows]))


def site(url: Column) -> tuple[Column, Column]:
    """(host, first part of the path) of an address: the groups that pages of a site fall into. What is no address is null."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    return F.nullif(host, F.lit("")), F.when(host != "", F.when(path == "", "/").otherwise(path))


def evidence(df: DataFrame, weights: np.ndarray, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(id, host, path, p): the classifier alone."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = 0
            for part in slices(b.column(3)):
                x = features(part)
                p = 1 / (1 + np.exp(-np.clip(x @ weights if len(weights) > 1 else np.zeros(len(x)), -12, 12)))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(start, len(part)) for i in range(3)), pa.array(p)], ["id", "host", "path", "p"])
                start += len(part)

    cols = [F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("t")]
    return df.select(cols).mapInArrow(run, "id long, host string, path string, p double")


def _strength(groups: DataFrame, mean: str, within: str) -> float:
    """How many documents a prior is worth: variance inside groups over variance between them, by moments."""
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)).alias("b"), F.sum(within).alias("w")).first()
    if not r.n or r.k < 2 or r.n <= r.k:
        return 10.0
    inside = r.w / (r.n - r.k)
    between = (r.b - (r.k - 1) * inside) / max(1e-9, r.n - r.n2 / r.n)
    return float(min(1e6, max(1.0, inside / max(between, 1e-9))))


def score(marks: DataFrame) -> DataFrame:
    """(id, p, host_mean, path_mean, score) from a written table of evidence."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")]
    paths = written(marks.groupBy("host", "path").agg(*sums), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total.s / total.n if total.n else 0.5
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "s2"))).withColumn("m", F.lit(mean)).withColumn("w", F.col("s2") - F.col("s") * F.col("s") / F.col("n"))
    k = _strength(hosts, "m", "w")
    hosts = hosts.select("host", ((k * mean + F.col("s")) / (k + F.col("n"))).alias("host_mean"))
    below = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    k = _strength(below.withColumn("w", F.col("s2") - F.col("s") * F.col("s") / F.col("n")), "host_mean", "w")
    below = below.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_mean", ((k * F.col("host_mean") + F.col("s")) / (k + F.col("n"))).alias("path_mean"))
    odds = lambda c: F.ln(c / (1 - c))
    shift = odds(F.col("path_mean")) - math.log(mean / (1 - mean))
    found = marks.join(below, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    return found.select("id", "host", "path", "p", "host_mean", "path_mean", (1 / (1 + F.exp(-(odds(F.col("p")) + shift)))).alias("score"))


def op9(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text")
    found = score(written(evidence(documents, weights, "doc_id", "text", "source", "lang"), "evidence"))
    return found.select(F.col("id").alias("doc_id"), F.col("host").alias("source"), F.col("path").alias("lang"), "p", "host_mean", "path_mean", "score", (F.col("score") >= KEEP).alias("keep"))
