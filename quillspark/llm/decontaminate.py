"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

A benchmark item is its words' shingles (five words; a shorter item is one shingle). A document's windows have as many
words as the item, and start at every word. Each window has a SimHash over its weighted shingles. The items of a length
are found by a multi-index: the 64 bits are cut into BLOCKS blocks, and of two fingerprints that differ in at most RADIUS
bits, one block differs in at most its own share of them (the shares and BLOCKS - 1 make up RADIUS), so a table that has
each item under all values so near to its own in a block gives every item within the radius. Candidates are then verified
by the exact weighted Jaccard similarity of the shingles, or by their plain one, whichever is higher; a shingle weighs
1 / (items of the whole benchmark that have it), a shingle that no item has weighs 1.

The index meets 7 % of all pairs of unlike fingerprints and keeps all within the radius. Texts as similar as 0.8 differ in
10 of 64 bits on average (standard deviation 3), so a radius of 16 loses about one pair in a hundred at the threshold and
fewer above it (the tests measure it against brute force).

The plain similarity counts beside the weighted one because items that share text make their own shingles light, so that
a changed word, whose shingles weigh 1, would count for more than it is. For it, windows and items also have a SimHash
without weights.

A window that has no shingle of any item of its length has similarity zero with all of them, so it's passed over before
it is hashed; which items a window is compared with, the index alone decides. Words are lower-cased and stripped of
punctuation at their ends. The benchmark is read in blocks of at most `block` items; each block's index is broadcast (some
10 kB an item at most). Weights are counted once over all blocks, so results do not depend on them; with each block go 16
bytes for each shingle that several items of the benchmark have.

Defined results: null, empty and blank texts and items match nothing; a document shorter than an item is one window; of
windows that are equally similar the first counts; repeated documents and items each give their own rows; empty tables
give no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coded, slices
from .common import given_back, held, prepare, row_of
from .toxicity import normal

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 16, 4
BLOCK_BITS = 64 // BLOCKS
#: Bits in which a block may differ: for two fingerprints within the radius, some block is within its own.
SHARES = [(RADIUS - BLOCKS + 1) // BLOCKS + (b < (RADIUS - BLOCKS + 1) % BLOCKS) for b in range(BLOCKS)]
SCHEMA = "id long, item long, similarity double, first_word long, n_words long"
_PRIME = 0x9E3779B97F4A7C15


def word_codes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of so many words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(_PRIME) + codes[k : k + n]
    return _mix(out)


def _signs(codes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(_mix(codes * np.uint64(_PRIME)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float64) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def item_shingles(text: str | None) -> tuple[np.ndarray, int, int] | None:
    """(shingle codes, words, words of a shingle) of an item; nothing for one without words."""
    words = [w for w in (normal(x) for x in (text or "").split()) if w]
    if not words:
        return None
    size = min(SHINGLE, len(words))
    return shingles(word_codes(words), size), len(words), size


def shared_weights(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the shingles that several of the items (i, t) have; all others weigh 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                if own := item_shingles(t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(own[0]).view(np.int64))], ["x"])

    counts = items.select("t").mapInArrow(run, "x long").groupBy("x").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    return counts["x"].to_numpy().view(np.uint64), 1.0 / counts["n"].to_numpy()


def _near_masks(bits: int) -> np.ndarray:
    """All values of a block with at most so many bits set."""
    return np.array([sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)], np.uint64)


class MultiIndex:
    """Fingerprints, found again by all that lie within the radius of them."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.tables = []
        low = np.uint64((1 << BLOCK_BITS) - 1)
        for b, share in enumerate(SHARES):
            values = (prints >> np.uint64(b * BLOCK_BITS)) & low
            near = (values[:, None] ^ _near_masks(share)[None, :]).reshape(-1).astype(np.int64)
            order = np.argsort(near, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << BLOCK_BITS))])
            self.tables.append((starts, (order // max(1, len(near) // max(1, len(prints)))).astype(np.int32)))

    def met(self, of: np.ndarray) -> np.ndarray:
        """(position * items + item), each once, of all that meet in a block."""
        out = []
        for b, (starts, items) in enumerate(self.tables):
            v = ((of >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = starts[v + 1] - starts[v]
            at = np.repeat(starts[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(np.repeat(np.arange(len(of)), n) * len(self.prints) + items[at])
        return np.unique(np.concatenate(out))

    def within(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of all pairs within the radius."""
        at, item = np.divmod(self.met(of), max(1, len(self.prints)))
        near = np.bitwise_count(of[at] ^ self.prints[item]) <= RADIUS
        return at[near], item[near]


class Group:
    """The items of one length: their shingles, fingerprints and index."""

    def __init__(self, length: int, size: int, items: list[tuple[int, np.ndarray, dict[int, int], bool]], keys: np.ndarray, weights: np.ndarray) -> None:
        self.length, self.size, self.items = length, size, items
        own = [s for _, s, _, _ in items]
        self.keys = np.unique(np.concatenate(own))
        prints, plain = [], []
        for s in own:
            w = weights[np.searchsorted(keys, s)]
            prints.append(_packed(np.round((_signs(s) * w[:, None]).sum(0, keepdims=True), 9))[0])
            plain.append(_packed(_signs(s).sum(0, keepdims=True))[0])
        self.index = MultiIndex(np.array(prints, np.uint64))
        light = [k for k, x in enumerate(items) if x[3]]
        self.light = np.array(light, np.int64)
        self.plain = MultiIndex(np.array(plain, np.uint64)[self.light]) if light else None


class Index:
    """Items of one block of the benchmark, ready for documents; weights are those of the whole benchmark if not of the block."""

    def __init__(self, items: list[tuple[int, str]], weights: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        own = [(i, *found) for i, text in items if (found := item_shingles(text))]
        every = [np.unique(s) for _, s, _, _ in own]
        self.keys, n = np.unique(np.concatenate([*every, np.zeros(0, np.uint64)]), return_counts=True)
        self.weights = 1.0 / n
        if weights is not None:
            self.weights = np.ones(len(self.keys))
            known, at = np.isin(self.keys, weights[0]), np.argsort(weights[0])
            self.weights[known] = weights[1][at][np.searchsorted(weights[0][at], self.keys[known])]
        self.weight = dict(zip(self.keys.tolist(), self.weights.tolist()))
        by: dict[tuple[int, int], list] = defaultdict(list)
        for i, s, length, size in own:
            bag: dict[int, int] = defaultdict(int)
            for x in s.tolist():
                bag[x] += 1
            # only for items with shared shingles the plain similarity can be the higher one
            by[length, size].append((i, s, dict(bag), any(self.weight[x] < 1 for x in bag)))
        self.groups = [Group(length, size, x, self.keys, self.weights) for (length, size), x in sorted(by.items())]
        self.sizes = sorted({g.size for g in self.groups})

    def weights_of(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, codes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == codes, self.weights[at], 1.0)

    def similarity(self, window: list[int], item: dict[int, int], light: bool) -> float:
        bag: dict[int, int] = defaultdict(int)
        for x in window:
            bag[x] += 1
        w = self.weight
        both = sum(min(n, item[x]) * w[x] for x, n in bag.items() if x in item)
        weighted = both / (sum(n * w.get(x, 1.0) for x, n in bag.items()) + sum(n * w[x] for x, n in item.items()) - both)
        if not light:
            return weighted
        both = sum(min(n, item[x]) for x, n in bag.items() if x in item)
        return max(weighted, both / (len(window) + sum(item.values()) - both))

    def matches(self, codes: np.ndarray, known: dict[int, tuple[np.ndarray, np.ndarray]], least: float, seen: list | None = None) -> list[tuple]:
        """(item, similarity, first word, words) of a document's best window for each item that is near enough.

        known: by words of a shingle, the document's shingles that the benchmark has, and their places. seen: if given,
        gets the number of pairs of a window and an item, of those that met in the index, and of those verified.
        """
        n, out = len(codes), []
        for g in self.groups:
            values, places = known.get(g.size, (codes[:0], codes[:0]))
            at = np.searchsorted(g.keys, values)
            at[at == len(g.keys)] = 0
            places = places[g.keys[at] == values]
            if not len(places):
                continue
            length = min(g.length, n)
            m = length - g.size + 1
            # windows that have such a shingle: runs of starts, neighbours of which share their sums
            change = np.zeros(n + 2, np.int64)
            np.add.at(change, np.maximum(0, places + g.size - length), 1)
            np.add.at(change, np.minimum(places, n - length) + 1, -1)
            starts = np.flatnonzero(np.cumsum(change[: n - length + 1]) > 0)
            best: dict[int, tuple] = {}
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > length) + 1):
                lo = int(run[0])
                own = shingles(codes[lo : int(run[-1]) + length], g.size)
                signs = _signs(own)

                def prints(x: np.ndarray) -> np.ndarray:
                    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(x, 0)])
                    return _packed(np.round(sums[run - lo + m] - sums[run - lo], 9))

                of = prints(signs * self.weights_of(own)[:, None])
                where, item = g.index.within(of)
                if seen is not None:
                    seen.append((len(of) * len(g.items), len(g.index.met(of)), len(where)))
                if g.plain is not None:
                    more, light = g.plain.within(prints(signs))
                    where, item = np.concatenate([where, more]), np.concatenate([item, g.light[light]])
                for i, k in sorted(set(zip(where.tolist(), item.tolist()))):
                    start = int(run[i])
                    _, _, bag, light = g.items[k]
                    s = self.similarity(own[start - lo : start - lo + m].tolist(), bag, light)
                    if s >= least - 1e-12 and (k not in best or s > best[k][1] + 1e-12):
                        best[k] = (g.items[k][0], s, start, length)
            out += best.values()
        return out

    def search(self, texts: pa.Array, least: float) -> dict[int, list[tuple]]:
        """Matches by text, for texts that have some."""
        codes, borders, pieces = coded(texts)
        words = [normal(x) for x in pieces]
        keep = np.fromiter((bool(w) for w in words), bool, len(words))[codes]
        text = np.repeat(np.arange(len(texts)), np.diff(borders))[keep]
        flat = word_codes(words)[codes[keep]]
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        found: dict[int, dict] = defaultdict(dict)
        # a table of 2^16 values tells most shingles at once
        seen = np.zeros(1 << 16, bool)
        seen[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        for size in self.sizes:
            s = shingles(flat, size)
            at = np.flatnonzero(seen[(s >> np.uint64(48)).astype(np.int64)])
            pos = np.searchsorted(self.keys, s[at])
            pos[pos == len(self.keys)] = 0
            at = at[self.keys[pos] == s[at]]
            at = at[text[at] == text[at + size - 1]]
            of, cuts = text[at], np.searchsorted(text[at], np.arange(len(texts) + 1))
            for d in np.unique(of).tolist():
                own = at[cuts[d] : cuts[d + 1]]
                found[d][size] = (s[own], own - ends[d])
        rows = {d: self.matches(flat[ends[d] : ends[d + 1]], known, least) for d, known in found.items()}
        return {d: sorted(x) for d, x in sorted(rows.items()) if x}


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block: int) -> Iterator[tuple]:
    """(name, items, weights) of each block of the benchmark, broadcast. One block at a time is on the driver."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    weights, held, some = context.broadcast(shared_weights(items)), [], False
    for r in items.orderBy("i", "t").toLocalIterator():
        held.append((r.i, r.t))
        if len(held) == block:
            yield uuid.uuid4().hex, context.broadcast(held), weights
            held, some = [], True
    if held or not some:
        yield uuid.uuid4().hex, context.broadcast(held), weights


def _index(name: str, items, weights) -> Index:
    """A block's index, made once in a worker; another block's takes its place."""
    return held(("index", name), lambda: Index(items.value, weights.value))


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY, block: int = 2000) -> DataFrame:
    """(id, item, similarity, first_word, n_words): the best window of each document and item at or over the similarity."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    def against(name: str, items, weights) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(name, items, weights)
            for b in batches:
                start = 0
                for part in slices(b.column(1)):
                    ids = b.column(0).slice(start, len(part)).to_pylist()
                    start += len(part)
                    if out := [(ids[d], *m) for d, found in index.search(part, least).items() for m in found]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["id", "item", "similarity", "first_word", "n_words"])

        return rows.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionAll, [against(*x) for x in _blocks(benchmark, item_col, item_text, block)])


def kept(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY, block: int = 2000) -> DataFrame:
    """The rows, as they are, whose texts hold no item. Each row is judged by its own text, whatever its id is."""
    prepare(df.sparkSession)

    def against(name: str, items, weights):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = _index(name, items, weights)
            for texts in batches:
                clean, start = np.ones(len(texts), bool), 0
                for part in slices(texts):
                    clean[[start + d for d in index.search(part, least)]] = False
                    start += len(part)
                yield pa.array(clean)
            given_back()

        return F.arrow_udf(run, "boolean")

    columns = df.columns
    for x in _blocks(benchmark, item_col, item_text, block):
        rows = df.select(row_of(columns), against(*x)(df[text_col].cast("string")).alias("clean"))
        df = rows.where("clean").select("row.*")
    return df


def op2(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), "first_word", "n_words")
