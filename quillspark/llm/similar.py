"""Near copies by the exact Jaccard similarity of word shingles, with an exact prefix filter.

Two texts link if the sets of their word shingles have a Jaccard similarity of at least `least`. Links are found without
comparing all pairs, and none is lost:

* texts of the same words are put together first, so copies cost nothing;
* shingles have one order for all texts, the most common last (a sample of the texts tells which; it decides only how much
  work there is). Texts that are similar enough share one of their first n - ceil(least * n) + 1 shingles in that order;
* where texts meet at a shingle, the sizes and the 512 parities of their sets bound the similarity from above; for pairs
  under that bound a sketch of two to four parities a shingle gives a closer one, before any text is sent;
* first each text is compared with one other text at a shingle. Then all pairs that these links leave apart are compared
  where they meet. A shingle with very many texts is cut into tiles, and every pair of tiles is a task of its own;
* pairs under no bound are verified by the sets themselves.

Words are lower-cased in ASCII and split at ASCII white space; a text shorter than a shingle is one shingle. Defined
results: null, empty and blank texts link to each other and to nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import coded, slices
from .common import by_group, connected_components, given_back, let_go, prepare, released, row_of, written
from .decontaminate import _mix, shingles, word_codes

SIZE, LEAST = 5, 0.8
TILE = 1024
#: Texts in the sample, and at most so many common shingles (16 bytes each) that are broadcast.
SAMPLE, COMMON = 8_000, 200_000
#: Texts that each text is compared with before all others.
FIRST = 8
_EPS = 1e-9


def sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(code of the words, sorted shingle codes) of each text."""
    from xxhash import xxh64_intdigest as h

    for part in slices(texts):
        codes, borders, pieces = coded(pc.ascii_lower(pc.fill_null(part, "")))
        flat = word_codes(pieces)[codes] if len(pieces) else np.zeros(0, np.uint64)
        runs = shingles(flat, size)
        blank = pieces.index("") if "" in pieces else -1
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if b - a == 1 and codes[a] == blank:
                b = a
            own = runs[a : b - size + 1] if b - a >= size else shingles(flat[a:b], b - a)
            yield h(flat[a:b].tobytes(), 42), np.unique(own)


def prefix(own: np.ndarray, least: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all texts: those that the sample does not have often, then the rarest."""
    n = len(own)
    if not n:
        return own
    if len(common):
        pos = np.searchsorted(common, own)
        pos[pos == len(common)] = 0
        own = own[np.argsort(np.where(common[pos] == own, times[pos], 0), kind="stable")]
    return own[: n - math.ceil(least * n - _EPS) + 1]


def parities(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=512) & 1).tobytes()


def sketch(own: np.ndarray) -> bytes:
    """Parities of a set, as many as a power of two that is twice its size at least, in the order of the codes."""
    bits = max(9, (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def differences(x: bytes, y: bytes) -> int:
    """How many members two sets differ in at least, by their sketches. Two neighbouring parities make one of half the size."""
    a, b = sorted((np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))), key=len)
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(len(a), -1), 1)
    return int((a ^ b).sum())


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def common_shingles(df: DataFrame, text_col: str, size: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes, texts of the sample that have each) of the shingles that the sample has most often."""
    every = max(1, df.count() // sample)
    texts = df.select(F.col(text_col).cast("string").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, own in sets(b.column(0), size):
                yield pa.RecordBatch.from_arrays([_signed(own)], ["g"])

    often = texts.mapInArrow(run, "g long").groupBy("g").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "g").limit(COMMON)
    rows = sorted((r.g % (1 << 64), r.n) for r in often.collect())
    return np.array([g for g, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)


def marked(df: DataFrame, text_col: str, size: int, least: float, prints: Callable[[pa.Array, int], pa.Array] | None = None) -> DataFrame:
    """(row, key, n, prefix, bits, wide): each row as a struct, the code of its words, its set's size, prefix, parities and
    sketch. prints: if given, makes one more column, fp, of the texts in the same pass: a second Python step would hold a
    second worker beside each task's own."""
    prepare(df.sparkSession)
    common = df.sparkSession.sparkContext.broadcast(common_shingles(df, text_col, size))

    kinds = {"key": "long", "n": "int", "prefix": "array<long>", "bits": "binary", "wide": "binary"} | ({"fp": "long"} if prints else {})

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        yield from map(mark, batches)
        given_back()

    def mark(texts: pa.Array) -> pa.Array:
        found = [(k, len(s), prefix(s, least, *common.value), parities(s), sketch(s)) for k, s in sets(texts, size)]
        keys, n, firsts, bits, wide = zip(*found) if found else ((), (), (), (), ())
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), _signed(np.concatenate([*firsts, np.zeros(0, np.uint64)])))
        more = [prints(texts, size)] if prints else []
        return pa.StructArray.from_arrays([_signed(keys), pa.array(n, pa.int32()), lists, pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), *more], list(kinds))

    # only texts go to Python and only marks come back; the rows wait in the JVM
    marks = F.arrow_udf(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))(df[text_col].cast("string"))
    return df.select(row_of(df.columns), marks.alias("mark")).select("row", "mark.*")


def candidates(rows: DataFrame, least: float, star: bool, tile: int = TILE) -> DataFrame:
    """(a, b): keys that meet at a shingle g, are of different components and may be similar enough; a < b, each pair once.

    rows: (key, n, component, bits, g). star: only pairs with one text of each shingle and tile.
    """
    prepare(rows.sparkSession)
    met = rows.groupBy("g").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    large = written(met.where(f"m > {tile}").select("g", F.ceil(F.col("m") / tile).cast("int").alias("s"), F.expr("lo <> hi").alias("apart")), "large")
    columns = ["key", "n", "component", "bits", "own", "g", "i", "j"]
    # a shingle of few texts is one task's, and its rows are sent once; one of many is cut
    few = rows.join(large, "g", "left_anti").select("*", *[F.lit(0).alias(c) for c in ("own", "i", "j")]).select(columns)
    few = few.repartition("g").sortWithinPartitions("g")
    rows = rows.join(large.where("apart"), "g").withColumn("own", F.pmod(F.xxhash64("key"), F.col("s")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(columns)
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    most = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["g", "i", "j"]):
            key, n, comp, own, g, i, j = (t.column(c).to_numpy() for c in ("key", "n", "component", "own", "g", "i", "j"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, 8)
            change = np.zeros(t.num_rows, np.int64)
            for c in (g, i, j):
                change[1:] |= c[1:] != c[:-1]
            group = np.cumsum(change)
            starts = np.flatnonzero(np.append(1, change[1:]))
            # texts that are of one component already have nothing to compare
            apart = (np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts))[group]
            if not apart.any():
                continue
            key, n, comp, own, g, i, j, bits, group = (x[apart] for x in (key, n, comp, own, g, i, j, bits, group))
            group = np.unique(group, return_inverse=True)[1]

            def near(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
                ok = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - _EPS)
                x, y = x[ok], y[ok]
                ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most * (n[x] + n[y]) + _EPS
                a, b = key[x[ok]], key[y[ok]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

            if star:
                order = np.lexsort((_mix((key ^ g).view(np.uint64)), group))
                hub = order[np.searchsorted(group, np.arange(group[-1] + 1))]
                yield from near(np.arange(len(group)), hub[group])
                continue
            at = np.arange(len(group))
            step = 1
            while True:
                at = at[at + step < len(group)]
                at = at[group[at] == group[at + step]]
                if not len(at):
                    break
                # pairs inside a tile are compared where the tile meets itself
                fresh = at[(i[at] == j[at]) | (own[at] != own[at + step])]
                yield from near(fresh, fresh + step)
                step += 1

    pairs = few.mapInArrow(run, "a long, b long")
    if large.where("apart").limit(1).count():
        pairs = pairs.unionAll(rows.mapInArrow(run, "a long, b long"))
    return pairs.distinct()


def narrowed(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs that their sketches leave possible. nodes: (key, n, wide)."""
    most = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, m, x, y = (col.to_pylist() for col in b.columns)
            ok = [differences(u, v) <= most * (p + q) + _EPS for p, q, u, v in zip(n, m, x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k, n, w: nodes.select(F.col("key").alias(k), F.col("n").alias(n), F.col("wide").alias(w))
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs whose sets are similar enough. texts: (key, t). Texts travel, not their sets, which are longer."""
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    keys = written(keys, "keys")  # so that its size is known: if small, no text is sent but theirs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(*(map(itemgetter(1), sets(b.column(i), size)) for i in (2, 3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - _EPS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # one shuffle by key serves both sides
    texts = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.min("t").alias("t"))
    side = lambda k, t: texts.select(F.col("key").alias(k), F.col("t").alias(t))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(marks: DataFrame, text_col: str, size: int = SIZE, least: float = LEAST, tile: int = TILE, first: int = FIRST, near: DataFrame | None = None) -> DataFrame:
    """(key, component): each key of marked rows, with the smallest key that it reaches over links.

    near: if given, pairs (a, b) that are compared first, before any that share a shingle."""
    nodes = written(marks.groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")), "nodes")
    texts = marks.select("key", F.col(f"row.`{text_col}`").cast("string").alias("t"))
    rows = marks.select("key", "prefix").dropDuplicates(["key"]).select("key", F.explode("prefix").alias("g"))
    rows = rows.withColumn("m", F.count("*").over(Window.partitionBy("g"))).where("m > 1").drop("m")
    rows = written(rows.join(nodes.drop("wide"), "key"), "meetings")

    def named(edges: DataFrame) -> DataFrame:
        parts = connected_components(edges)
        return nodes.select("key").join(parts, nodes.key == parts.node, "left").select("key", F.coalesce("component", "key").alias("component"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among at most `first` pairs of each key; the others come with all that is left."""
        k = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))
        some = written(pairs.withColumn("k", k).where(F.col("k") <= first).select("a", "b"), "pairs")
        close = written(narrowed(some, nodes, least), "pairs")
        out = written(verified(close, texts, size, least), "links")
        released(some, close)
        return out

    parts, edges = nodes.select("key", F.col("key").alias("component")), None
    if near is not None:
        edges = linked(near.where("a <> b").distinct())
        parts = written(named(edges), "parts")
    more = linked(candidates(rows.join(parts, "key"), least, True, tile))
    edges = more if edges is None else edges.unionAll(more)
    parts = written(named(edges), "parts")
    rest = written(narrowed(candidates(rows.join(parts, "key"), least, False, tile), nodes, least), "pairs")
    released(rows)
    if rest.limit(1).count():
        edges = edges.unionAll(written(verified(rest, texts, size, least), "links"))
        parts = written(named(edges), "parts")
    released(nodes, rest)
    return parts
