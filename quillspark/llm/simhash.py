"""SimHash near-duplicate detection with pivot distance tables.

A fingerprint bit is set if it is set in over half of the XXH64 values (seed 42) of a text's word shingles. Two
fingerprints link if they differ in at most `radius` bits. Links are found without comparing all pairs:

* equal fingerprints are put together first, so copies cost nothing;
* the 64 bits are cut into radius + 2 blocks: two fingerprints within the radius agree on at least two blocks, so only
  fingerprints that share the bits of some two blocks meet (a lossless partition);
* where they meet, a pivot table holds each fingerprint's Hamming distances to fixed reference fingerprints. By the
  triangle inequality a pair whose tables differ by more than the radius in any coordinate is discarded; survivors are
  verified bit by bit;
* a block value with very many fingerprints is cut into tiles, and every pair of tiles is a task of its own;
* each tile gives a spanning forest, never all its pairs.

Defined results: null and empty texts have the fingerprint zero and link to each other; repeated rows share a
component; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import by_group, connected_components, prepare, row_of, written

PIVOTS = 16
#: Differing bits within which the pipeline's stage takes texts for near and compares their shingles.
STAGE_RADIUS = 5
TILE = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(data: bytes, size: int = 3) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned integer."""
    from xxhash import xxh64_intdigest as h

    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= size:
        return h(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = n - size + 1
    hashes = np.fromiter([h(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), ends[size - 1 :].tolist())], np.uint64, k)
    octets = hashes.astype("<u8").view(np.uint8).reshape(k, 8)
    if k < 1500:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(ones * 2 > k, bitorder="little").view("<u8")[0])


def prints(texts: pa.Array, size: int) -> pa.Array:
    """The texts' fingerprints, as signed integers."""
    return pa.array(np.fromiter((fingerprint(x.as_py() or b"", size) for x in texts.cast(pa.binary())), np.uint64, len(texts)).view(np.int64))


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    """(id long, fp long): the fingerprint's 64 bits as a signed integer."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), prints(b.column(1), size)], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


def _marked(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """(row, key): each row as a struct, with its fingerprint. Only texts go to Python, only fingerprints come back."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield prints(texts, size)

    return df.select(row_of(df.columns), F.arrow_udf(run, "long")(df[text_col].cast("string").cast("binary")).alias("key"))


def _pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def forest(fp: np.ndarray, group: np.ndarray, radius: int, part: np.ndarray | None = None, seen: list | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the links inside each group; rows of a group are adjacent.

    part: if given, rows of the same part (0 or more) are not compared, as they meet elsewhere. seen: if given, gets the
    number of pairs that met, that the pivots left, and that are links.
    """
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ _pivots()[None, :]).astype(np.int8)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    at = np.arange(n)
    step = 1
    while True:
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return links
        i, j = at, at + step
        if part is not None:
            apart = (part[i] != part[j]) | (part[i] < 0)
            i, j = i[apart], j[apart]
        met = len(i)
        for c in (slice(0, 2), slice(2, 6), slice(6, PIVOTS)):
            near = (np.abs(table[i, c] - table[j, c]) <= radius).all(1)
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        if seen is not None:
            seen.append((met, len(i), int(near.sum())))
        i, j = i[near], j[near]
        if len(i):
            root = parent.copy()
            while (root[root] != root).any():
                root = root[root]
            parent[:] = root
            apart = root[i] != root[j]
            for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((x, y))
        step += 1


def links(nodes: DataFrame, radius: int = 3, bits: int = 64, tile: int = TILE) -> DataFrame:
    """(a long, b long): ids of nodes (id long, fp long; fp distinct) whose links connect all that lie within the radius."""
    prepare(nodes.sparkSession)
    blocks = radius + 2
    cuts = [round(bits * i / blocks) for i in range(blocks + 1)]
    bits_of = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftleft(bits_of[x], 32).bitwiseOR(bits_of[y]).alias("v")) for k, (x, y) in enumerate(combinations(range(blocks), 2))])
    rows = nodes.select("id", "fp", F.explode(keys).alias("key")).select("id", "fp", "key.k", "key.v")
    columns = ["id", "fp", "k", "v", "i", "j", "part"]
    large = rows.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = written(large.select("k", "v", F.ceil(F.col("n") / tile).cast("int").alias("s")), "large")
    # a value of few fingerprints is one task's, and its rows are sent once; one of many is cut
    few = rows.join(large, ["k", "v"], "left_anti").withColumns({"i": F.lit(0), "j": F.lit(0), "part": F.lit(-1)}).select(columns)
    few = few.repartition("k", "v").sortWithinPartitions("k", "v")
    rows = rows.join(large, ["k", "v"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    part = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))  # two tiles compare across only
    # a row whose own tile is i comes to every pair of tiles that has i
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "part": part}).select(columns)
    rows = rows.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["k", "v", "i", "j"]):
            cols = [t.column(c).to_numpy() for c in ("k", "v", "i", "j")]
            change = np.ones(t.num_rows + 1, bool)
            change[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            met = np.flatnonzero(~(change[:-1] & change[1:]))  # what stands alone meets nothing
            if not len(met):
                continue
            ids, fp, part = (t.column(c).to_numpy()[met] for c in ("id", "fp", "part"))
            found = forest(fp.view(np.uint64), np.cumsum(change[:-1])[met], radius, part)
            if found:
                pairs = ids[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    pairs = few.mapInArrow(run, "a long, b long")
    if large.limit(1).count():
        pairs = pairs.unionAll(rows.mapInArrow(run, "a long, b long"))
    return pairs


def near_pairs(nodes: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """(a, b): pairs of keys that connect all nodes (key long, fp long) whose fingerprints lie within the radius. Keys with
    equal fingerprints go to the smallest of them, which stands for them in the search by blocks and pivots."""
    firsts = written(nodes.groupBy("fp").agg(F.min("key").alias("id")).select("id", "fp"), "fingerprints")
    equal = nodes.join(firsts, "fp").where("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    return equal.unionAll(links(firsts, radius))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, size: int = 3, radius: int = 3) -> DataFrame:
    """(id long, fp long, component long): component is the smallest id reachable over links, the row's own included.

    A row without an id links like any other; a component whose rows all have none has a null name."""
    marks = written(fingerprints(df, id_col, text_col, size), "fingerprints")
    # a fingerprint names its node, so that rows without an id link like any other
    nodes = written(marks.groupBy("fp").agg(F.min("id").alias("least")).select(F.col("fp").alias("id"), "fp", "least"), "nodes")
    parts = connected_components(links(nodes.select("id", "fp"), radius))
    parts = nodes.join(parts, nodes.id == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    names = parts.groupBy("part").agg(F.min("least").alias("component"))
    named = parts.join(names, "part").select("fp", "component")
    return marks.join(named, "fp").select("id", "fp", "component")


def kept(df: DataFrame, id_col: str, text_col: str, size: int = 3, radius: int = 3, least: float | None = None) -> DataFrame:
    """The rows, as they are, that stand for their group: one row of each component, the one with the smallest id.

    least: if given, texts whose fingerprints lie within STAGE_RADIUS are found by blocks and pivots, and link if the exact
    Jaccard similarity of their shingles is at least that. As similar texts may differ in more bits, texts still apart are then
    compared where they share a rare shingle (similar.py), so that no link is lost. Rows are known by id and fingerprint (or code of the words): a null id comes after all others, so a row without an id stands
    for its group only where no row has one; of rows with the same id, the smallest fingerprint stands first.
    """
    if least is None:
        marks = written(_marked(df, text_col, size), "marks")
        nodes = marks.select(F.col("key").alias("fp")).distinct().select(F.col("fp").alias("id"), "fp")
        found = connected_components(links(written(nodes, "nodes"), radius))
        parts = nodes.join(found, nodes.id == found.node, "left").select(F.col("fp").alias("key"), F.coalesce("component", "id").alias("component"))
    else:
        marks = written(similar.marked(df, text_col, size, least, prints), "marks")
        # the words of a key are the same, so is their fingerprint
        near = near_pairs(written(marks.groupBy("key").agg(F.min("fp").alias("fp")), "nodes"))
        parts = similar.components(marks, text_col, size, least, near=near)
    rows = marks.select(F.col(f"row.`{id_col}`").alias("id"), "key", "row")
    first = rows.join(parts, "key").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    first = written(first.select("first.id", "first.key"), "firsts")  # a component's first row, once each
    chosen = rows.join(first.select(F.col("id").alias("first_id"), F.col("key").alias("first_key")), F.col("key").eqNullSafe(F.col("first_key")) & F.col("id").eqNullSafe(F.col("first_id")))
    if rows.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():  # only where rows repeat
        chosen = chosen.dropDuplicates(["first_id", "first_key"])
    return chosen.select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
