"""N-gram Jaccard join through a token-group matrix: all links of texts whose shingle sets are similar enough, as components.

1. Partition. At each shingle by which texts can meet, the text that meets the most others is the centre, as an original is
   among its copies. Texts are compared with the centres that they meet most often, and verified links make components. A
   component is a group, and a text without a link joins the group of its first centre. A group of many texts is cut by a
   hash, so that no group is unbounded.
2. Token-group matrix. A group's row is the union of its texts' tokens: exact for the shingles by which texts can meet (the
   first n - ceil(least * n) + 1 in an order common to all texts), and as a cover for all of them, in which a shingle marks
   one of four to eight buckets a shingle. A token that only one group has is left out.
3. Bound. A text and a group with other components meet at a token of both, if some size in the group can be similar. How
   many of the text's shingles can be in the union follows from the covers: the buckets that both mark, and the shingles
   that share a bucket within the text. Where that is less than `least` of the text's shingles, no text of the group can be
   similar, and the group stays closed.
4. Open. A text is compared with the members of other components in the groups that qualify: by sizes and parities where the
   group is opened, so that no pair leaves it that these rule out, then by larger sketches, and what is left is verified
   exactly by the texts themselves. A group that many texts open is opened in several tasks.

No link between different components is lost, so the components are those of all links. Texts of the same words are one
text throughout. Shingles, and the words of a text, are known by 64-bit codes.

Words are what stands between ASCII white space, with A-Z lower-cased; a text with fewer words than a shingle is one
shingle. Defined results: null, empty and blank texts have no shingles and link with nothing, each other included; a row
without an id is linked like any other, and a component's name is the smallest id that its rows have, or null; rows that
repeat an id are texts each; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similar
from .common import by_group, connected_components, given_back, prepare, released, written

#: Centres that a text is compared with at most, those that it meets most often.
FIRST = 3
#: One text in so many is in the sample that tells common shingles (it decides only how much work there is).
SAMPLED = 8
#: Texts of a group at most, about: larger components are cut. Keys of at most so many texts are broadcast (24 bytes each).
GROUP, KEYS = 512, 1_000_000
#: Texts at most, about, that open a group in one task.
ASKING = 65_536
_MARKS = "id long, h long, key long, n int, prefix array<long>, bits binary, wide binary, cover binary"


def cover(own: np.ndarray) -> bytes:
    """Marked buckets of a set: as many buckets as a power of two that is four times its size at least, in the order of the codes."""
    bits = max(9, (4 * len(own) - 1).bit_length())
    marks = np.zeros(1 << bits, bool)
    marks[(own >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def folded(marks: np.ndarray, size: int) -> np.ndarray:
    """The marks over fewer buckets: neighbours make one."""
    return marks if len(marks) == size else marks.reshape(size, -1).any(1)


def _marks(x: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8)).view(bool)


def union(covers: list[bytes]) -> bytes:
    size = 8 * min(map(len, covers))
    return np.packbits(np.logical_or.reduce([folded(_marks(c), size) for c in covers])).tobytes() if len(covers) > 1 else covers[0]


def overlap(n: int, own: bytes, group: bytes) -> int:
    """How many of a set's n members a union of sets can have at most, by their covers."""
    a, b = _marks(own), _marks(group)
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    return int((a & b).sum()) + n - int(a.sum())


def marked(df: DataFrame, size: int, least: float) -> DataFrame:
    """(id, h, key, n, prefix, bits, wide, cover) of rows (id, h, t): code of the text, code of its words, size of its set,
    its first shingles, parities, sketch and cover."""
    prepare(df.sparkSession)
    sample = max(similar.SAMPLE, df.count() // SAMPLED)
    common = df.sparkSession.sparkContext.broadcast(similar.common_shingles(df, "t", size, sample))
    names = [f.split()[0] for f in _MARKS.split(", ")]

    def own(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        from xxhash import xxh64_intdigest

        blank = xxh64_intdigest(b"", 42)  # the code of no words
        for k, s in similar.sets(texts, size):
            yield k, s if k != blank else s[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, len(s), similar.prefix(s, least, *common.value), similar.parities(s), similar.sketch(s), cover(s)) for k, s in own(b.column(2))]
            keys, n, firsts, bits, wide, covers = zip(*found) if found else ((),) * 6
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32()), similar._signed(np.concatenate([*firsts, np.zeros(0, np.uint64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), similar._signed(keys), pa.array(n, pa.int32()), lists, *[pa.array(x, pa.binary()) for x in (bits, wide, covers)]], names)
        given_back()

    return df.select("id", "h", "t").mapInArrow(run, _MARKS)


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, t) of the keys in pairs. Few keys are broadcast, and then no text is sent but theirs."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    keys = written(nodes.select("key", "first.*").join(keys, "key", "left_semi").select("key", F.col("id").alias("i"), F.col("h").alias("g")), "keys")
    own = (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))
    return docs.join(F.broadcast(keys) if keys.count() <= KEYS else keys, own).select("key", "t")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs that are links, written: by their sketches first, then by their texts."""
    near = written(similar.narrowed(pairs, nodes, least), "near")
    return written(similar.verified(near, _texts(docs, nodes, near), size, least), "links")


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, component) of every key, written."""
    parts = connected_components(edges)
    return written(nodes.select("key").join(parts, nodes.key == parts.node, "left").select("key", F.coalesce("component", "key").alias("component")), "parts")


def starred(rows: DataFrame, nodes: DataFrame, least: float, first: int) -> DataFrame:
    """(key, centre, k): texts with the centres that they meet most often, the first one most. rows: (key, g, m), m texts have g."""
    weight = rows.groupBy("key").agg(F.sum("m").alias("weight"))
    met = rows.select("key", "g").join(nodes.select("key", "n").join(weight, "key"), "key")
    centres = met.groupBy("g").agg(F.max(F.struct("weight", "key", "n")).alias("c")).select("g", F.col("c.key").alias("centre"), F.col("c.n").alias("cn"))
    fit = (F.col("key") != F.col("centre")) & (F.least("n", "cn") >= least * F.greatest("n", "cn") - similar._EPS)
    pairs = met.join(centres, "g").where(fit).groupBy("key", "centre").agg(F.count("*").alias("times"))
    k = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("times"), "centre"))
    return pairs.withColumn("k", k).where(F.col("k") <= first).select("key", "centre", "k")


def grouped(nodes: DataFrame, parts: DataFrame, centres: DataFrame, most: int) -> DataFrame:
    """(key, n, component, grp, tile): the group of each key, a component with the texts that are alone near it, or one tile
    of a large one. centres: (key, centre), one row a key."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("m"))
    near = centres.join(parts.select(F.col("key").alias("centre"), F.col("component").alias("near")), "centre").select("key", "near")
    rows = nodes.select("key", "n").join(parts, "key").join(sizes, "component").join(near, "key", "left")
    rows = rows.select("key", "n", "component", F.when(F.col("m") == 1, F.coalesce("near", "component")).otherwise(F.col("component")).alias("grp"))
    tiles = rows.groupBy("grp").agg(F.count("*").alias("m")).where(F.col("m") > most).select("grp", F.ceil(F.col("m") / most).cast("int").alias("s"))
    rows = written(rows, "groups")
    return rows.join(tiles, "grp", "left").select("key", "n", "component", "grp", F.coalesce(F.pmod(F.xxhash64("key"), F.col("s")).cast("int"), F.lit(0)).alias("tile"))


def qualifying(rows: DataFrame, nodes: DataFrame, members: DataFrame, least: float, read: dict | None = None) -> DataFrame:
    """(key, n, component, grp, tile): the groups that each key must open, as they may have similar texts of other components.

    rows: (key, g), the first shingles; members: (key, n, component, grp, tile).
    """
    met = rows.select("key", "g").join(members, "key")
    # tokens of one component have nothing to open
    apart = met.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("g")
    met = written(met.join(apart, "g"), "met")
    step = math.log(1.01 / least)  # sizes that can be similar are one class apart at most
    class_of = lambda n: F.floor(F.ln(n) / step).cast("int")
    matrix = met.groupBy("g", "grp", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("c_lo"), F.max("component").alias("c_hi"))
    matrix = matrix.withColumn("c", F.explode(F.sequence(class_of("lo") - 1, class_of("hi") + 1)))
    asking = met.select("g", class_of("n").alias("c"), "key", "n", "component")
    others = (F.col("component") != F.col("c_lo")) | (F.col("component") != F.col("c_hi"))
    can = others & (F.col("n") >= least * F.col("lo") - similar._EPS) & (F.col("hi") >= least * F.col("n") - similar._EPS)
    pairs = written(asking.join(matrix, ["g", "c"]).where(can).select("key", "component", "grp", "tile").distinct(), "asked")

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["grp", "tile"]):
            at = np.flatnonzero(np.append(True, (np.diff(t.column("grp").to_numpy()) != 0) | (np.diff(t.column("tile").to_numpy()) != 0)))
            covers, ends, first = t.column("cover").to_pylist(), [*at[1:].tolist(), t.num_rows], pa.array(at)
            made = [union(covers[a:z]) for a, z in zip(at.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks().take(first) for c in ("grp", "tile")], pa.array(made, pa.binary())], ["grp", "tile", "union"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, own, both = (b.column(i).to_pylist() for i in (1, 5, 6))
            ok = [overlap(m, x, u) >= least * m - similar._EPS for m, x, u in zip(n, own, both)]
            yield pa.RecordBatch.from_arrays(b.columns[:5], ["key", "n", "component", "grp", "tile"]).filter(pa.array(ok, pa.bool_()))

    groups = members.join(pairs.select("grp", "tile").distinct(), ["grp", "tile"], "left_semi")
    groups = groups.join(nodes.select("key", "cover"), "key").select("grp", "tile", "cover")
    matrix = groups.repartition("grp", "tile").sortWithinPartitions("grp", "tile").mapInArrow(unions, "grp long, tile int, union binary")
    asked = pairs.join(nodes.select("key", "n", F.col("cover").alias("own")), "key").join(matrix, ["grp", "tile"])
    found = written(asked.select("key", "n", "component", "grp", "tile", "own", "union").mapInArrow(bound, "key long, n int, component long, grp long, tile int"), "qualifying")
    if read is not None:
        read.update(asked=pairs.count(), opened=found.count())
    released(met, pairs)
    return found


def opened(found: DataFrame, nodes: DataFrame, members: DataFrame, least: float, asking: int = ASKING) -> DataFrame:
    """(a, b): pairs of keys of different components, from the groups that qualify, that sizes and parities leave possible."""
    parts = found.groupBy("grp", "tile").agg(F.ceil(F.count("*") / asking).cast("int").alias("s"))
    bits = nodes.select("key", "bits")
    columns = ["grp", "tile", "part", "side", "key", "n", "component", "bits"]
    inside = members.join(parts, ["grp", "tile"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("side", F.lit(0))
    outside = found.join(parts, ["grp", "tile"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("s")).cast("int")).withColumn("side", F.lit(1))
    rows = inside.join(bits, "key").select(columns).unionAll(outside.join(bits, "key").select(columns))
    most = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, own = None, [], None
        for batch in batches:
            name = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((np.diff(name, axis=0) != 0).any(1)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                if tuple(name[start, :3]) != group:
                    group, held, own = tuple(name[start, :3]), [], None
                part = _columns(batch.slice(start, stop - start))
                if name[start, 3] == 0:
                    held.append(part)
                    continue
                own = [np.concatenate(c) for c in zip(*held)] if own is None else own
                for i in range(0, stop - start, 1024):
                    x, y = possible(own, [c[i : i + 1024] for c in part], least, most)
                    if len(x):
                        a, b = own[0][x], part[0][i + y]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rows = rows.repartition("grp", "tile", "part").sortWithinPartitions("grp", "tile", "part", "side")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    """Keys, sizes, components and parities of the rows of a group."""
    return [*[b.column(i).to_numpy() for i in (4, 5, 6)], np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(b.num_rows, -1)]


def possible(x: list[np.ndarray], y: list[np.ndarray], least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs whose sets can be similar, by components, sizes and parities, which come word by word."""
    n, m = x[1][:, None], y[1][None, :]
    i, j = np.nonzero((x[2][:, None] != y[2][None, :]) & (np.minimum(n, m) >= least * np.maximum(n, m) - similar._EPS))
    limit, apart = most * (x[1][i] + y[1][j]) + similar._EPS, np.zeros(len(i), np.int64)
    for k in range(x[3].shape[1]):
        apart += np.bitwise_count(x[3][i, k] ^ y[3][j, k])
        ok = apart <= limit
        i, j, limit, apart = i[ok], j[ok], limit[ok], apart[ok]
    return i, j


def joined(df: DataFrame, id_col: str, text_col: str, size: int = similar.SIZE, least: float = similar.LEAST, group: int = GROUP, first: int = FIRST, read: dict | None = None) -> DataFrame:
    """(id long, n_shingles long, component_id long): component_id is the smallest id reachable over links, the row's own
    included.

    read: if given, gets how many pairs of a text and a group met, and how many of them were opened.
    """
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    marks = written(marked(docs, size, least), "marks")
    real = marks.where("n > 0")
    some = [F.first(c).alias(c) for c in ("n", "bits", "wide", "cover")]
    nodes = written(real.groupBy("key").agg(*some, F.min(F.struct("h", "id")).alias("first"), F.min("id").alias("id")), "nodes")
    rows = real.select("key", "prefix").dropDuplicates(["key"]).select("key", F.explode("prefix").alias("g"))
    shared = rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    rows = written(rows.join(shared, "g"), "meetings")
    # partition
    centres = written(starred(rows, nodes, least, first), "centres")
    pairs = centres.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    edges = _linked(pairs, docs, nodes, size, least)
    parts = _named(edges, nodes)
    # matrix, bound and open
    members = written(grouped(nodes, parts, centres.where("k = 1"), group), "members")
    found = qualifying(rows, nodes, members, least, read)
    if found.limit(1).count():
        more = _linked(opened(found, nodes, members, least), docs, nodes, size, least)
        if more.limit(1).count():
            parts = _named(edges.unionAll(more), nodes)
    released(rows)
    names = parts.join(nodes.select("key", "id"), "key").groupBy("component").agg(F.min("id").alias("component_id"))
    names = written(parts.join(names, "component").select("key", "component_id"), "names")
    out = real.select("id", "key", F.col("n").cast("long").alias("n_shingles")).join(names, "key").select("id", "n_shingles", "component_id")
    return out.unionAll(marks.where("n = 0").select("id", F.lit(0).cast("long"), F.col("id")))


def op11(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")


SQL = r"""
    WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w),
    u AS MATERIALIZED (SELECT r, len(g) AS n, hash(unnest(g)) AS h FROM s),
    p AS (SELECT a.r AS a, b.r AS b, a.n AS n, b.n AS m, count(*) AS x FROM u a JOIN u b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * x >= 80 * (n + m - x) UNION SELECT b, a FROM p WHERE 100 * x >= 80 * (n + m - x)),
    c AS (SELECT DISTINCT a AS r, a AS o FROM e UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.o)
    SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(f.component_id, doc_id) AS component_id FROM s LEFT JOIN (SELECT c.r, min(doc_id) AS component_id FROM c JOIN s ON s.r = c.o GROUP BY c.r) f USING (r)"""
