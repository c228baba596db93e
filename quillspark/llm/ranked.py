"""Ranked lexical search: exact top-k documents of each item, from postings in order of impact, score at a time.

Documents become an index of the items' terms: a row a document with its terms' codes and frequencies. Document counts of
terms follow from it, and with them every posting's impact, a whole number. A task goes through the index in blocks of
documents. In a block each term's postings are ordered by impact; an item's postings are processed in descending order of
what they add to a score, down to a level at a time, all postings of one impact together. What a term's next posting adds
bounds what any document can still gain by it. An item stops in a block only when the bounds prove that no document outside
a small set can be among the k best; the scores of that set are then completed from the documents' own rows. The k-th best
score so far goes on from block to block; a first pass over a small share of the documents gives every task a score to
begin with, which costs no result, as any k documents' scores bound the k-th best of all from below.

Tasks keep k documents an item, and these are ranked in the end. Items come to the tasks in blocks of a bounded size; what
grows with the data is only read by tasks. The k-th best of all is exact: nothing is capped or sampled.

Defined results: null and blank texts have no terms, but no effect on the counts either; an item that is null or has no
terms, or whose terms occur nowhere, gives no rows; an item's repeated terms count each time; rows that repeat a document's
id are documents each; rows without an id rank after others of the same score; items that repeat an id are items each;
fewer matches than k give fewer rows; empty tables give no rows. Scores that could leave 64 bits raise an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import given_back, prepare, released, written

BEST = 20
#: Documents and postings of a block at most (a document is never cut), and open documents with which an item may stop.
BLOCK, POSTINGS, FEW = 16_384, 4_000_000, 256
#: Bytes of item text at most that go to the tasks at once; more items are further blocks, each with an index of its terms.
ITEM_BYTES = 16_000_000
#: One document in so many is searched first.
SHARE = 64
#: Letters, digits and what is outside ASCII make terms; only A-Z are lower-cased.
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_BYTES = np.array([b + 32 if 65 <= b < 91 else b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256)], np.uint8)
_INDEX = "id long, n long, terms array<int>, times array<int>"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


def counted(texts: pa.Array, codes: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms with repeats of each text, borders, codes of the known terms, how often each) of runs of texts."""
    known = pa.array(list(codes), pa.string())
    for part in slices(texts):
        part = pc.fill_null(part, "")
        part = part.take(pa.array(np.arange(len(part)))) if part.offset else part
        _, offsets, data = part.buffers()
        clean = _BYTES[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
        plain = pa.StringArray.from_buffers(len(part), offsets, pa.py_buffer(clean))
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
        borders = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        own = pc.fill_null(pc.index_in(flat.dictionary, known), -1).to_numpy()[flat.indices.to_numpy()] if len(known) else np.full(len(flat), -1)
        blank = flat.dictionary.index("").as_py() if len(flat.dictionary) else -1
        text = np.repeat(np.arange(len(part)), np.diff(borders))
        real = flat.indices.to_numpy() != blank
        n = np.bincount(text[real], minlength=len(part))
        hit = own >= 0
        pair, times = np.unique(text[hit] * max(1, len(known)) + own[hit], return_counts=True)
        text, own = np.divmod(pair, max(1, len(known)))
        yield n, np.searchsorted(text, np.arange(len(part) + 1)), own, times


def index(docs: DataFrame, id_col: str, text_col: str, codes: dict[str, int]) -> DataFrame:
    """(id, n, terms, times): a row a document that has terms: how many it has, the known ones' codes and how often each."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = 0
            for n, borders, own, times in counted(b.column(1), vocabulary.value):
                lists = [pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(x, pa.int32())) for x in (own, times)]
                rows = pa.RecordBatch.from_arrays([b.column(0).slice(start, len(n)), pa.array(n), *lists], ["id", "n", "terms", "times"])
                yield rows.filter(pa.array(n > 0))
                start += len(n)
        given_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _INDEX)


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


class Block:
    """Some documents: their rows, and each term's postings in order of impact."""

    def __init__(self, n: np.ndarray, borders: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, total: int) -> None:
        self.size, self.borders, self.terms = len(n), borders, terms
        wide = 25 * int(n.max(initial=0)) * documents >= 1 << 63
        size = np.array([25 * x * documents // total for x in n.tolist()], np.int64) if wide else 25 * n * documents // total
        doc = np.repeat(np.arange(len(n)), np.diff(borders))
        if int(times.max(initial=0)) * 10**9 >= 1 << 63:
            raise OverflowError("scores may not fit in 64 bits")
        self.impact = weights[terms] * ((10**9 * times) // (1000 * times + 12 * (75 + size)[doc]))
        order = np.lexsort((-self.impact, terms))
        self.docs, self.steps = doc[order].astype(np.int32), self.impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.falling = -self.steps  # ascending within each term

    def search(self, item: tuple[np.ndarray, np.ndarray], k: int, floor: int, few: int = FEW, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the k best of the block with a score of at least `floor`, and others that have the k-th score.

        item: (terms, how often each). read: if given, gets (postings read, postings there, documents completed).
        """
        terms, often = item
        a, z = self.starts[terms], self.starts[terms + 1]
        there = z > a
        terms, often, a, z = terms[there], often[there], a[there], z[there]
        none = np.zeros(0, np.int64)
        if not len(terms):
            return none, none
        first, at = a, a.copy()
        score = np.zeros(self.size, np.int64)
        left = often * self.steps[a]
        level = int(left.max())
        if int(left.sum()) < floor:  # no document of the block can get there
            if read is not None:
                read.append((0, int((z - a).sum()), 0))
            return none, none
        while True:
            level = level // 2
            for i in np.flatnonzero((at < z) & (left > level)):
                least = level // int(often[i]) + 1  # the smallest impact above the level
                stop = int(at[i] + np.searchsorted(self.falling[at[i] : z[i]], -least, "right"))
                score[self.docs[at[i] : stop]] += often[i] * self.steps[at[i] : stop]  # a document is once in a list
                at[i] = stop
                left[i] = often[i] * self.steps[stop] if stop < z[i] else 0
            rest = int(left.sum())
            reach = max(floor, int(np.partition(score, self.size - k)[self.size - k]) if self.size > k else 0, 1)
            open_ = np.flatnonzero(score >= reach - rest)
            if not rest or len(open_) <= max(few, k):
                break
        if rest:  # the bounds prove that only these can be among the best: their scores are completed
            amount = np.zeros(len(self.starts) - 1, np.int64)
            amount[terms] = often
            sizes = self.borders[open_ + 1] - self.borders[open_]
            rows = np.repeat(self.borders[open_] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            full = np.zeros(len(open_), np.int64)
            np.add.at(full, np.repeat(np.arange(len(open_)), sizes), amount[self.terms[rows]] * self.impact[rows])
        else:
            full = score[open_]
        if read is not None:
            read.append((int((at - first).sum()), int((z - first).sum()), len(open_) if rest else 0))
        reach = max(floor, int(np.partition(full, len(full) - k)[len(full) - k]) if len(full) > k else 0, 1)
        keep = full >= reach
        return open_[keep], full[keep]


class Best:
    """The k best documents so far of one item, as (score, without id, id)."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.rows, self.floor = k, [], floor

    def add(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.rows += zip(scores[order].tolist(), none[order].tolist(), ids[order].tolist())
        self.rows = sorted(self.rows, key=lambda r: (-r[0], r[1], r[2]))[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, self.rows[-1][0])


def _found(rows: DataFrame, items: list, weights: np.ndarray, documents: int, total: int, k: int, floors: np.ndarray) -> DataFrame:
    """(q int, id, score): each task's k best of each item. items: (terms, how often each) of item q."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = shared.value
        best = [Best(k, int(f)) for f in floors]
        held, n_rows, n_postings = [], 0, 0

        def search() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("id")
            none, ids = pc.is_null(ids).to_numpy(), pc.fill_null(ids, 0).to_numpy()
            lists = [t.column(c).combine_chunks() for c in ("terms", "times")]
            borders = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())]).astype(np.int64)
            block = Block(t.column("n").to_numpy(), borders, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().astype(np.int64), weights, documents, total)
            for q, item in enumerate(items):
                docs, scores = block.search(item, k, best[q].floor)
                if len(docs):
                    best[q].add(scores, none[docs], ids[docs])

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                held.append(part)
                n_rows += part.num_rows
                n_postings += len(part.column(2).flatten())
                if n_rows >= BLOCK or n_postings >= POSTINGS:
                    search()
                    held, n_rows, n_postings = [], 0, 0
        if held:
            search()
        for q, b in enumerate(best):
            if b.rows:
                scores, none, ids = zip(*b.rows)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int32()), pa.array([None if x else i for x, i in zip(none, ids)], pa.int64()), pa.array(scores, pa.int64())], ["q", "id", "score"])
        given_back()

    return rows.mapInArrow(run, "q int, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, k: int = BEST, item_bytes: int = ITEM_BYTES, share: int = SHARE) -> DataFrame:
    """(item_id, rank int, doc_id long, score long): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    prepare(spark)
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    texts = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("t"))
    for block in _blocks(texts, item_bytes):
        part = _ranked(docs, [(i, Counter(terms_of(t))) for i, t in block], kind, id_col, text_col, k, share)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _blocks(texts: DataFrame, most: int) -> Iterator[list]:
    """The items, a block of bounded size at a time on the driver."""
    held, size = [], 0
    for r in texts.where("t IS NOT NULL").sort("item_id", "t").toLocalIterator():
        if held and size + len(r.t) > most:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.t))
        size += len(r.t)
    if held:
        yield held


def _ranked(docs: DataFrame, items: list, kind: str, id_col: str, text_col: str, k: int, share: int) -> DataFrame:
    spark = docs.sparkSession
    codes = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in items))))}
    rows = written(index(docs, id_col, text_col, codes), "postings")
    documents, total = rows.agg(F.count("*"), F.sum("n")).first()
    having = np.zeros(len(codes), np.int64)
    if documents:
        for r in rows.select(F.explode("terms").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect():  # as many as terms
            having[r.c] = r.n
    weights = np.array([weight(documents, h) for h in having.tolist()], np.int64)
    queries = [(np.array([codes[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in items]
    if any(int((weights[t] * often).sum()) * 10**6 >= 1 << 63 for t, often in queries):
        raise OverflowError("scores may not fit in 64 bits")
    floors = np.ones(len(items), np.int64)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = lambda part: _found(part, queries, weights, documents, total, k, floors).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if documents > share * k:
        sample = rows.where(F.pmod(F.xxhash64("id", "n"), F.lit(share)) == 0)
        for r in best(sample).where(F.col("rank") == k).collect():  # one row an item at most
            floors[r.q] = r.score
    found = written(best(rows), "ranked")
    released(rows)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"q int, item_id {kind}")
    return found.join(names, "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, items, "doc_id", "text", "item_id", "text")


SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    l AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
    a AS (SELECT CAST(count(*) AS BIGINT) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM l),
    i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    iq AS (SELECT q, item_id, t, count(*) AS often FROM i GROUP BY ALL),
    p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM l) WHERE t IN (SELECT t FROM iq) GROUP BY ALL),
    w AS (SELECT t, CAST(floor(1000 * ln((2 * N_ + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), a),
    c AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * N_) // L_))) AS impact FROM p JOIN w USING (t), a),
    s AS (SELECT q, item_id, r, doc_id, CAST(sum(often * impact) AS BIGINT) AS score FROM iq JOIN c USING (t) GROUP BY ALL),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""
