"""Token-id output as Re-Pair grammars.

Ids are cut into segments in ascending document order. In each segment the most frequent neighbouring pairs are replaced
by new symbols, again and again; the segment keeps the rules, the length that each rule expands to, and what is left.
A range of ids is decoded by finding its first symbol in the sums of the expansion lengths and expanding from there.

A segment's payload is: the magic "RPG1"; four little-endian 64-bit integers (first rule symbol, rules, symbols, ids);
one byte, the symbol's width (2 or 4); the rules' pairs; their expansion lengths (32-bit); the symbols.

Defined results: null and empty texts have only the end id; repeated document ids follow each other in one order
within a run; a null document id comes first and is returned as null; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _COMMON, Cache, coded, default_vocabulary, gathered, slices
from .common import given_back, prepare, shared_dir

SEGMENT = 1 << 20
MOST, LEAST = 4000, 12
#: Words of unusual pieces that a worker keeps the ids of (two generations, some 100 bytes each), also for its next task; and
#: bytes of texts that are encoded together.
PIECES, GATHER = 250_000, 32_000_000
_NULL = -(1 << 63)
#: Letters that no Unicode version changes and that are their own NFC; a piece of them is one word.
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u017e]"
_WORD, _WORD_AND_SIGNS = f"^{_LETTERS}+$", f"^(?P<word>{_LETTERS}+)(?P<signs>[!-/:-@\\[-`{{-~]+|[0-9])$"


def _mixed(codes: np.ndarray) -> np.ndarray:
    """16 bits of each pair code, to tell most pairs without a rule at once."""
    return ((codes * codes.dtype.type(2654435761)) >> codes.dtype.type(codes.itemsize * 8 - 16)).astype(np.uint16)


def compress(ids: np.ndarray, first: int, most: int = MOST, least: int = LEAST) -> bytes:
    """The payload of ids below `first`. Each round replaces the pairs that occur most, until none occurs `least` times."""
    wide = first > 1 << 16
    kind, code, shift = (np.uint32, np.uint64, 32) if wide else (np.uint16, np.uint32, 16)
    seq = ids.astype(kind)
    pairs, lengths = [np.empty((0, 2), kind)], np.empty(0, np.int64)
    while len(seq) >= 2:
        codes = seq[:-1].astype(code)
        codes <<= code(shift)
        codes |= seq[1:]
        ordered = np.sort(codes)
        starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        if len(often) > most:
            often = often[np.lexsort((ordered[starts[often]], -counts[often]))[:most]]
        keys = np.sort(ordered[starts[often]])
        left, right = (keys >> code(shift)).astype(kind), (keys & code((1 << shift) - 1)).astype(kind)
        size = first + sum(map(len, pairs))
        if not wide and size + len(keys) > 1 << 16:  # from here on, symbols need 32 bits
            wide, kind, code, shift = True, np.uint32, np.uint64, 32
            seq, pairs = seq.astype(kind), [x.astype(kind) for x in pairs]
            left, right = left.astype(kind), right.astype(kind)
            keys = left.astype(code) << code(shift) | right
            codes = seq[:-1].astype(code) << code(shift) | seq[1:]
        is_left, is_right = np.zeros(size, bool), np.zeros(size, bool)
        is_left[left], is_right[right] = True, True
        at = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]])
        own = codes[at]
        seen = np.zeros(1 << 16, bool)
        seen[_mixed(keys)] = True
        near = seen[_mixed(own)]
        at, own = at[near], own[near]
        rule = np.searchsorted(keys, own)
        rule[rule == len(keys)] = 0
        real = keys[rule] == own
        at, rule = at[real], rule[real]
        # of occurrences that overlap, each second one is taken, from the left
        n = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, n, 0))
        take = (n - run) % 2 == 0
        at, rule = at[take], rule[take]
        full = np.concatenate([np.ones(first, np.int64), lengths])
        new = full[left] + full[right]
        seq[at] = (size + rule).astype(kind)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        pairs.append(np.stack([left, right], 1))
        lengths = np.concatenate([lengths, new])
    rules = np.concatenate(pairs)
    head = b"RPG1" + struct.pack("<4qB", first, len(rules), len(seq), len(ids), np.dtype(kind).itemsize)
    return b"".join([head, rules.tobytes(), lengths.astype("<u4").tobytes(), seq.tobytes()])


class Segment:
    """A payload, open for reading."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != b"RPG1":
            raise ValueError("not a segment")
        self.first, n_rules, n_symbols, self.n_ids, width = struct.unpack_from("<4qB", payload, 4)
        kind, at = (np.dtype("<u2") if width == 2 else np.dtype("<u4")), 4 + 33
        self.rules = np.frombuffer(payload, kind, 2 * n_rules, at).reshape(-1, 2)
        at += 2 * n_rules * width
        self.lengths = np.frombuffer(payload, "<u4", n_rules, at).astype(np.int64)
        self.symbols = np.frombuffer(payload, kind, n_symbols, at + 4 * n_rules)
        self.word_ends: np.ndarray | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        seq = symbols
        while len(at := np.flatnonzero(seq >= self.first)):
            size = np.ones(len(seq), np.int64)
            size[at] = 2
            start = np.cumsum(size) - size
            out = np.empty(len(seq) + len(at), seq.dtype)
            out[start] = seq
            pair = self.rules[seq[at] - self.first]
            out[start[at]], out[start[at] + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq.astype(np.uint32)

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, expanding only the symbols that cover them."""
        if stop <= start:
            return np.empty(0, np.uint32)
        if self.word_ends is None:
            size = np.ones(len(self.symbols), np.int64)
            rule = self.symbols >= self.first
            size[rule] = self.lengths[self.symbols[rule] - self.first]
            self.word_ends = np.cumsum(size)
        a, b = np.searchsorted(self.word_ends, [start, stop - 1], "right")
        before = int(self.word_ends[a - 1]) if a else 0
        return self._expand(self.symbols[a : b + 1])[start - before : stop - before]


class Library:
    """The tokenizers library over many pieces of text without white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        def opened():
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            return tokenizer

        self.tokenizer, self._plain, self._bytes = opened(), opened(), opened()
        # words that are split and in lower case already need neither rule again; of letters beyond ASCII, the bytes' signs
        spaces = pre_tokenizers.WhitespaceSplit()
        for tokenizer, rule in ((self._plain, spaces), (self._bytes, pre_tokenizers.Sequence([spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))):
            tokenizer.normalizer, tokenizer.pre_tokenizer = normalizers.Sequence([]), rule
        spec = json.load(open(path, encoding="utf-8"))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._known = Cache(self._encode_words, PIECES)
        self._pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.word_ends = np.zeros(self.size, bool)
        for name, i in spec["model"]["vocab"].items():
            self.word_ends[i] = name.endswith(spec["model"]["end_of_word_suffix"])

    def words(self, words: pa.Array, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's ids end). Words are in lower case and hold no white space; they go to the
        library in lines, in which each word ends with its only token of a word end."""
        ascii_ = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        parts, sizes = [], np.zeros(len(words), np.int64)
        for tokenizer, at in ((self._plain, np.flatnonzero(ascii_)), (self._bytes, np.flatnonzero(~ascii_))):
            if not len(at):
                continue
            borders = np.append(np.arange(0, len(at), most), len(at)).astype(np.int32)
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders), words.take(pa.array(at))), " ").to_pylist()
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.word_ends[ids]) + 1
            if len(ends) != len(at):
                raise ValueError("a word without a word end")
            sizes[at] = np.diff(ends, prepend=0)
            parts.append((at, ids, ends))
        ends = np.cumsum(sizes)
        if len(parts) == 1:
            return parts[0][1], ends
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for at, ids, own in parts:
            n = sizes[at]
            out[np.repeat(ends[at] - own, n) + np.arange(len(ids))] = ids
        return out, ends

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        ids, ends = self.words(pa.array(words, pa.string()))
        data, cuts = ids.astype("<u4", copy=False).tobytes(), (ends * 4).tolist()
        return dict(zip(words, [data[i:j] for i, j in zip([0, *cuts], cuts)]))

    def encode(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each piece, as little-endian 32-bit integers. Words that pieces share are encoded once.

        Most pieces are a word, or a word and one sign; what takes the library's own rules goes to it whole.
        """
        ones, twos, more, odd = {}, {}, {}, []
        for c in chunks:
            if c.isascii():
                if c.isalpha():
                    ones[c] = c.lower()
                    continue
                if c[:-1].isalpha() and c.isprintable():
                    twos[c] = c[:-1].lower()
                    continue
            if not _COMMON.fullmatch(c) or "<|" in c:
                odd.append(c)
            elif c.isalpha():
                ones[c] = c.lower()
            else:
                more[c] = self._pattern.findall(c.lower())
        words = {*ones.values(), *twos.values(), *(c[-1] for c in twos), *(w for found in more.values() for w in found)}
        self._known.fill(words)
        known = self._known.young
        out = {c: known[w] for c, w in ones.items()}
        out.update({c: known[w] + known[c[-1]] for c, w in twos.items()})
        out.update({c: b"".join([known[w] for w in found]) for c, found in more.items()})
        if odd:
            out |= {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False))}
        return out


@lru_cache(maxsize=2)
def _library(path: str) -> Library:
    return Library(path)


def units_of(pieces: pa.Array, library: Library) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two units of each distinct piece, the second -1 where it has one; first id, number of ids, ids of the units).

    Most pieces are a word, or a word and a run of signs: their words are put together by column and go to the library once each.
    Any other piece is a unit of its own.
    """
    one = pc.match_substring_regex(pieces, _WORD)
    split = pc.extract_regex(pieces, _WORD_AND_SIGNS)
    two = pc.is_valid(split)
    is_one, is_two = (x.to_numpy(zero_copy_only=False) for x in (one, two))
    stems, signs = split.filter(two).flatten()
    words = pa.concat_arrays([pc.utf8_lower(pieces.filter(one)), pc.utf8_lower(stems), signs]).dictionary_encode()
    at, known = words.indices.to_numpy(), words.dictionary
    ids, ends = library.words(known)
    others = np.flatnonzero(~(is_one | is_two))
    chunks = pieces.take(pa.array(others)).to_pylist()
    made = library.encode(chunks)
    parts = [np.frombuffer(made[c], "<u4") for c in chunks]
    size = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, parts), np.int64, len(parts))])
    units = np.full((len(pieces), 2), -1, np.int64)
    n_one, n_two = int(is_one.sum()), int(is_two.sum())
    units[is_one, 0] = at[:n_one]
    units[is_two, 0], units[is_two, 1] = at[n_one : n_one + n_two], at[n_one + n_two :]
    units[others, 0] = len(known) + np.arange(len(others))
    return units, np.cumsum(size) - size, size, np.concatenate([ids, *parts])


def ids_of(texts: pa.Array, library: Library, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with its end id; where each text ends). No word of this kind of file crosses white space."""
    codes, borders, pieces = coded(texts, False)
    units, first, size, source = units_of(pieces, library)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(borders))
    pairs = units[codes]
    real = pairs >= 0
    text = np.repeat(text, real.sum(1))
    own = pairs[real]
    n = size[own]
    stops = np.cumsum(n)
    start = stops - n
    total = int(stops[-1]) if len(stops) else 0
    out = np.full(total + len(texts), end_id, np.uint32)
    # each unit's ids go where they stand among all ids, moved on by the end ids of the texts before
    step = np.arange(total)
    out[step + np.repeat(text, n)] = source[step + np.repeat(first[own] - start, n)]
    sums = np.bincount(text, n, minlength=len(texts)).astype(np.int64)
    return out, np.cumsum(sums) + np.arange(1, len(texts) + 1)


def write(df: DataFrame, id_col: str, text_col: str, path: str | None = None, end_id: int = 1, segment: int = SEGMENT) -> str:
    """Writes the ids of all texts in ascending id order; returns the folder.

    One row a segment: part (range of ids, ascending), seq (order in the part), n_ids, docs (64-bit ids), sizes (32-bit),
    payload.
    A segment ends with the document that fills it, so its memory is bounded by the segment and one document.
    """
    spark = df.sparkSession
    prepare(spark)
    path = path or default_vocabulary()
    folder = shared_dir(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches are large and nothing here makes cycles
        library = _library(path)
        docs, sizes, parts, held, seq = [], [], [], 0, 0
        part_no = TaskContext.get().partitionId()

        def row() -> pa.RecordBatch:
            doc, size, ids = np.concatenate(docs), np.concatenate(sizes), np.concatenate(parts)
            values = [part_no, seq, len(ids), doc.tobytes(), size.astype("<u4").tobytes(), compress(ids, library.size)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "seq", "n_ids", "docs", "sizes", "payload"])

        try:
            for b in gathered(batches, GATHER):
                start = 0
                for part in slices(b.column(1), GATHER):
                    doc = pc.fill_null(b.column(0).slice(start, len(part)), _NULL).to_numpy().astype("<i8")
                    start += len(part)
                    ids, ends = ids_of(part, library, end_id)
                    at = 0
                    while at < len(doc):  # documents up to the one that fills the segment
                        done = ends[at - 1] if at else 0
                        to = min(len(doc), int(np.searchsorted(ends, done + segment - held)) + 1)
                        docs.append(doc[at:to])
                        sizes.append(np.diff(ends[at:to], prepend=done))
                        parts.append(ids[done : ends[to - 1]])
                        held += int(ends[to - 1] - done)
                        at = to
                        if held >= segment:
                            yield row()
                            docs, sizes, parts, held, seq = [], [], [], 0, seq + 1
            if docs:
                yield row()
        finally:
            gc.enable()
            given_back()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    rows.mapInArrow(run, "part long, seq long, n_ids long, docs binary, sizes binary, payload binary").write.parquet(folder)
    return folder


def read(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """(id long, start long, n_tokens long, ids_crc32 long[, ids array<long>]) of every document, from the files."""
    prepare(spark)
    table = spark.read.parquet(folder)
    # one row a part is ordered by one task; the segments of a part by a task of their own
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = table.select("part", "seq", inside.alias("inside")).join(parts, "part")
    starts = starts.select("part", "seq", (F.coalesce("earlier", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("before"))
    table = table.join(F.broadcast(starts) if table.count() <= 100_000 else starts, ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, sizes, payload, before in zip(*(b.column(c).to_pylist() for c in ("docs", "sizes", "payload", "before"))):
                docs, sizes = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<u4").astype(np.int64)
                ids = Segment(payload).all().astype("<u4", copy=False)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(docs, pa.int64(), mask=docs == _NULL), pa.array(starts + before), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return table.select("docs", "sizes", "payload", "before").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def lookup(spark, folder: str, ids: list[int]) -> DataFrame:
    """(id long, ids array<long>) of the documents asked for, by random access: of a segment that has one, only the symbols
    that cover it are expanded. A repeated id gives a row for each of its documents."""
    prepare(spark)
    wanted = np.unique(np.array(ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, sizes, payload in zip(*(b.column(c).to_pylist() for c in ("docs", "sizes", "payload"))):
                docs = np.frombuffer(docs, "<i8")
                at = np.flatnonzero(np.isin(docs, wanted) & (docs != _NULL))
                if len(at):
                    ends, segment = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)), Segment(payload)
                    found = [segment.ids(int(ends[i - 1]) if i else 0, int(ends[i])).astype(np.int64) for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(found, pa.list_(pa.int64()))], ["id", "ids"])

    return spark.read.parquet(folder).select("docs", "sizes", "payload").mapInArrow(run, "id long, ids array<long>")


def ratio(spark, folder: str) -> float:
    """Bytes of the grammars by bytes of the ids as 32-bit integers."""
    r = spark.read.parquet(folder).agg(F.sum(F.octet_length("payload")).alias("b"), F.sum("n_ids").alias("n")).first()
    return r.b / (4 * r.n) if r.n else 1.0


def op8(spark, sf_dir: str) -> DataFrame:
    folder = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return read(spark, folder, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
