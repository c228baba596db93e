"""BPE, token files, WARC and top-k against the libraries, round trips and brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, repair, topk, warc

ODD = ["", " \t\n", "a\x1cb c", "<|endoftext|>x <|startoftext|><|ENDOFTEXT|>", "İstanbul ΣΑΣ ﬁ Å ½ ² 한국어 日本語 😀👍🏽", "can't WE'LL 's 'S don't", "a" * 3000, "1234567890" * 20, "!!!???...---" * 9, "﻿hi \x00 \x85b"]


def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefgh  'stre<|>é漢́가İΣ1½_-.") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    made += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0x3FFF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(60)]
    return ODD + made


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def documents(spark, texts):
    """Ids 0.. with the texts, a null text, a repeated row and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(len(texts), None, None, None, None), (0, texts[0], "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, id int, t string")


def test_bpe_equals_library(spark, library):
    texts = odd_texts()
    got = bpe.encoded(documents(spark, texts), "doc_id", "text").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        e = library.encode(texts[r.id] if r.id < len(texts) else "", add_special_tokens=False)
        assert (r.n_tokens, r.ids) == (len(e.ids), " ".join(map(str, e.ids)))
        assert r.decoded == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_pieces_without_tokens(spark, library):
    lone = ["\u00a0", "\u3000", "\x85", "\u2028", "\u3000 \u00a0", "\u200b"]
    texts = [t for x in lone for t in (f"a {x} b", f"{x} a", f"a {x}", x, f"a{x} {x}b {x} {x} c")]
    got = bpe.encoded(documents(spark, texts), "doc_id", "text").collect()
    assert len(got) == len(texts) + 2
    for r in got:
        e = library.encode(texts[r.id] if r.id < len(texts) else "", add_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))


def test_bpe_query_digests(spark, small, library):
    got = {r.doc_id: r for r in bpe.op4(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        g = got.pop(r.doc_id)
        assert g.n_tokens == len(e.ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


def test_trie_states_of_shared_prefixes():
    m = bpe.model(bpe.default_vocabulary())
    words = ["a", "ab", "abs", "absolute", "absolutely", "b", "aaaaaaa", "aaaaaa"]
    alone = {w: m.encode_words([w])[w] for w in words}
    assert m.encode_words(words) == alone


@pytest.mark.parametrize("first,n,kinds", [(49408, 5000, 40), (49408, 1, 5), (49408, 0, 5), (100_000, 3000, 7), (10, 4000, 1)])
def test_repair_round_trip(first, n, kinds):
    ids = np.random.default_rng(1).zipf(1.5, n).clip(1, kinds).astype(np.uint32)
    s = repair.Segment(repair.compress(ids, first))
    assert (s.all() == ids).all() and s.n_ids == n
    for a, b in [(0, n), (n // 3, n // 2), (n - 1, n), (5, 5)]:
        assert (s.ids(max(a, 0), b) == ids[max(a, 0) : b]).all()
    if n > 1000:
        assert len(s.symbols) < n / 1.3


@pytest.mark.parametrize("first,n,most", [(49408, 6000, 4000), (65500, 6000, 20)])
def test_repair_leaves_no_frequent_pair(first, n, most):
    ids = np.tile(np.random.default_rng(3).integers(0, 40000, 300).astype(np.uint32), n // 300 * 3)
    s = repair.Segment(repair.compress(ids, first, most=most))
    assert (s.all() == ids).all() and s.lengths.max() > 16
    pairs = np.unique(s.symbols[:-1].astype(np.uint64) << np.uint64(32) | s.symbols[1:], return_counts=True)[1]
    # of a run of one symbol every second pair counts
    assert len(s.symbols) < 2 or pairs.max() < repair.LEAST


def test_token_files(spark, library):
    texts = odd_texts()
    folder = repair.write(documents(spark, texts), "doc_id", "text", segment=500)
    rows = sorted(repair.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted([0, *range(len(texts) + 1)])
    at = 0
    for r in rows:
        want = [*library.encode(texts[r.id] if r.id < len(texts) else "", add_special_tokens=False).ids, 1]
        assert r.ids == want and r.start == at and r.n_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_token_files_by_random_access(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    folder = repair.write(docs, "doc_id", "text", segment=5000)
    whole = {r.id: r.ids for r in repair.read(spark, folder).collect()}
    some = sorted(whole)[::17]
    assert {r.id: r.ids for r in repair.lookup(spark, folder, [*some, -5]).collect()} == {i: whole[i] for i in some}
    assert repair.lookup(spark, folder, []).count() == 0
    assert repair.ratio(spark, repair.write(docs, "doc_id", "text")) < 0.6


def test_token_files_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")
    rows = repair.read(spark, repair.write(df, "doc_id", "text")).collect()
    assert sorted((str(r.id), r.start) for r in rows) == [("3", 3), ("None", 0)]
    assert repair.read(spark, repair.write(df.limit(0), "doc_id", "text")).count() == 0


def test_warc_round_trip(spark):
    long = "é" * 700_000
    rows = [(1, "http://a", "x" * 99), (2, None, "x" * 99), (3, "http://b", long), (4, "u v", long), (5, "", None), (6, "c", "y" * 100), (7, "c", "y" * 100), (6, "c", "y" * 100), (None, "n", "y" * 100), (9, "crlf", "a\r\n\r\nb" * 50)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write(df, "page_id", "html", "url")
    table = warc.read(manifest).collect()
    records = {}
    for c in sorted(table, key=lambda c: c.chunk_no):
        records.setdefault(c.record_id, []).append(c)
    for page, _, html in rows:
        if page is None:
            continue
        own = records[f"urn:quillspark:record:{page}"]
        payload = (html or "").encode()
        kind = "revisit" if page in (4, 7) else "response"
        assert own[0].record_type == kind and own[0].payload_bytes == len(payload) and own[0].payload_digest == hashlib.sha256(payload).hexdigest()
        if kind == "response" and page != 6:
            assert b"".join(bytes(c.data) for c in own) == payload and own[-1].last and not any(c.last for c in own[:-1])
            so_far = hashlib.sha256()
            for c in own:
                so_far.update(c.data)
                assert c.digest == so_far.hexdigest() and c.n_bytes <= warc.CHUNK
    assert len(records["urn:quillspark:record:3"]) == 6
    assert records["urn:quillspark:record:4"][0].refers_to.endswith(":3")
    assert warc.read(warc.write(df.limit(0), "page_id", "html", "url")).count() == 0


def test_warc_files_are_standard_gzip(spark):
    import gzip

    df = spark.createDataFrame([(1, "http://a", "hello" * 50)], "page_id long, url string, html string")
    archive = warc.write(df, "page_id", "html", "url").first().archive
    data = gzip.decompress(open(archive.removeprefix("file://"), "rb").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"hello\r\n\r\n")
    assert [c["n_bytes"] for c in warc.chunks(io.BytesIO(gzip.compress(data)), limit=64)] == [64, 64, 64, 58]


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = sorted(((-int(x[q] @ x[i]), ids[i]) for i in range(len(ids)) if ids[i] != ids[q]))[:k]
        out[ids[q]] = [(r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return out


@pytest.mark.parametrize("n,d,few", [(1500, 8, 20), (60, 3, 5), (7, 4, 2)])
def test_topk_equals_brute_force(spark, monkeypatch, n, d, few):
    rng = np.random.default_rng(n)
    x = np.floor(1024 * rng.normal(size=(n, d)) / 3)
    x[n // 2 :: 7] = x[0]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for r in topk.top_k(df, df.where(f"vec_id % {few} = 0"), vector_block=max(4, n // 3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(list(range(n)), x, range(0, n, few), 10)


def test_nra_stops_early():
    rng = np.random.default_rng(0)
    x = np.floor(100 * rng.pareto(1.0, (4000, 6))).astype(np.int64)
    q = np.abs(np.floor(10 * rng.normal(size=(5, 6)))).astype(np.int64)
    read = []
    a, b, s = topk.search(topk.Lists(x, np.arange(4000)), q, np.arange(5), 10, read=read)
    for i in range(5):
        want = np.sort(np.delete(x @ q[i], i))[::-1][:10]
        assert (np.sort(s[a == i])[::-1] == want).all()
    assert len(read) == 5 and all(t < 4000 and rows < 200 for _, t, rows in read)


def test_nra_is_entered_for_small_blocks(spark, small):
    rows = topk.whole(spark.read.parquet(f"{small}/embeddings.parquet"), "vec_id", "embedding").orderBy("vec_id").collect()
    x, ids = np.array([r.v for r in rows], np.int64), np.array([r.vec_id for r in rows])
    at, read = np.flatnonzero(ids % 100 == 0), []
    a, b, s = topk.search(topk.Lists(x, ids), x[at], ids[at], 10, read=read)
    assert sorted(q for q, _, _ in read) == list(range(len(at))) and all(t >= 1 for _, t, _ in read)
    for i, q in enumerate(at):
        order = np.lexsort((ids, -(x @ x[q])))
        want = [j for j in order if j != q][:10]
        mine = b[a == i]
        assert list(mine[np.lexsort((ids[mine], -s[a == i]))]) == want


def test_topk_scores_are_exact_or_refused(spark):
    v = lambda rows: spark.createDataFrame(rows, "vec_id long, v array<long>")
    df = v([(0, [2**20 + 1]), (1, [2**40 + 1]), (2, [2**40]), (3, [-(2**40)])])
    got = topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1152922604119523329), (2, (2**20 + 1) * 2**40), (3, -(2**20 + 1) * 2**40)]
    large = v([(0, [2**40, 1]), (1, [2**40, 1])])
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(large, large).collect()


def test_topk_repeated_queries_and_null_ids(spark):
    rows = [(100, [1, 2]), (100, [1, 2]), (100, [-1, 0]), (None, [9, 9]), *[(i, [i % 5, 1]) for i in range(1, 30)], (7, [2, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id = 100 OR vec_id IS NULL"), k=3, vector_block=8).collect()
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    first = sorted((-(v[0] + 2 * v[1]), i) for i, v in rows if i not in (100, None))[:3]
    other = sorted((v[0], i) for i, v in rows if i not in (100, None))[:3]
    want = [(100, k + 1, i, -s) for k, (s, i) in enumerate(first)] + [(100, k + 1, i, -s) for k, (s, i) in enumerate(other)]
    assert found == sorted(want)


def test_topk_leaves_out_what_is_not_finite(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.25]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(v := topk.whole(df, "vec_id", "embedding"), v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 1 << 20), (0, 2, 100, 1 << 20), (100, 1, 0, 1 << 20), (100, 2, 5, 1 << 19)]
    empty = v.limit(0)
    assert topk.top_k(empty, empty).count() == 0
