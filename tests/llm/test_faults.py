"""Cases that once crashed or lost something without an error."""

import io
import weakref

import numpy as np
import pytest

from quillspark.llm import bpe, decontaminate, pii, simhash, topk, toxicity, warc


def test_cut_archives_are_an_error(spark):
    df = spark.createDataFrame([(i, "http://a.b/", f"page {i} " + "x" * 500) for i in range(3)], "page_id long, url string, html string")
    data = open(warc.write(df.coalesce(1), "page_id", "html", "url").first().archive.removeprefix("file:"), "rb").read()
    assert sum(r["last"] for r in warc.chunks(io.BytesIO(data))) == 3
    for cut in (1, 20, 200):
        with pytest.raises(ValueError, match="inside a record"):
            list(warc.chunks(io.BytesIO(data[:-cut])))


def test_bare_folders_follow_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS", "file:///")
    try:
        conf.set("fs.defaultFS", "hdfs://somewhere:9000")
        assert warc.qualified(spark, "/a/b") == "hdfs://somewhere:9000/a/b" and warc.qualified(spark, "file:/a/b") == "file:/a/b"
    finally:
        conf.set("fs.defaultFS", before)
    assert warc.qualified(spark, "/a/b") == "/a/b"


def test_fingerprints_link_rows_without_an_id(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (7, "other words stand here now"), (3, "other words stand here now"), (9, None), (None, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.id is None, r.id or 0, r.component is None, r.component or 0) for r in got) == sorted([(True, 0, True, 0)] * 2 + [(False, 7, False, 3), (False, 3, False, 3), (False, 9, False, 9), (True, 0, False, 9)])


def test_topk_refuses_what_64_bits_cannot_hold(spark):
    make = lambda rows: topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    for low in (-1e16, -9.1e15, 1e300):
        v = make([(0, [3.0, 2.0]), (1, [low, 0.0])])
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(v, v.where("vec_id = 0")).collect()
    with pytest.raises(OverflowError):
        topk.number_kind(np.array([[np.iinfo(np.int64).min]]), np.array([[2]]))
    v = make([(0, [1.0, 2.0]), (1, []), (100, [0.5, 0.5]), (2, [])])
    got = topk.top_k(v, v.where("vec_id % 100 = 0")).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, 100), (100, 0)}


def test_stages_keep_columns_with_dots_in_their_names(spark):
    df = spark.createDataFrame([(1, "some words stand here a@b.cd", 5, "x")], "doc_id long, text string, `a.b` int, `key` string")
    benchmark = spark.createDataFrame([(1, "nothing of this kind is to be found anywhere at all")], "item_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    found = pii.candidates(df, "text")
    for got in (
        toxicity.kept(df, model),
        simhash.kept(df, "doc_id", "text", size=5, least=0.8),
        simhash.kept(df, "doc_id", "text"),
        decontaminate.kept(df, benchmark),
        pii.redacted(found, "text", pii.classifier(found)),
    ):
        assert got.columns == df.columns and [(r[0], r[2], r[3]) for r in got.collect()] == [(1, 5, "x")]


def test_op8_words_of_all_letters():
    """Pieces that are split by column get the library's own ids, whatever letters and signs they hold."""
    import random

    import pyarrow as pa
    from quillspark.llm.bpe import default_vocabulary
    from quillspark.llm.repair import _library, ids_of

    drawn = random.Random(5)
    letters = [chr(c) for c in [*range(33, 127), *range(0xA0, 0x180), 0x301, 0x4E2D, 0x1F600]] + ["'s", "<|endoftext|>", "<|", "***", " ", "\t", "\x85"]
    texts = ["".join(drawn.choice(letters) for _ in range(drawn.randrange(60))) for _ in range(500)]
    texts += ["Été*** ÇA, œuvre. straße's ß9 aª µm İx ŉa ſt x' d'été l'été' foo<|endoftext|> Ĳ ĳ ÿ×÷", "", " \n ", "a" * 3000, "é" * 3000 + "!" * 50]
    library = _library(default_vocabulary())
    ids, ends = ids_of(pa.array(texts), library, 1)
    for text, start, end in zip(texts, [0, *ends.tolist()], ends.tolist()):
        assert ids[start:end].tolist() == [*library.tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_workers_keep_one_operators_tables_at_a_time(spark):
    """A worker outlives its tasks: what it keeps for one stage of the pipeline goes when another stage's takes its place."""
    benchmark = spark.createDataFrame([(1, "five words stand in this benchmark item, or a few more")], "item_id long, text string")
    block = next(decontaminate._blocks(benchmark, "item_id", "text", 2000))
    path = bpe.default_vocabulary()
    index = weakref.ref(decontaminate._index(*block))
    assert index() is not None and decontaminate._index(*block) is index()
    model = weakref.ref(bpe.model(path))
    assert index() is None and bpe.model(path) is model()
    decontaminate._index(*block)
    assert model() is None
