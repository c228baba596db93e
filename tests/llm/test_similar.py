"""Near copies of the pipeline's stage against brute-force Jaccard."""

import numpy as np
import pytest

from quillspark.llm import simhash, similar


def grams(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(texts):
    own, name = [grams(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if name[a] != name[b] and alike(own[a], own[b]):
                low, high = sorted((name[a], name[b]))
                name = [low if x == high else x for x in name]
    return name


def made():
    """Texts with copies of one to many changed words around the similarity of 0.8, a common line, and odd ones."""
    rng = np.random.default_rng(8)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]
    line, texts = words(30), []
    for n in [*[60] * 12, *[150] * 8, 9, 5, 4, 1]:
        base = words(n)
        texts.append(" ".join(base))
        for changes in range(1, 5):
            other = list(base)
            for at in rng.integers(0, n, changes):
                other[at] = words(1)[0]
            texts.append(" ".join(other))
    texts += [" ".join([*words(20), *line]) for _ in range(40)] + [" ".join([*line, *words(3)]) for _ in range(15)]
    big = words(200)
    for _ in range(60):
        other = list(big)
        for at in rng.integers(0, 200, rng.integers(1, 9)):
            other[at] = words(1)[0]
        texts.append(" ".join(other))
    return [*texts, None, "", " \n", texts[3].upper(), texts[3].replace(" ", "\t ")]


@pytest.mark.parametrize("tile", [8, 1024])
def test_components_equal_brute_force(spark, tile):
    texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = similar.written(similar.marked(df, "text", 5, 0.8), "marks")
    got = marks.join(similar.components(marks, "text", tile=tile, first=1), "key").selectExpr("row.doc_id AS i", "component").collect()
    names = {}
    for r in sorted(got, key=lambda r: r.i):
        names.setdefault(r.component, r.i)
    want = groups(texts)
    assert {r.i: names[r.component] for r in got} == dict(enumerate(want))
    kept = simhash.kept(df, "doc_id", "text", size=5, least=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_stage_drops_near_copies_that_differ_in_many_bits(spark, small):
    import corpus_pipeline as cp

    texts = made()
    want = set(groups(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, small).collect()} == want
    assert cp.drop_near_duplicates(spark, docs.limit(0), small).count() == 0


def test_stage_links_by_fingerprints_and_pivots_first(spark, small, monkeypatch):
    """Near texts are found by SimHash, blocks and pivots, and their shingles checked, before any that share a shingle meet."""
    import corpus_pipeline as cp

    texts = made()
    own, codes = [grams(t) for t in texts], [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= simhash.STAGE_RADIUS]
    assert any(alike(own[i], own[j]) and (codes[i] ^ codes[j]).bit_count() > 3 for i, j in near)
    nodes = spark.createDataFrame([(i, int(np.uint64(c).astype(np.int64))) for i, c in enumerate(codes)], "key long, fp long")
    name = list(range(len(texts)))
    for r in simhash.near_pairs(nodes).collect():
        assert (codes[r.a] ^ codes[r.b]).bit_count() <= simhash.STAGE_RADIUS
        low, high = sorted((name[r.a], name[r.b]))
        name = [low if x == high else x for x in name]
    assert all(name[i] == name[j] for i, j in near)
    order, links, candidates = [], simhash.links, similar.candidates
    monkeypatch.setattr(simhash, "links", lambda *a: order.append(a[1]) or links(*a))
    monkeypatch.setattr(similar, "candidates", lambda *a: order.append("shingles") or candidates(*a))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, small).collect()} == set(groups(texts))
    assert order[0] == simhash.STAGE_RADIUS and order.count("shingles") == 2


@pytest.mark.parametrize("how", [{}, {"size": 5, "least": 0.8}])
def test_null_and_repeated_ids_lose_no_group(spark, how):
    far = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, far[0], 1), (None, far[1], 2), (None, far[1], 2), (7, far[2], 3), (7, far[3], 4), (7, far[3], 4), (8, far[4], 5), (None, far[4], 6), (9, far[2], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    kept = simhash.kept(df, "doc_id", "text", **how)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, far[0], 1), (None, far[1], 2), (7, far[2], 3), (7, far[3], 4), (8, far[4], 5)], key=str)


def test_stage_holds_one_python_worker_a_task(spark, monkeypatch):
    """Marks and fingerprints come from one Python step: each further one holds a worker more beside every task's own."""
    texts, plans = made(), {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, name)

    written = simhash.written
    monkeypatch.setattr(simhash, "written", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.kept(df, "doc_id", "text", size=5, least=0.8).collect()} == set(groups(texts))
    assert plans["marks"].count("ArrowEvalPython") == 1
    got = similar.marked(df, "text", 5, 0.8, simhash.prints).select("row.text", "fp").collect()
    assert len(got) == len(texts) and all(r.fp % (1 << 64) == simhash.fingerprint((r.text or "").encode(), 5) for r in got)
