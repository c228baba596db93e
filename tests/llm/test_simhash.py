"""SimHash links and components against brute force."""

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash
from quillspark.llm.common import connected_components


def plain(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(fps, ids, radius=3):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "a", "A b", "Ä ä a b c", "x y z x y z x y z", "one\x0btwo\x0cthree\tfour"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain(text)


def test_long_text_fingerprint():
    text = " ".join(map(str, np.random.default_rng(0).integers(0, 500, 4000)))
    assert simhash.fingerprint(text.encode()) == plain(text)


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    fps, ids = [plain(r.text) for r in rows], [r.doc_id for r in rows]
    want = components(fps, ids)
    got = simhash.op7(spark, small).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in zip(ids, fps)}
    assert len(got) == len(rows)


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_find_all_within_the_radius(spark, tile):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = set(rng.integers(0, 2**63, 300, dtype=np.uint64).tolist())
    for c in centres.tolist():  # balls around a few centres, chains included
        for _ in range(60):
            for b in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
                c ^= 1 << b
            fps.add(c)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    edges = simhash.links(nodes, tile=tile)
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 3 for r in edges.collect())
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = components(fps, list(range(len(fps))))
    assert {i: got.get(i, i) for i in want} == want


def test_nulls_empties_and_clashing_names(spark):
    df = spark.createDataFrame([(3, None, 1, 2), (2, " ", 3, 4), (2, "", 3, 4), (9, "a b c", 1, 1)], "doc_id long, text string, id int, fp int")
    got = sorted((r.id, r.component) for r in simhash.near_duplicates(df, "doc_id", "text").collect())
    assert got == [(2, 2), (2, 2), (3, 2), (9, 9)]
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_components_of_a_long_path(spark):
    n = 120
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (500, 400)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 400: 400, 500: 400}


def test_only_values_of_many_fingerprints_are_dealt_to_pairs_of_tiles(spark):
    """Other rows are sent once, however many meet: copies of a row grow with the size of its own group, past a tile."""
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([rng.integers(0, 2**63, 300), np.int64(7) + (np.arange(60, dtype=np.int64) << 40)]))
    nodes = spark.createDataFrame([(x, x) for x in fps.tolist()], "id long, fp long")
    dealt = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("explode(sequence(")
    assert dealt(simhash.links(nodes)) == 0 and dealt(simhash.links(nodes, tile=8)) == 1
    want = components(fps.tolist(), fps.tolist())
    for tile in (8, 1024):
        found = connected_components(simhash.links(nodes, tile=tile)).collect()
        assert {x: x for x in fps.tolist()} | {r.node: r.component for r in found} == want
