"""Token-group join, clusters with bounds and impact-ordered search against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import hamerly, ranked, similar, tokengroups
from test_similar import grams, made

CLASH = "doc_id long, text string, `a.b` int, key string, n int, t string, id int"


def rows_of(texts, ids=None):
    return [(i if ids is None else ids[i], t, 1, "k", None, "t", 7) for i, t in enumerate(texts)]


def components(texts, ids):
    """Smallest id reachable over links of any two texts whose sets have a similarity of 0.8 or more."""
    sets, name = [grams(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if name[a] != name[b] and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((name[a], name[b]))
                name = [low if x == high else x for x in name]
    least = {}
    for x, i in zip(name, ids):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [(i, len(s), least.get(x)) for i, s, x in zip(ids, sets, name)]


@pytest.mark.parametrize("group,first", [(3, 1), (256, 3)])
def test_token_groups_equal_brute_force(spark, group, first):
    texts = made()
    texts += [texts[0], texts[1], None]  # repeated rows
    ids = list(range(len(texts)))
    ids[5] = ids[60] = ids[-1] = None
    ids[7] = ids[8] = 10_000
    read = {}
    df = spark.createDataFrame(rows_of(texts, ids), CLASH)
    got = tokengroups.joined(df, "doc_id", "text", group=group, first=first, read=read).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(components(texts, ids), key=key)
    assert 0 < read["opened"] <= read["asked"]


def test_token_groups_long_empty_and_none(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    other = list(words)
    for at in range(0, 40_000, 250):
        other[at] = "changed"
    texts = [" ".join(words), " ".join(other), " \t", "", None, "only Four\x0bwords here", "ONLY four words here"]
    got = tokengroups.joined(spark.createDataFrame(rows_of(texts), CLASH), "doc_id", "text").collect()
    assert sorted(map(tuple, got)) == components(texts, list(range(len(texts))))
    assert {r.id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    empty = tokengroups.joined(spark.createDataFrame([], CLASH), "doc_id", "text")
    assert empty.collect() == [] and empty.columns == ["id", "n_shingles", "component_id"]


def test_cover_never_underestimates():
    rng = np.random.default_rng(3)
    for n in (1, 4, 60, 700, 5000):
        own = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        others = [np.unique(np.concatenate([rng.choice(own, len(own) // 2), rng.integers(0, 1 << 63, m, np.uint64)])) for m in (0, 10, 3000)]
        both = tokengroups.union([tokengroups.cover(o) for o in others])
        seen = len(np.intersect1d(own, np.concatenate(others)))
        assert seen <= tokengroups.overlap(len(own), tokengroups.cover(own), both) <= len(own)
    far = [np.unique(rng.integers(0, 1 << 63, 900, np.uint64)) for _ in range(2)]
    assert tokengroups.overlap(len(far[0]), tokengroups.cover(far[0]), tokengroups.cover(far[1])) < similar.LEAST * len(far[0])


def plain_clusters(rows, k, rounds):
    """Plain k-means in whole numbers. rows: (id, vector)."""
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    now = [list(v) for _, v in sorted(rows, key=lambda r: (name(r[0]), list(r[1])))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        own = [min(range(len(now)), key=lambda c: (far(v, now[c]), c)) for _, v in rows]
        if r < rounds:
            for c in range(len(now)):
                members = [v for (_, v), o in zip(rows, own) if o == c]
                if members:
                    now[c] = [sum(x) // len(members) for x in zip(*members)]
    d = [far(v, now[o]) for (_, v), o in zip(rows, own)]
    each = Counter()
    for o, x in zip(own, d):
        each[o] += x
    return [(i, o, x, each[o], sum(d), hashlib.sha256(",".join(map(str, now[o])).encode()).hexdigest()) for (i, _), o, x in zip(rows, own, d)]


def whole(v):
    return [math.floor(1024 * x) for x in v]


@pytest.mark.parametrize("spread", [0.02, 5.0, 1e4])
def test_clusters_equal_plain(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 4)) * 3
    data = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=4) * spread]) for i in range(300)]
    data += [(7, data[7][1]), (7, data[8][1]), (None, data[9][1])]
    odd = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]), (903, [1.0, float("nan"), 1.0, 1.0]), (904, [float("inf")] * 4), (905, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data + odd], "vec_id long, embedding array<double>, `a.b` int, cluster int")
    scans = []
    got = hamerly.clustered(hamerly.vectors(df, "vec_id", "embedding", dimensions=4), k=5, rounds=6, scans=scans).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain_clusters([(i, whole(v)) for i, v in data], 5, 6), key=key)
    if spread < 1:  # far apart: the bounds leave nearly all alone
        assert scans[0] == len(data) and sum(scans[3:]) < len(data)


def test_clusters_ties_few_empty_and_large(spark):
    make = lambda rows: hamerly.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", dimensions=2)
    rows = [(i, [float(i % 3), 0.0]) for i in range(9)] + [(9, [-0.5, 0.0])]
    for k in (1, 2, 8, 20):
        got = hamerly.clustered(make(rows), k=k, rounds=3).collect()
        assert sorted(map(tuple, got)) == sorted(plain_clusters([(i, whole(v)) for i, v in rows], k, 3))
    assert hamerly.clustered(make([])).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        hamerly.clustered(make([(1, [1e12, 0.0])])).collect()


def test_bounds_with_large_whole_numbers():
    """Sums beyond 2^53 are taken in 64-bit integers."""
    x, c = np.array([[2**28, 1], [2**28 + 1, 0]]), np.array([[-(2**28), 0], [2**28, 2]])
    assert hamerly.squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]


def plain_ranking(docs, items, k=20):
    terms = [(i, ranked.terms_of(t)) for i, t in docs]
    having = [(i, t) for i, t in terms if t]
    n_, l_ = len(having), sum(len(t) for _, t in having)
    df = Counter(x for _, t in having for x in set(t))
    out = []
    for item, text in items:
        found = []
        for i, t in having:
            m, tf = 100 - 25 + 25 * len(t) * n_ // l_, Counter(t)
            s = sum(math.floor(1000 * math.log((2 * n_ + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in ranked.terms_of(text) if tf[x])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("block,few,share", [(7, 3, 1), (1000, 256, 64)])
def test_ranking_equals_plain(spark, monkeypatch, block, few, share):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdéß日" for b in "xyz12"]
    weights = [1 / (r + 1) for r in range(len(words))]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "_", "\n", "\x7f"]) for w in rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[3][1].upper().replace("É", "é")) for i in range(40)]  # ties
    docs += [(300, None), (301, ""), (302, " _-! \x7f"), (None, docs[5][1]), (5, docs[5][1]), (303, "ax " * 50_000 + "dz2")]
    items = [(i, text(12)) for i in range(12)] + [(12, docs[3][1]), (3, "ax ax AX bx"), (13, None), (14, ""), (15, "nowhere"), (None, "cx dy dy")]
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "FEW", few)
    d = spark.createDataFrame(rows_of([t for _, t in docs], [i for i, _ in docs]), CLASH)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, `a.b` int")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for item_bytes in (ranked.ITEM_BYTES, 60):
        got = ranked.ranked(d, q, "doc_id", "text", "item_id", "text", item_bytes=item_bytes, share=share).collect()
        assert sorted(map(tuple, got), key=key) == sorted(plain_ranking(docs, items), key=key)
    empty = ranked.ranked(d.limit(0), q, "doc_id", "text", "item_id", "text")
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.ranked(d, q.limit(0), "doc_id", "text", "item_id", "text").collect() == []


def test_search_stops_before_the_lists_end():
    """One rare term decides: the common terms' postings are not read to their end, and the scores are whole all the same."""
    rng = np.random.default_rng(7)
    size = 5000
    rows = [sorted({*rng.integers(0, 30, 15).tolist(), *([40] if i % 500 == 0 else [])}) for i in range(size)]
    borders = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms = np.array([t for r in rows for t in r])
    times, n = rng.integers(1, 4, len(terms)), rng.integers(20, 60, size)
    weights = np.array([700 + i for i in range(40)] + [9000])
    block = ranked.Block(n, borders, terms, times, weights, size, int(n.sum()))
    item, read = (np.array([1, 2, 3, 40]), np.array([1, 2, 1, 1])), []
    docs, scores = block.search(item, 5, 1, read=read)
    assert read[0][0] < read[0][1] / 4 and 0 < read[0][2] <= ranked.FEW
    plain = np.zeros(size, np.int64)
    for t, o in zip(*item):
        for i in np.flatnonzero(terms == t):
            plain[np.searchsorted(borders, i, "right") - 1] += o * block.impact[i]
    order = np.lexsort((np.arange(size), -plain))[:5]
    best = sorted(zip((-scores).tolist(), docs.tolist()))[:5]
    assert best == [(-int(plain[i]), int(i)) for i in order]
