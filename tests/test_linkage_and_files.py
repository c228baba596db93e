"""Linkage against one merge at a time, character references against the standard library, versions of tables."""

import html
import os
from html.entities import html5

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import linkage as lk
from quillspark.sources import tables as tb


def plain_linkage(x, n, method):
    """Heights of all merges, the nearest pair at a time, from members."""
    groups, heights, seen = [[i] for i in range(len(x))], [], []

    def gap(a, b):
        if method == "complete":
            return max(np.linalg.norm(x[i] - x[j]) for i in a for j in b)
        if method == "average":
            return sum(n[i] * n[j] * np.linalg.norm(x[i] - x[j]) for i in a for j in b) / (sum(n[i] for i in a) * sum(n[j] for j in b))
        p, q = sum(n[i] for i in a), sum(n[j] for j in b)
        return np.sqrt(2 * p * q / (p + q)) * np.linalg.norm(np.average(x[a], 0, n[a]) - np.average(x[b], 0, n[b]))

    d = {(i, j): gap([i], [j]) for j in range(len(x)) for i in range(j)}
    names = {i: [i] for i in range(len(x))}
    while len(names) > 1:
        (i, j), h = min(d.items(), key=lambda e: (e[1], e[0]))
        heights.append(h)
        names[i] = names[i] + names.pop(j)
        d = {k: v for k, v in d.items() if i not in k and j not in k} | {(min(i, k), max(i, k)): gap(names[i], names[k]) for k in names if k != i}
        seen.append({k: sorted(v) for k, v in names.items()})
    return heights, seen


@pytest.mark.parametrize("method", lk.METHODS)
def test_linkage_equals_one_merge_at_a_time(spark, method):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(20, 3)) + c for c in ([0, 0, 0], [3, 0, 0], [0, 4, 1])])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100 + i, [float(v) for v in x[i]]) for i in range(0, 60, 3)] + [(999, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    placed, means = lk.micro_clusters(df, "id", "v", 100)
    at = {r.i: (np.array(r.v), r.n) for r in means.collect()}
    merges = lk.tree(means, method)
    heights, seen = plain_linkage(np.array([at[i][0] for i in range(60)]), np.array([at[i][1] for i in range(60)]), method)
    assert [m[2] for m in merges] == pytest.approx(heights, rel=1e-9)
    for k in (2, 3, 10, 59):
        got = lk.cut(merges, list(range(60)), k)
        assert sorted(sorted(i for i in got if got[i] == c) for c in set(got.values())) == sorted(seen[60 - k - 1].values())
    found = lk.clustered(df, "id", "v", 3, (method,), 100).collect()
    own = {r.id: r.cluster for r in found}
    assert len(own) == 80 and all(own[100 + i] == own[i] for i in range(0, 60, 3))


def test_linkage_of_micro_clusters(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=2) * 0.1 + (i % 3) * 5]) for i in range(300)]
    found = lk.clustered(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 3, ("ward",), 20).collect()
    assert sorted(len({r.id % 3 for r in found if r.cluster == c}) for c in range(3)) == [1, 1, 1] and len(found) == 300


def test_references_equal_the_standard_library(spark):
    texts = [f"a &{n} b&{n}" for n in html5] + [f"&{n}x;" for n in html5 if not n.endswith(";")]
    numbers = [*range(0, 0x180), 0x2028, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**12]
    texts += [f for i in numbers for f in (f"x&#{i};y", f"&#{i} ", f"&#x{i:x};", f"&#X{i:X}z", f"&#000{i};")]
    texts += ["", "&", "&&amp;", "&amp;amp;", "&notit; &notin; &noti", "&#;", "&#x;", "& amp;", "a&b<c>&lt", "&unknown; &AMPersand", "&" * 5 + "gt;", "&amp\n;", "no reference"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.u for r in df.select("i", tx.unescaped(F.col("t")).alias("u")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != html.unescape(t)] == []
    assert spark.range(1).select(tx.unescaped(F.lit(None).cast("string")).alias("u")).first().u == ""


def test_versions_keep_the_first_run(spark, tmp_path):
    path = str(tmp_path / "frame")
    with pytest.raises(FileNotFoundError):
        tb.read_version(spark, path)
    assert tb.write_version(spark.range(3).toDF("x"), path, ["three rows", "of x"]) == 1
    with pytest.raises(Exception):
        tb.write_version(spark.range(5).select(F.raise_error(F.lit("broken")).cast("int").alias("x")), path)
    assert tb.versions(spark, path) == [1] and tb.read_version(spark, path).count() == 3
    assert not [n for n in os.listdir(path) if n.startswith("_draft")]
    assert tb.write_version(spark.range(7).toDF("x"), path) == 2
    assert tb.read_version(spark, path).count() == 7 and tb.read_version(spark, path, 1).count() == 3
    assert [r.line for r in tb.read_version(spark, path, 1, "report").sort("k").collect()] == ["three rows", "of x"]


def test_file_profiles(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("good\t1\nvery good\t2\nnot so good\t3\n")
    (tmp_path / "b.tsv").write_text("one\n")
    (tmp_path / "empty.tsv").write_text("")
    (tmp_path / "c.txt").write_text("left out\n")
    got = {os.path.basename(r.path): (r.lines, r.several, r.longest) for r in tb.profile_files(spark, str(tmp_path), "*.tsv").collect()}
    assert got == {"a.tsv": (3, 2, 13), "b.tsv": (1, 0, 3)}
