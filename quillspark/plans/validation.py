"""Small checks and validation measures (Q50 to Q62): extracts, scales, bins, cluster quality, sensitivity, resampling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import pick_key
from quillspark.operators import clusters as cl
from quillspark.operators import linkage as lk
from quillspark.operators import partisanship as pt
from quillspark.sources.tables import stored, table

from .base import ARTICLES, BOTH, articles, outlets, query
from .statistics import _FRAME, _ROWS, _SIDE, _W1, ALPHA, _RATE, coders, frame, one_each, r6, sides
from .words import cube

_HINT = r"[^\n]{0,60} (?:the|der|los|les) [^\n]{0,60}"


@query("q50_context_extract", f"""WITH {ARTICLES} SELECT a.doc_id, regexp_extract(text, '{_HINT}', 0) AS context, trim(regexp_replace(replace(regexp_replace(doc_id || '_' || cluster || '__' || source, '^-?\\d+_', ''), '_', ' '), ' +', ' ', 'g')) AS topic
  FROM articles a LEFT JOIN labels l USING (doc_id) WHERE coalesce(CAST(l.quality AS VARCHAR), '') NOT IN ('0') AND regexp_matches(text, '{_HINT}') ORDER BY a.doc_id LIMIT 200""")  # fmt: skip
def q50(spark, d):
    """A hit with 60 characters on either side, and a topic's name without its number, for the first 200 unlabelled or good."""
    known = table(spark, d, "labels").select("doc_id", "quality")
    rows = articles(spark, d).join(known, "doc_id", "left").where(~F.coalesce(F.col("quality").cast("string"), F.lit("")).isin("0") & F.col("text").rlike(_HINT))
    topic = F.concat_ws("_", F.col("doc_id").cast("string"), "cluster", F.lit(""), "source")
    clean = F.trim(F.regexp_replace(F.replace(F.regexp_replace(topic, r"^-?\d+_", ""), F.lit("_"), F.lit(" ")), " +", " "))
    return rows.select("doc_id", F.regexp_extract("text", _HINT, 0).alias("context"), clean.alias("topic")).orderBy("doc_id").limit(200)


@query("q51_scale_recovery", """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer), z AS (SELECT c_mktsegment, c_acctbal AS x, (c_acctbal - m) / sd AS z FROM customer, s),
  b AS (SELECT c_mktsegment, (max(x) - min(x)) / (max(z) - min(z)) AS scale, min(x) - (max(x) - min(x)) / (max(z) - min(z)) * min(z) AS shift FROM z GROUP BY c_mktsegment)
  SELECT c_mktsegment, round(scale, 4) AS scale, round(shift, 4) AS shift, max(abs(x - (shift + scale * z))) < 1e-6 AS exact FROM z JOIN b USING (c_mktsegment) GROUP BY ALL""")  # fmt: skip
def q51(spark, d):
    """Scale and shift of a z-score, from its ends alone, and whether they give every value back."""
    t = table(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("x"))
    z = t.crossJoin(F.broadcast(t.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")))).select("c_mktsegment", "x", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"))
    scale = (F.max("x") - F.min("x")) / (F.max("z") - F.min("z"))
    b = z.groupBy("c_mktsegment").agg(scale.alias("scale"), (F.min("x") - scale * F.min("z")).alias("shift"))
    gap = F.max(F.abs(F.col("x") - (F.col("shift") + F.col("scale") * F.col("z"))))
    return z.join(F.broadcast(b), "c_mktsegment").groupBy("c_mktsegment", "scale", "shift").agg((gap < 1e-6).alias("exact")).select("c_mktsegment", F.round("scale", 4).alias("scale"), F.round("shift", 4).alias("shift"), "exact")


@query("q52_group_concat", f"""WITH {ARTICLES}, k AS (SELECT *, row_number() OVER (PARTITION BY source, cluster ORDER BY doc_id) AS k FROM articles) SELECT source, cluster, min(year) AS first_year, string_agg(left(title, 40), ' / ' ORDER BY doc_id) AS titles FROM k WHERE k <= 5 GROUP BY ALL""")
def q52(spark, d):
    """The first five titles of each cell in one text."""
    k = F.row_number().over(Window.partitionBy("source", "cluster").orderBy("doc_id"))
    rows = articles(spark, d).select("doc_id", "source", "cluster", "year", "title").withColumn("k", k).where("k <= 5")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.left("title", F.lit(40)).alias("t")))), lambda x: x["t"])
    return rows.groupBy("source", "cluster").agg(F.min("year").alias("first_year"), F.array_join(titles, " / ").alias("titles"))


@query("q53_rating_sheet")
def q53(spark, d):
    """Five labelled articles a length class and quality, at most two of an outlet, then filled up: a sheet for people."""
    from quillspark.operators.sampling import greedy_sheet

    f = frame(spark, d).select("doc_id", "source", "quality", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("stratum"))
    # only a cell's first rows of each outlet can ever be picked, so few go to the driver
    k = F.row_number().over(Window.partitionBy("stratum", "quality", "source").orderBy(pick_key("doc_id"), "doc_id"))
    rows = f.withColumn("k", k).where("k <= 2").withColumn("key", pick_key("doc_id")).orderBy("key", "doc_id").collect()
    picked = greedy_sheet([((r.stratum, r.quality), r.source, r.doc_id) for r in rows], 5, 2)
    return spark.createDataFrame([(s, q, o, i) for (s, q), o, i in picked], "stratum string, quality int, source string, doc_id long")


_EDGES = [200, 500, 1000, 2000, 5000]


@query("q54_binned_means", _FRAME + f""" SELECT {' + '.join(f'(n_chars > {e})::INT' for e in _EDGES)} AS bin, count(*) AS n, round(sum(lines * quality) / nullif(sum(lines), 0), 6) AS weighted, round(avg(CAST(cluster = 'en' AS INT)), 6) AS is_en, round(avg(CAST(cluster = 'es' AS INT)), 6) AS is_es, round(avg(CAST(cluster = 'fr' AS INT)), 6) AS is_fr FROM frame GROUP BY 1""")
def q54(spark, d):
    """Means by bin of fixed edges, weighted by lines; clusters as indicators without the first."""
    bin_ = sum(((F.col("n_chars") > e).cast("int") for e in _EDGES), F.lit(0))
    hot = [r6(F.avg((F.col("cluster") == c).cast("int"))).alias(f"is_{c}") for c in ("en", "es", "fr")]
    return frame(spark, d).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), r6(F.try_divide(F.sum(F.col("lines") * F.col("quality")), F.sum("lines"))).alias("weighted"), *hot)


@query("q55_centroid_distances", """WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY ALL)
  SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY ALL""")  # fmt: skip
def q55(spark, d):
    """Distances of all pairs of class means; classes are few."""
    c = cl.centroids(table(spark, d, "embeddings"), "label", "embedding")
    pairs = c.select(F.col("label").alias("a"), "i", F.col("m").alias("x")).join(c.select(F.col("label").alias("b"), "i", F.col("m").alias("y")), "i").where("a < b")
    return pairs.groupBy("a", "b").agg(r6(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))))).alias("distance"))


@query("q56_stratum_fraction", f"WITH {ARTICLES} SELECT year, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS k, count(*) OVER (PARTITION BY year) AS n FROM articles) WHERE k <= ceil(0.1 * n)")
def q56(spark, d):
    """A tenth of each year, drawn alike by any engine: the year's size first, then only ranks within it."""
    a = articles(spark, d).select("year", "doc_id")
    n = a.groupBy("year").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("year").orderBy(pick_key("doc_id"), "doc_id"))
    return a.withColumn("k", k).join(n, "year").where(F.col("k") <= F.ceil(0.1 * F.col("n"))).select("year", "doc_id")


@query("q57_cluster_quality", """WITH u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), e AS (SELECT vec_id, label, sum(x * x) AS q FROM u GROUP BY ALL), s AS (SELECT label, i, sum(x) AS s FROM u GROUP BY ALL), c AS (SELECT label, count(*) AS n, sum(q) AS q FROM e GROUP BY label),
  cc AS (SELECT label, n, q, sum(s * s) / n AS mm FROM c JOIN s USING (label) GROUP BY label, n, q), t AS (SELECT sum(n) AS n, count(*) AS k, sum(q) AS q, max(n) AS most FROM c), g AS (SELECT sum(s * s) AS s2 FROM (SELECT sum(s) AS s FROM s GROUP BY i)),
  w AS (SELECT sum(q - mm) AS w FROM cc), d AS (SELECT vec_id, u.label, s.label AS other, sum(u.x * s.s) AS xs FROM u JOIN s USING (i) GROUP BY ALL),
  m AS (SELECT d.vec_id, d.label, other, CASE WHEN d.label = other THEN (cc.n * e.q - 2 * xs + cc.q) / nullif(cc.n - 1, 0) ELSE e.q + (cc.q - 2 * xs) / cc.n END AS dist FROM d JOIN e USING (vec_id) JOIN cc ON cc.label = other),
  sil AS (SELECT vec_id, max(dist) FILTER (WHERE label = other) AS a, min(dist) FILTER (WHERE label <> other) AS b FROM m GROUP BY vec_id),
  r AS (SELECT u.vec_id, u.label, sqrt(sum((x - s / n) * (x - s / n))) AS r FROM u JOIN s ON s.i = u.i AND s.label = u.label JOIN c ON c.label = u.label GROUP BY ALL), rr AS (SELECT label, avg(r) AS r FROM r GROUP BY label),
  dd AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.s / ca.n - b.s / cb.n) * (a.s / ca.n - b.s / cb.n))) AS dist FROM s a JOIN s b ON a.i = b.i AND a.label <> b.label JOIN c ca ON ca.label = a.label JOIN c cb ON cb.label = b.label GROUP BY ALL),
  db AS (SELECT avg(worst) AS db FROM (SELECT dd.a, max((x.r + y.r) / dist) AS worst FROM dd JOIN rr x ON x.label = dd.a JOIN rr y ON y.label = dd.b GROUP BY dd.a))
  SELECT CAST(t.k AS BIGINT) AS k, CAST(t.n AS BIGINT) AS n, round(most / t.n, 6) AS max_share, round((SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM sil), 6) AS silhouette, round(((w.w * -1 + t.q - g.s2 / t.n) / (t.k - 1)) / (w.w / (t.n - t.k)), 6) AS calinski_harabasz, round(db.db, 6) AS davies_bouldin FROM t, g, w, db""")  # fmt: skip
def q57(spark, d):
    return cl.quality(table(spark, d, "embeddings").select("vec_id", "embedding", "label"), "embedding", "label")


@query("q57b_k_sweep")
def q57b(spark, d):
    """Measures for a range of cluster counts; the pick has the best silhouette with no cluster too large."""
    return cl.sweep(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", range(8, 13), limit=0.3)


@query("q57c_seed_stability")
def q57c(spark, d):
    """Agreement of fits from different starts, by pairs."""
    return cl.stability(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 10, (1, 2, 3))


@query("q57e_linkage")
def q57e(spark, d):
    """Ward's, complete and average linkage, cut into ten clusters: their sizes and how many of the topics' labels each holds."""
    rows = table(spark, d, "embeddings")
    found = lk.clustered(rows, "vec_id", "embedding", 10, most=300)
    return found.join(rows.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("method", "cluster").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@query("q57d_mutual_information")
def q57d(spark, d):
    """Adjusted mutual information and adjusted Rand index of clusters and sides, by year."""
    rows = articles(spark, d).join(F.broadcast(sides(spark)), "source").select("year", "cluster", "side")
    return cl.agreement_by(rows, "year", "cluster", "side")


_SUBSETS = [s for k in (1, 2, 3) for s in combinations((1, 2, 3), k)]
_C = f"c AS (SELECT doc_id, quality, {_RATE(0)} AS coder_1, {_RATE(1)} AS coder_2, {_RATE(2)} AS coder_3 FROM labels)"
_SUBSET_SQL = " UNION ALL ".join(f"SELECT '{'+'.join(map(str, s))}' AS coders, ({' + '.join(f'coder_{i}' for i in s)}) / {len(s)}.0 AS rating, quality FROM c" for s in _SUBSETS)


@query("q58_subset_sensitivity", f"""WITH {_C}, x AS ({_SUBSET_SQL}), r AS (SELECT coders, count(*) AS n, corr(rating, quality) AS r FROM x GROUP BY coders), p AS (SELECT (corr(coder_1, coder_2) + corr(coder_1, coder_3) + corr(coder_2, coder_3)) / 3 AS p FROM c),
  a AS (SELECT coders, n, r, abs(length(replace(coders, '+', '')) * p / (1 + (length(replace(coders, '+', '')) - 1) * p)) AS rel FROM r, p) SELECT coders, n, round(r, 6) AS r, round(sqrt(rel), 6) AS ceiling, CASE WHEN abs(r) < 0.1 THEN 'none' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' ELSE 'strong' END AS band FROM a ORDER BY abs(r) DESC, coders""")  # fmt: skip
def q58(spark, d):
    """Each set of coders against the truth, the highest correlation that their reliability allows, and the band it falls in."""
    c = coders(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    each = F.array(*[F.struct(F.lit("+".join(map(str, s))).alias("coders"), (sum((F.col(f"coder_{i}") for i in s), F.lit(0)) / len(s)).alias("rating")) for s in _SUBSETS])
    r = c.select("quality", F.explode(each).alias("x")).groupBy("x.coders").agg(F.count("*").alias("n"), F.corr("x.rating", "quality").alias("r"))
    p = c.agg(((F.corr("coder_1", "coder_2") + F.corr("coder_1", "coder_3") + F.corr("coder_2", "coder_3")) / 3).alias("p"))
    k, size = F.col("p"), F.length(F.replace("coders", F.lit("+"), F.lit("")))
    size_r = F.abs("r")
    band = F.when(size_r < 0.1, "none").when(size_r < 0.3, "weak").when(size_r < 0.5, "moderate").otherwise("strong")
    out = r.crossJoin(F.broadcast(p)).select("coders", "n", r6(F.col("r")).alias("r"), r6(F.sqrt(F.abs(size * k / (1 + (size - 1) * k)))).alias("ceiling"), band.alias("band"), size_r.alias("o"))
    return out.orderBy(F.desc("o"), "coders").drop("o")


_TWO = "p AS (SELECT doc_id, source, quality, CAST(n_chars > 500 AS INT) AS a, CAST(lines > 3 AS INT) AS b FROM frame), o AS (SELECT source, count(*) AS n, sum(CAST(a = quality AS INT)) AS ra, sum(CAST(b = quality AS INT)) AS rb FROM p GROUP BY source)"


@query("q59_paired_bootstrap", _FRAME + f""", {_TWO}, k AS (SELECT *, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS size FROM o), draws AS (SELECT rep, CAST('0x' || substr(md5('all-' || rep || '-' || k), 1, 6) AS BIGINT) % size + 1 AS k FROM k, range(1, 501) t(rep)),
  s AS (SELECT rep, sum(ra) / sum(n) AS a, sum(rb) / sum(n) AS b FROM draws JOIN k USING (k) GROUP BY rep) SELECT round((SELECT sum(ra) / sum(n) FROM o), 6) AS a, round((SELECT sum(rb) / sum(n) FROM o), 6) AS b, round(quantile_cont(a - b, 0.025), 6) AS lo, round(quantile_cont(a - b, 0.975), 6) AS hi, round(avg(CAST(a > b AS INT)), 6) AS a_better FROM s""")  # fmt: skip
def q59(spark, d):
    """Two rules on the same outlets: accuracy of each, and the interval of their difference over draws of outlets."""
    right = lambda c: F.sum((c.cast("int") == F.col("quality")).cast("int"))
    o = frame(spark, d).groupBy("source").agg(F.count("*").alias("n"), right(F.col("n_chars") > 500).alias("ra"), right(F.col("lines") > 3).alias("rb"))
    w = pt.bootstrap(o.select("source", F.lit("all").alias("side")), 500)
    s = o.join(w, "source").groupBy("rep").agg((F.sum(F.col("ra") * F.col("m")) / F.sum(F.col("n") * F.col("m"))).alias("a"), (F.sum(F.col("rb") * F.col("m")) / F.sum(F.col("n") * F.col("m"))).alias("b"))
    whole = o.agg(r6(F.sum("ra") / F.sum("n")).alias("a"), r6(F.sum("rb") / F.sum("n")).alias("b"))
    gap = F.col("a") - F.col("b")
    ends = s.agg(r6(F.percentile(gap, F.lit(0.025))).alias("lo"), r6(F.percentile(gap, F.lit(0.975))).alias("hi"), r6(F.avg((F.col("a") > F.col("b")).cast("int"))).alias("a_better"))
    return whole.crossJoin(ends)


@query("q60_permutation_importance", _FRAME + """, f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS r FROM frame),
  s AS (SELECT x.doc_id, x.quality, x.n_chars, x.lines, y.n_chars AS n2, y.lines AS l2 FROM f x JOIN f y ON x.source = y.source AND x.k = y.r), g AS (SELECT CAST(CAST(n_chars > 500 AND lines < 20 AS INT) = quality AS INT) AS base, CAST(CAST(n2 > 500 AND lines < 20 AS INT) = quality AS INT) AS no_size, CAST(CAST(n_chars > 500 AND l2 < 20 AS INT) = quality AS INT) AS no_lines FROM s)
  SELECT 'n_chars' AS feature, round(avg(base) - avg(no_size), 6) AS importance FROM g UNION ALL SELECT 'lines', round(avg(base) - avg(no_lines), 6) FROM g""")  # fmt: skip
def q60(spark, d):
    """How much a rule loses when one of its features is shuffled within outlets."""
    f = frame(spark, d).select("doc_id", "source", "quality", "n_chars", "lines")
    by = Window.partitionBy("source")
    x = f.withColumn("k", F.row_number().over(by.orderBy("doc_id")))
    y = f.select("source", F.row_number().over(by.orderBy(pick_key("doc_id"), "doc_id")).alias("k"), F.col("n_chars").alias("n2"), F.col("lines").alias("l2"))
    right = lambda n, lines: F.avg((((F.col(n) > 500) & (F.col(lines) < 20)).cast("int") == F.col("quality")).cast("int"))
    g = x.join(y, ["source", "k"]).agg(right("n_chars", "lines").alias("base"), right("n2", "lines").alias("s"), right("n_chars", "l2").alias("l"))
    return g.select(F.expr("stack(2, 'n_chars', round(base - s, 6), 'lines', round(base - l, 6)) AS (feature, importance)"))


_VARIANTS = {"base": (200, ""), "long_cells": (500, ""), "short_words": (200, "length(word) <= 8")}


def _variant(name: str) -> str:
    least, only = _VARIANTS[name]
    rows = _ROWS.replace("HAVING total >= 200", f"HAVING total >= {least}")
    if only:
        rows = rows.replace("tot AS (SELECT cluster, source, sum(n) AS total FROM cube", f"cube_ AS (SELECT * FROM cube WHERE {only}), tot AS (SELECT cluster, source, sum(n) AS total FROM cube_").replace("FROM cube JOIN tot", "FROM cube_ AS cube JOIN tot")
    return f"SELECT * FROM ({rows}, {_W1}, {_SIDE} SELECT '{name}' AS variant, cluster, round(score, 6) AS framing FROM scores)"


@query("q61_framing_variants", " UNION ALL ".join(map(_variant, _VARIANTS)))
def q61(spark, d):
    """The divergence again with larger cells only and with some words only, from one word cube."""
    words, out = stored(cube(spark, d), "cube"), None
    for name, (least, only) in _VARIANTS.items():
        rows = stored(pt.framing_words(words.where(only) if only else words, sides(spark), least, 5), "framing-rows")
        part = pt.divergence(pt.framing(rows, one_each(rows), ALPHA, 3)).select(F.lit(name).alias("variant"), "cluster", r6(F.col("score")).alias("framing"))
        out = part if out is None else out.unionByName(part)
    return out


@query("q62_table_profile", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (SELECT count(*) FROM {a}) AS rows_a, (SELECT count(*) FROM (SELECT DISTINCT {x} FROM {a} INTERSECT SELECT DISTINCT {y} FROM {b})) AS shared" for a, x, b, y in (("documents", "doc_id", "labels", "doc_id"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))))
def q62(spark, d):
    """Sizes of tables and how many keys two of them share."""
    out: DataFrame | None = None
    for a, x, b, y in (("documents", "doc_id", "labels", "doc_id"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")):
        left, right = table(spark, d, a).select(F.col(x).alias("k")), table(spark, d, b).select(F.col(y).alias("k"))
        part = left.agg(F.count("*").alias("rows_a")).crossJoin(left.intersect(right).agg(F.count("*").alias("shared"))).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rows_a", "shared")
        out = part if out is None else out.unionAll(part)
    return out
