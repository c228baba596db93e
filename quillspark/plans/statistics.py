"""Coverage, framing, reliability and agreement queries (Q26 to Q38, Q40 to Q42, Q44)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.stats import mean_rank, spearman_brown, wilson, zscore
from quillspark.operators import agreement as ag
from quillspark.operators import partisanship as pt
from quillspark.operators.ordering import ahead, correlations
from quillspark.sources.tables import stored, table

from .base import ARTICLES, BOTH, TERMS, articles, outlets, query
from .relational import HIT
from .words import CUBE, cube

r6 = lambda c: F.round(c, 6)
_FRAME = f"WITH {ARTICLES}, frame AS (SELECT a.doc_id, a.source, a.cluster, a.n_chars, len(string_split(a.text, chr(10))) AS lines, len(string_split(a.text, '!')) - 1 AS shouts, l.quality FROM articles a JOIN labels l USING (doc_id))"


def frame(spark, d) -> DataFrame:
    pieces = lambda x: F.size(F.split("text", x, -1)).cast("long")
    return articles(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "source", "cluster", "n_chars", pieces("\n").alias("lines"), (pieces("!") - 1).alias("shouts"), "quality")


@query("q26_class_descriptives", _FRAME + """ SELECT coalesce(CAST(quality AS VARCHAR), 'all') AS class, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90,
  round(avg(CAST(shouts = 0 AS INT)), 6) AS zeros FROM (SELECT * FROM frame UNION ALL SELECT doc_id, source, cluster, n_chars, lines, shouts, NULL FROM frame) GROUP BY 1""")  # fmt: skip
def q26(spark, d):
    f = frame(spark, d)
    both = f.select(F.explode(F.array(F.col("quality").cast("string"), F.lit("all"))).alias("class"), "n_chars", "shouts")
    p = lambda x: F.percentile("n_chars", F.lit(x))
    return both.groupBy("class").agg(F.count("*").alias("n"), r6(F.avg("n_chars")).alias("mean"), r6(F.stddev_samp("n_chars")).alias("sd"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), r6(F.avg((F.col("shouts") == 0).cast("int"))).alias("zeros"))


@query("q27_winsorise", _FRAME + ", e AS (SELECT quantile_cont(n_chars, 0.01) AS lo, quantile_cont(n_chars, 0.99) AS hi FROM frame) SELECT cluster, round(avg(least(greatest(n_chars, lo), hi)), 4) AS mean, round(max(least(greatest(n_chars, lo), hi)), 4) AS most, count(*) FILTER (WHERE n_chars > hi OR n_chars < lo) AS clipped FROM frame, e GROUP BY cluster")
def q27(spark, d):
    f = frame(spark, d)
    e = f.agg(F.percentile("n_chars", F.lit(0.01)).alias("lo"), F.percentile("n_chars", F.lit(0.99)).alias("hi"))
    x = F.least(F.greatest("n_chars", "lo"), "hi")
    return f.crossJoin(F.broadcast(e)).groupBy("cluster").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.max(x), 4).alias("most"), F.count_if(F.expr("n_chars > hi OR n_chars < lo")).alias("clipped"))


@query("q28_zscore_outliers", _FRAME + ", o AS (SELECT source, avg(lines) AS m, count(*) AS n FROM frame GROUP BY source), z AS (SELECT *, (m - avg(m) OVER ()) / stddev_samp(m) OVER () AS z FROM o) SELECT source, n, round(z, 6) AS z, abs(z) > 1.5 AS outlier FROM z")
def q28(spark, d):
    o = frame(spark, d).groupBy("source").agg(F.avg("lines").alias("m"), F.count("*").alias("n")).withColumn("z", zscore(F.col("m")))
    return o.select("source", "n", r6(F.col("z")).alias("z"), (F.abs("z") > 1.5).alias("outlier"))


@query("q29_outlet_centering", _FRAME + ", o AS (SELECT avg(m) AS c FROM (SELECT source, avg(quality) AS m FROM frame GROUP BY source)) SELECT doc_id, round(quality - c, 6) AS centred FROM frame, o")
def q29(spark, d):
    f = frame(spark, d)
    c = f.groupBy("source").agg(F.avg("quality").alias("m")).agg(F.avg("m").alias("c"))
    return f.crossJoin(F.broadcast(c)).select("doc_id", r6(F.col("quality") - F.col("c")).alias("centred"))


ALPHA = 100.0
COUNTS = f"""{BOTH}, counts AS (SELECT source, cluster, count(*) AS n FROM articles GROUP BY ALL), totals AS (SELECT source, sum(n) AS total FROM counts GROUP BY source),
  shares AS (SELECT t.source, c.cluster, coalesce(n, 0) AS n, total, coalesce(n, 0) / total AS s FROM totals t CROSS JOIN (SELECT DISTINCT cluster FROM counts) c LEFT JOIN counts USING (source, cluster))"""  # fmt: skip
_SUMS = """SELECT rep, cluster, sum(m * s) FILTER (WHERE side = 'right') / sum(m) FILTER (WHERE side = 'right') AS pr, sum(m * s) FILTER (WHERE side = 'left') / sum(m) FILTER (WHERE side = 'left') AS pl,
  sum(m * total) FILTER (WHERE side = 'right') AS nr, sum(m * total) FILTER (WHERE side = 'left') AS nl, 100.0 * sum(m * s) / sum(m) AS a FROM shares JOIN weights USING (source) GROUP BY rep, cluster"""
_DELTA = "ln((pr * nr + a) / (nr + 100 - pr * nr - a)) - ln((pl * nl + a) / (nl + 100 - pl * nl - a))"
DELTA = f"sums AS ({_SUMS}), deltas AS (SELECT rep, cluster, {_DELTA} AS delta, ({_DELTA}) / sqrt(1 / (pr * nr + a) + 1 / (pl * nl + a)) AS z, pr * nr = 0 OR pl * nl = 0 AS zero FROM sums)"
ONE = "weights AS (SELECT 0 AS rep, source, side, 1 AS m FROM outlets)"


def counts(spark, d) -> DataFrame:
    return articles(spark, d).groupBy("source", "cluster").agg(F.count("*").alias("n"))


def sides(spark) -> DataFrame:
    return outlets(spark).select("source", "side")


def one(spark) -> DataFrame:
    return sides(spark).select(F.lit(0).alias("rep"), "source", "side", F.lit(1).alias("m"))


@query("q30_coverage_delta", f"WITH {COUNTS}, {ONE}, {DELTA} SELECT cluster, round(delta, 6) AS delta, round(z, 6) AS z, zero FROM deltas")
def q30(spark, d):
    return pt.delta(pt.shares(counts(spark, d)), one(spark), ALPHA).select("cluster", r6(F.col("delta")).alias("delta"), r6(F.col("z")).alias("z"), "zero")


@query("q30b_merged_other", f"WITH {COUNTS.replace('SELECT source, cluster, count(*) AS n FROM articles GROUP BY ALL', 'SELECT source, CASE WHEN cluster IN (' + chr(39) + 'es' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + ') THEN ' + chr(39) + 'other' + chr(39) + ' ELSE cluster END AS cluster, count(*) AS n FROM articles GROUP BY ALL')}, {ONE}, {DELTA} SELECT cluster, round(delta, 6) AS delta FROM deltas")
def q30b(spark, d):
    merged = counts(spark, d).groupBy("source", F.when(F.col("cluster").isin("es", "fr"), "other").otherwise(F.col("cluster")).alias("cluster")).agg(F.sum("n").alias("n"))
    return pt.delta(pt.shares(merged), one(spark), ALPHA).select("cluster", r6(F.col("delta")).alias("delta"))


_SCHEMES = """w AS (SELECT source, side, total, quantile_cont(total, 0.9) OVER () AS q FROM totals JOIN outlets USING (source)),
  schemes AS (SELECT 1 AS rep, source, side, 1.0 AS m FROM w UNION ALL SELECT 2, source, side, sqrt(total) FROM w UNION ALL SELECT 3, source, side, total FROM w UNION ALL SELECT 4, source, side, least(total, q) FROM w UNION ALL SELECT 5, source, side, 1.0 FROM w WHERE total >= 45)"""
_SUM2 = """sums AS (SELECT rep, cluster, sum(m * s) FILTER (WHERE side = 'right') / sum(m) FILTER (WHERE side = 'right') AS pr, sum(m * s) FILTER (WHERE side = 'left') / sum(m) FILTER (WHERE side = 'left') AS pl,
  sum(total) FILTER (WHERE side = 'right') AS nr, sum(total) FILTER (WHERE side = 'left') AS nl, 100.0 * sum(m * s) / sum(m) AS a FROM shares JOIN schemes USING (source) GROUP BY rep, cluster)"""
_TRIM = """ranked AS (SELECT cluster, side, s, row_number() OVER (PARTITION BY cluster, side ORDER BY s, source) AS k, count(*) OVER (PARTITION BY cluster, side) AS c FROM shares JOIN outlets USING (source)),
  trim0 AS (SELECT cluster, side, avg(s) AS p FROM ranked WHERE k > floor(0.1 * c) AND k <= c - floor(0.1 * c) GROUP BY ALL), pi0 AS (SELECT cluster, avg(s) AS pi FROM shares GROUP BY cluster),
  n0 AS (SELECT sum(total) FILTER (WHERE side = 'right') AS nr, sum(total) FILTER (WHERE side = 'left') AS nl FROM totals JOIN outlets USING (source)),
  trimmed AS (SELECT 6 AS rep, r.cluster, r.p / sum(r.p) OVER () AS pr, l.p / sum(l.p) OVER () AS pl, nr, nl, 100.0 * pi / sum(pi) OVER () AS a FROM trim0 r JOIN trim0 l ON r.cluster = l.cluster AND r.side = 'right' AND l.side = 'left' JOIN pi0 ON pi0.cluster = r.cluster, n0),
  odds AS (SELECT cluster, side, avg(ln(sm / (1 - sm))) AS o FROM (SELECT shares.cluster, side, (s * total + 20 * pi) / (total + 20) AS sm FROM shares JOIN outlets USING (source) JOIN pi0 USING (cluster)) GROUP BY ALL)"""
_NAMES = "['equal', 'sqrt_n', 'pooled', 'capped', 'big_only', 'trim10'][rep]"


@query("q31_weighting_schemes", f"""WITH {COUNTS}, {_SCHEMES}, {_SUM2}, {_TRIM}, every AS (SELECT * FROM sums UNION ALL SELECT * FROM trimmed), named AS (SELECT {_NAMES} AS scheme, cluster, {_DELTA} AS delta FROM every
  UNION ALL SELECT 'mean_logodds', r.cluster, r.o - l.o FROM odds r JOIN odds l ON r.cluster = l.cluster AND r.side = 'right' AND l.side = 'left')
  SELECT scheme, cluster, round(delta, 6) AS delta, CAST(row_number() OVER (PARTITION BY scheme ORDER BY round(delta, 6) DESC, cluster) AS INTEGER) AS rank FROM named""")  # fmt: skip
def q31(spark, d):
    s = pt.shares(counts(spark, d)).join(F.broadcast(sides(spark)), "source")
    totals = s.select("source", "side", "total").distinct()
    q = totals.agg(F.percentile("total", F.lit(0.9)).alias("q"))
    w = s.crossJoin(F.broadcast(q))
    schemes = {"equal": F.lit(1.0), "sqrt_n": F.sqrt("total"), "pooled": F.col("total").cast("double"), "capped": F.least(F.col("total").cast("double"), "q"), "big_only": F.when(F.col("total") >= 45, 1.0)}
    long = w.select("source", "side", "cluster", "s", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), v.cast("double").alias("m")) for k, v in schemes.items()])).alias("x")).select("source", "side", "cluster", "s", "total", "x.*").where("m IS NOT NULL")
    on = lambda side, x: F.sum(F.when(F.col("side") == side, x))
    m = F.col("m")
    sums = long.groupBy("scheme", "cluster").agg((on("right", m * F.col("s")) / on("right", m)).alias("pr"), (on("left", m * F.col("s")) / on("left", m)).alias("pl"), on("right", F.col("total")).alias("nr"), on("left", F.col("total")).alias("nl"), (ALPHA * F.sum(m * F.col("s")) / F.sum(m)).alias("a"))
    by = Window.partitionBy("cluster", "side")
    cut = F.floor(0.1 * F.count("*").over(by))
    k = F.row_number().over(by.orderBy("s", "source"))
    kept = s.withColumn("keep", (k > cut) & (k <= F.count("*").over(by) - cut)).where("keep").groupBy("cluster").agg(F.avg(F.when(F.col("side") == "right", F.col("s"))).alias("r"), F.avg(F.when(F.col("side") == "left", F.col("s"))).alias("l"))
    pi = s.groupBy("cluster").agg(F.avg("s").alias("pi"))
    n = totals.agg(on("right", F.col("total")).alias("nr"), on("left", F.col("total")).alias("nl"))
    every = Window.partitionBy()
    trimmed = kept.join(pi, "cluster").crossJoin(n).select(F.lit("trim10").alias("scheme"), "cluster", (F.col("r") / F.sum("r").over(every)).alias("pr"), (F.col("l") / F.sum("l").over(every)).alias("pl"), "nr", "nl", (ALPHA * F.col("pi") / F.sum("pi").over(every)).alias("a"))
    x = sums.unionByName(trimmed)
    delta = pt.log_odds(F.col("pr") * F.col("nr"), F.col("nr"), F.col("a"), ALPHA) - pt.log_odds(F.col("pl") * F.col("nl"), F.col("nl"), F.col("a"), ALPHA)
    sm = (F.col("s") * F.col("total") + 20 * F.col("pi")) / (F.col("total") + 20)
    odds = s.join(F.broadcast(pi), "cluster").withColumn("lo", F.ln(sm / (1 - sm))).groupBy("cluster").agg((F.avg(F.when(F.col("side") == "right", F.col("lo"))) - F.avg(F.when(F.col("side") == "left", F.col("lo")))).alias("delta"))
    out = x.select("scheme", "cluster", delta.alias("delta")).unionByName(odds.select(F.lit("mean_logodds").alias("scheme"), "cluster", "delta"))
    return out.select("scheme", "cluster", r6(F.col("delta")).alias("delta"), F.row_number().over(Window.partitionBy("scheme").orderBy(F.desc(r6(F.col("delta"))), "cluster")).alias("rank"))


@query("q32_correlations", _FRAME + """, k AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rx, rank() OVER (ORDER BY lines) + (count(*) OVER (PARTITION BY lines) - 1) / 2.0 AS ry FROM frame)
  SELECT count(*) AS n, round(corr(n_chars, lines), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k""")  # fmt: skip
def q32(spark, d):
    c = correlations(frame(spark, d), "n_chars", "lines")
    return c.select("n", r6(F.col("pearson")).alias("pearson"), r6(F.col("spearman")).alias("spearman"))


#: Replicates of split halves, bootstraps and permutations.
HALVES, BOOTS, PERMUTATIONS = 200, 1000, 40
_HALVES = f"halves AS (SELECT rep, source, side, row_number() OVER (PARTITION BY rep, side ORDER BY md5(source || '-' || rep), source) % 2 AS half FROM outlets, range(1, {HALVES + 1}) t(rep))"


@query("q33_split_half_reliability", f"WITH {COUNTS}, {_HALVES}, weights AS (SELECT CAST(rep * 2 + half AS INTEGER) AS rep, source, side, 1 AS m FROM halves), {DELTA}, r AS (SELECT x.rep // 2 AS rep, corr(x.delta, y.delta) AS r FROM deltas x JOIN deltas y ON x.rep % 2 = 0 AND y.rep = x.rep + 1 AND x.cluster = y.cluster GROUP BY 1) SELECT count(*) AS reps, round(avg(r), 6) AS r, round(avg(2 * r / (1 + r)), 5) AS reliability FROM r")
def q33(spark, d):
    reps = pt.replicates(sides(spark), HALVES)
    half = pt.shuffled(F.md5(F.concat_ws("-", F.col("source"), F.col("rep").cast("string"))), "rep", "side") % 2
    w = reps.withColumn("half", half).select((F.col("rep") * 2 + F.col("half")).alias("rep"), "source", "side", F.lit(1).alias("m"))
    x = pt.delta(pt.shares(counts(spark, d)), w, ALPHA).groupBy(F.floor(F.col("rep") / 2).alias("rep"), "cluster").agg(F.max(F.when(F.col("rep") % 2 == 0, F.col("delta"))).alias("a"), F.max(F.when(F.col("rep") % 2 == 1, F.col("delta"))).alias("b"))
    r = x.groupBy("rep").agg(F.corr("a", "b").alias("r"))
    return r.agg(F.count("*").alias("reps"), r6(F.avg("r")).alias("r"), F.round(F.avg(spearman_brown(F.col("r"))), 5).alias("reliability"))


@query("q34_icc_eta2", _FRAME + """, x AS (SELECT source, cluster, quality, ln(n_chars + 1) AS v FROM frame), g AS (SELECT source, count(*) AS n, avg(v) AS m, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY source), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * n) AS n2, sum(s) / sum(n) AS m FROM g),
  b AS (SELECT sum(g.n * (g.m - t.m) * (g.m - t.m)) / max(k - 1) AS msb, sum(q - s * s / g.n) / max(nn - k) AS msw, max((nn - n2 / nn) / (k - 1)) AS n0 FROM g, t), e AS (SELECT quality, avg(v) AS m, count(*) AS n FROM x GROUP BY quality)
  SELECT round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc, round((SELECT sum(e.n * (e.m - t.m) * (e.m - t.m)) FROM e, t) / (SELECT sum((v - t.m) * (v - t.m)) FROM x, t), 6) AS eta2 FROM b""")  # fmt: skip
def q34(spark, d):
    x = frame(spark, d).select("source", "quality", F.ln(F.col("n_chars") + 1).alias("v"))
    sums = [F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")]
    cells = x.groupBy("source", "quality").agg(*sums)
    again = [F.sum(c).alias(c) for c in ("n", "s", "q")]
    g, e = cells.groupBy("source").agg(*again), cells.groupBy("quality").agg(*again)
    t = g.agg(F.sum("n").alias("nn"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), (F.sum("s") / F.sum("n")).alias("m"), F.sum("q").alias("qq"))
    between = lambda f: f.crossJoin(t).agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("ssb"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("ssw"))
    b = between(g).crossJoin(t).crossJoin(between(e).select(F.col("ssb").alias("ssq")))
    msb, msw, n0 = F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("nn") - F.col("k")), (F.col("nn") - F.col("n2") / F.col("nn")) / (F.col("k") - 1)
    return b.select(r6((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"), r6(F.col("ssq") / (F.col("qq") - F.col("nn") * F.col("m") * F.col("m"))).alias("eta2"))


_BOOT = f"""ranked AS (SELECT source, side, row_number() OVER (PARTITION BY side ORDER BY source) AS k, count(*) OVER (PARTITION BY side) AS size FROM outlets),
  draws AS (SELECT CAST(rep AS INTEGER) AS rep, side, CAST('0x' || substr(md5(side || '-' || rep || '-' || k), 1, 6) AS BIGINT) % size + 1 AS k FROM ranked, range(1, {BOOTS + 1}) t(rep)),
  weights AS (SELECT rep, source, ranked.side, count(*) AS m FROM draws JOIN ranked ON draws.side = ranked.side AND draws.k = ranked.k GROUP BY ALL)"""


@query("q35_bootstrap_ci", f"WITH {COUNTS}, {_BOOT}, {DELTA} SELECT cluster, count(*) AS reps, round(median(delta), 6) AS middle, round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi FROM deltas GROUP BY cluster")
def q35(spark, d):
    x = pt.delta(pt.shares(counts(spark, d)), pt.bootstrap(sides(spark), BOOTS), ALPHA)
    p = lambda q: r6(F.percentile("delta", F.lit(q)))
    return x.groupBy("cluster").agg(F.count("*").alias("reps"), r6(F.median("delta")).alias("middle"), p(0.025).alias("lo"), p(0.975).alias("hi"))


_ROWS = f"""WITH {BOTH}, {CUBE}, tot AS (SELECT cluster, source, sum(n) AS total FROM cube GROUP BY ALL HAVING total >= 200), r0 AS (SELECT cube.*, total, side FROM cube JOIN tot USING (cluster, source) JOIN outlets USING (source)),
  kept AS (SELECT cluster, word FROM r0 GROUP BY ALL HAVING sum(n) >= 5), rows AS (SELECT r0.* FROM r0 JOIN kept USING (cluster, word)), cells AS (SELECT DISTINCT cluster, source, total, side FROM rows),
  pr AS (SELECT r.cluster, word, sum(n / total) / max(k) AS raw FROM rows r JOIN (SELECT cluster, count(*) AS k FROM cells GROUP BY cluster) USING (cluster) GROUP BY ALL), pi AS (SELECT cluster, word, raw / sum(raw) OVER (PARTITION BY cluster) AS pi FROM pr)"""  # fmt: skip
_SIDE = """sd AS (SELECT rep, w.cluster, sum(m) FILTER (WHERE w.side = 'right') AS mr, sum(m) FILTER (WHERE w.side = 'left') AS ml, sum(m * total) FILTER (WHERE w.side = 'right') AS nr, sum(m * total) FILTER (WHERE w.side = 'left') AS nl
    FROM weights w JOIN cells c ON w.cluster = c.cluster AND w.source = c.source GROUP BY ALL HAVING count(*) FILTER (WHERE w.side = 'right') >= 3 AND count(*) FILTER (WHERE w.side = 'left') >= 3),
  used AS (SELECT rep, r.cluster, word, coalesce(sum(m * n / total) FILTER (WHERE w.side = 'right'), 0) AS xr, coalesce(sum(m * n / total) FILTER (WHERE w.side = 'left'), 0) AS xl FROM rows r JOIN weights w ON r.cluster = w.cluster AND r.source = w.source GROUP BY ALL),
  wd AS (SELECT sd.rep, sd.cluster, pi.word, pi, nr, nl, 100 * pi AS a, coalesce(xr, 0) / mr * nr AS yr, coalesce(xl, 0) / ml * nl AS yl FROM sd JOIN pi USING (cluster) LEFT JOIN used u ON u.rep = sd.rep AND u.cluster = sd.cluster AND u.word = pi.word),
  words_z AS (SELECT rep, cluster, word, pi, ln((yr + a) / (nr + 100 - yr - a)) - ln((yl + a) / (nl + 100 - yl - a)) AS delta, (ln((yr + a) / (nr + 100 - yr - a)) - ln((yl + a) / (nl + 100 - yl - a))) / sqrt(1 / (yr + a) + 1 / (yl + a)) AS z FROM wd),
  scores AS (SELECT rep, cluster, sum(pi * abs(delta)) AS score FROM words_z GROUP BY ALL)"""  # fmt: skip
_W1 = "weights AS (SELECT 0 AS rep, cluster, source, side, 1 AS m FROM cells)"


def framing_rows(spark, d) -> DataFrame:
    return stored(pt.framing_words(cube(spark, d), sides(spark), 200, 5), "framing-rows")


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.select("cluster", "source", "side").distinct()


def one_each(rows: DataFrame) -> DataFrame:
    return cells_of(rows).select(F.lit(0).alias("rep"), "cluster", "source", "side", F.lit(1).alias("m"))


@query("q36_framing_divergence", f"{_ROWS}, {_W1}, {_SIDE} SELECT cluster, round(score, 6) AS framing FROM scores")
def q36(spark, d):
    rows = framing_rows(spark, d)
    return pt.divergence(pt.framing(rows, one_each(rows), ALPHA, 3)).select("cluster", r6(F.col("score")).alias("framing"))


@query("q36b_distinctive_words", f"{_ROWS}, {_W1}, {_SIDE}, k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 6) DESC, word) AS up, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 6), word) AS down FROM words_z) SELECT cluster, CASE WHEN up <= 8 THEN 'right' ELSE 'left' END AS side, word, round(z, 6) AS z FROM k WHERE up <= 8 OR down <= 8")
def q36b(spark, d):
    rows = framing_rows(spark, d)
    z = pt.framing(rows, one_each(rows), ALPHA, 3).select("cluster", "word", r6(F.col("z")).alias("z"))
    k = lambda o: F.row_number().over(Window.partitionBy("cluster").orderBy(o, "word"))
    x = z.withColumn("up", k(F.desc("z"))).withColumn("down", k(F.asc("z"))).where("up <= 8 OR down <= 8")
    return x.select("cluster", F.when(F.col("up") <= 8, "right").otherwise("left").alias("side"), "word", "z")


@query("q36c_word_lift", f"WITH {ARTICLES}, {CUBE}, c AS (SELECT cluster, word, sum(n) AS n FROM cube GROUP BY ALL) SELECT cluster, word, CAST(n AS BIGINT) AS n, round((n / sum(n) OVER (PARTITION BY cluster)) / (sum(n) OVER (PARTITION BY word) / sum(n) OVER ()), 6) AS lift FROM c QUALIFY n >= 20")
def q36c(spark, d):
    c = stored(cube(spark, d).groupBy("cluster", "word").agg(F.sum("n").alias("n")), "cluster-words")
    by_c, by_w = c.groupBy("cluster").agg(F.sum("n").alias("cn")), c.groupBy("word").agg(F.sum("n").alias("wn"))
    total = by_c.agg(F.sum("cn").alias("tn"))
    return c.where("n >= 20").join(F.broadcast(by_c), "cluster").join(by_w, "word").crossJoin(F.broadcast(total)).select("cluster", "word", "n", r6((F.col("n") / F.col("cn")) / (F.col("wn") / F.col("tn"))).alias("lift"))


_PERM = f"""lr AS (SELECT *, count(*) FILTER (WHERE side = 'left') OVER (PARTITION BY cluster) AS nleft FROM cells WHERE side <> 'centre'),
  weights AS (SELECT 0 AS rep, cluster, source, side, 1 AS m FROM lr UNION ALL SELECT CAST(rep AS INTEGER), cluster, source, CASE WHEN row_number() OVER (PARTITION BY rep, cluster ORDER BY md5(source || '-' || rep), source) <= nleft THEN 'left' ELSE 'right' END, 1 FROM lr, range(1, {PERMUTATIONS + 1}) t(rep))"""


@query("q37_framing_permuted", f"{_ROWS}, {_PERM}, {_SIDE} SELECT cluster, round(max(score) FILTER (WHERE rep = 0), 6) AS observed, round(avg(score) FILTER (WHERE rep > 0), 6) AS null_mean, round(max(score) FILTER (WHERE rep = 0) - avg(score) FILTER (WHERE rep > 0), 6) AS adjusted FROM scores GROUP BY cluster")
def q37(spark, d):
    rows = framing_rows(spark, d)
    lr = cells_of(rows).where("side <> 'centre'")
    lr = lr.withColumn("nleft", F.count_if(F.col("side") == "left").over(Window.partitionBy("cluster")))
    perm = pt.replicates(lr, PERMUTATIONS).withColumn("k", pt.shuffled(F.md5(F.concat_ws("-", F.col("source"), F.col("rep").cast("string"))), "rep", "cluster"))
    w = lr.select(F.lit(0).alias("rep"), "cluster", "source", "side", F.lit(1).alias("m")).unionByName(perm.select("rep", "cluster", "source", F.when(F.col("k") <= F.col("nleft"), "left").otherwise("right").alias("side"), F.lit(1).alias("m")))
    s = pt.divergence(pt.framing(rows, w, ALPHA, 3))
    seen, null = F.max(F.when(F.col("rep") == 0, F.col("score"))), F.avg(F.when(F.col("rep") > 0, F.col("score")))
    return s.groupBy("cluster").agg(r6(seen).alias("observed"), r6(null).alias("null_mean"), r6(seen - null).alias("adjusted"))


_W = "(p + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)"


@query("q38_filter_validation", f"""WITH {ARTICLES}, f AS (SELECT {HIT} AS pred, quality = 1 AS truth FROM articles JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE pred AND truth) AS tp, count(*) FILTER (WHERE pred AND NOT truth) AS fp, count(*) FILTER (WHERE truth AND NOT pred) AS fn FROM f),
  m AS (SELECT 'precision' AS measure, tp AS hits, tp + fp AS n FROM c UNION ALL SELECT 'recall', tp, tp + fn FROM c), p AS (SELECT *, hits / n AS p FROM m) SELECT measure, hits, n, round(p, 6) AS value, round({_W.format(s='-')}, 6) AS lo, round({_W.format(s='+')}, 6) AS hi FROM p""")  # fmt: skip
def q38(spark, d):
    f = articles(spark, d).join(table(spark, d, "labels"), "doc_id").select(tx.about(F.col("title"), TERMS).alias("pred"), (F.col("quality") == 1).alias("truth"))
    c = f.agg(F.count_if(F.expr("pred AND truth")).alias("tp"), F.count_if(F.expr("pred AND NOT truth")).alias("fp"), F.count_if(F.expr("truth AND NOT pred")).alias("fn"))
    m = c.select(F.expr("stack(2, 'precision', tp, tp + fp, 'recall', tp, tp + fn) AS (measure, hits, n)"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return m.select("measure", "hits", "n", r6(F.try_divide("hits", "n")).alias("value"), r6(lo).alias("lo"), r6(hi).alias("hi"))


#: Coder k rates a label's quality and toxicity, 0 to 4, and slips by up to k - 1 from the scale's true place.
_RATE = lambda k: f"least(4, greatest(0, 3 * quality + 1 - toxic + CAST('0x' || substr(md5(CAST(doc_id // {k + 2} AS VARCHAR) || '-c'), 1, 6) AS BIGINT) % {2 * k + 1} - {k}))"
_PAIR = f"WITH x AS (SELECT {_RATE(0)} AS y, {_RATE(1)} AS p FROM labels), c AS (SELECT y, p, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT y, sum(n) AS rn FROM c GROUP BY y), k AS (SELECT p, sum(n) AS cn FROM c GROUP BY p)"


def coders(spark, d) -> DataFrame:
    """Three coders of the labels with scores 0 to 4: the first as labelled, the others with slips."""
    code = lambda k: F.conv(F.substring(F.md5(F.concat(F.floor(F.col("doc_id") / (k + 2)).cast("string"), F.lit("-c"))), 1, 6), 16, 10).cast("long")
    true = 3 * F.col("quality") + 1 - F.col("toxic")
    rate = lambda k: F.least(F.lit(4), F.greatest(F.lit(0), true + code(k) % (2 * k + 1) - k)).alias(f"coder_{k + 1}")
    return table(spark, d, "labels").select("doc_id", *[rate(k) for k in range(3)])


@query("q38b_qwk", _PAIR + """ SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n, round(1 - (SELECT sum((y - p) * (y - p) / 16.0 * n) FROM c) * (SELECT sum(n) FROM c) / (SELECT sum((y - p) * (y - p) / 16.0 * rn * cn) FROM r, k), 6) AS qwk,
  round((SELECT sum(n) FILTER (WHERE y = p) / sum(n) FROM c), 6) AS accuracy, round((SELECT sum(n) FILTER (WHERE abs(y - p) <= 1) / sum(n) FROM c), 6) AS within_one,
  round((SELECT avg(2.0 * coalesce(tp, 0) / (coalesce(rn, 0) + coalesce(cn, 0))) FROM (SELECT coalesce(r.y, k.p) AS g, rn, cn FROM r FULL JOIN k ON r.y = k.p) LEFT JOIN (SELECT y AS g, n AS tp FROM c WHERE y = p) USING (g)), 6) AS macro_f1""")  # fmt: skip
def q38b(spark, d):
    return ag.kappa(ag.confusion(coders(spark, d), "coder_1", "coder_2"), 5)


@query("q40_coder_agreement", f"""WITH x AS (SELECT doc_id, {_RATE(0)} AS a, {_RATE(1)} AS b, {_RATE(2)} AS c, row_number() OVER (ORDER BY doc_id) AS k FROM labels) SELECT CAST((k - 1) // 20 AS BIGINT) AS block, count(*) AS n, round(avg((a + b + c) / 3.0), 6) AS mean,
  round(avg(CAST(a = b AND b = c AS INT)), 6) AS exact, round(avg(CAST(abs(a - b) <= 1 AS INT)), 6) AS near_ab, round(avg(CAST(abs(b - c) <= 1 AS INT)), 6) AS near_bc FROM x GROUP BY 1""")  # fmt: skip
def q40(spark, d):
    x = ahead(coders(spark, d), ["doc_id"], "k")
    near = lambda a, b: r6(F.avg((F.abs(F.col(a) - F.col(b)) <= 1).cast("int")))
    return x.groupBy(F.floor(F.col("k") / 20).alias("block")).agg(F.count("*").alias("n"), r6(F.avg((F.col("coder_1") + F.col("coder_2") + F.col("coder_3")) / 3)).alias("mean"), r6(F.avg(F.expr("coder_1 = coder_2 AND coder_2 = coder_3").cast("int"))).alias("exact"), near("coder_1", "coder_2").alias("near_ab"), near("coder_2", "coder_3").alias("near_bc"))


@query("q41_leave_one_out", f"WITH {COUNTS}, lo AS (SELECT CAST(substr(source, 4) AS INTEGER) AS rep, source AS gone FROM outlets), weights AS (SELECT rep, source, side, 1 AS m FROM outlets JOIN lo ON source <> gone), {DELTA} SELECT 'src' || rep AS gone, cluster, round(delta, 6) AS delta FROM deltas")
def q41(spark, d):
    o = sides(spark)
    gone = F.broadcast(o.select(F.substring("source", 4, 9).cast("int").alias("rep"), F.col("source").alias("gone")))
    w = o.join(gone, F.col("source") != F.col("gone")).select("rep", "source", "side", F.lit(1).alias("m"))
    return pt.delta(pt.shares(counts(spark, d)), w, ALPHA).select(F.concat(F.lit("src"), F.col("rep").cast("string")).alias("gone"), "cluster", r6(F.col("delta")).alias("delta"))


@query("q42_centroid_assignment", """WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS k, i, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY ALL), l AS (SELECT k, sqrt(sum(m * m)) AS len FROM c GROUP BY k),
  s AS (SELECT vec_id, c.k, sum(x * m) / max(len) AS dot FROM u JOIN c USING (i) JOIN l USING (k) GROUP BY ALL) SELECT vec_id, CAST(k AS INTEGER) AS nearest, round(dot, 5) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dot, 8) DESC, k) AS r FROM s) WHERE r = 1""")  # fmt: skip
def q42(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    c = c.select("label", "c", F.sqrt(dot(F.col("c"), F.col("c"))).alias("len"))
    # centroids are few and of fixed length: one row of them is broadcast, each vector picks its best without a shuffle
    every = c.agg(F.array_sort(F.collect_list(F.struct("label", "c", "len"))).alias("cs"))
    best = F.array_sort(F.transform("cs", lambda k: F.struct((-F.round(dot(F.col("v"), k["c"]) / k["len"], 8)).alias("d"), k["label"].alias("k"), (dot(F.col("v"), k["c"]) / k["len"]).alias("dot"))))[0]
    return e.crossJoin(F.broadcast(every)).select("vec_id", best.alias("b")).select("vec_id", F.col("b.k").cast("int").alias("nearest"), F.round("b.dot", 5).alias("dot"))


_P = lambda i: f"(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '-p{i}'), 1, 6) AS BIGINT) % 1000 + 1)"


@query("q44_outlet_argmax", f"""WITH {BOTH}, p AS (SELECT source, {', '.join(f'{_P(i)} / ({_P(0)} + {_P(1)} + {_P(2)}) AS p{i}' for i in range(3))} FROM articles), m AS (SELECT source, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM p GROUP BY source),
  g AS (SELECT source, side, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred, CASE side WHEN 'left' THEN 0 WHEN 'centre' THEN 1 ELSE 2 END AS truth FROM m JOIN outlets USING (source))
  SELECT side, count(*) AS n, round(avg(CAST(pred = truth AS INT)), 6) AS accuracy, round(avg(abs(pred - truth)), 6) AS mae, round(avg(pred - truth), 6) AS signed, string_agg(DISTINCT CAST(pred AS VARCHAR), ',' ORDER BY CAST(pred AS VARCHAR)) AS classes FROM g GROUP BY side""")  # fmt: skip
def q44(spark, d):
    p = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"-p{i}"))), 1, 6), 16, 10).cast("long") % 1000 + 1
    total = p(0) + p(1) + p(2)
    m = articles(spark, d).groupBy("source").agg(*[F.avg(p(i) / total).alias(f"p{i}") for i in range(3)])
    ps = F.array("p0", "p1", "p2")
    g = m.join(F.broadcast(sides(spark)), "source").select("side", (F.array_position(ps, F.array_max(ps)) - 1).alias("pred"), F.when(F.col("side") == "left", 0).when(F.col("side") == "centre", 1).otherwise(2).alias("truth"))
    gap = F.col("pred") - F.col("truth")
    return g.groupBy("side").agg(F.count("*").alias("n"), r6(F.avg((gap == 0).cast("int"))).alias("accuracy"), r6(F.avg(F.abs(gap))).alias("mae"), r6(F.avg(gap)).alias("signed"), F.array_join(F.sort_array(F.collect_set(F.col("pred").cast("string"))), ",").alias("classes"))
