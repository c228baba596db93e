"""Scans, filters, joins, aggregates, sets and headline queries (Q01 to Q12, Q20 to Q25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.stats import pick_key
from quillspark.sources.tables import describe_schema, table

from .base import ARTEFACTS_SQL, ARTICLES, BOTH, OUTLETS, TERMS, articles, outlets, query, terms_sql, title_sql

HIT = f"regexp_matches({title_sql()}, '{terms_sql(TERMS)}')"
r6 = lambda c: F.round(c, 6)


@query("q01_scan_project", "SELECT doc_id, source, lang, n_chars AS length FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 2000 AND text IS NOT NULL AND trim(text) <> '' AND source NOT LIKE 'src1_'")
def q01(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isin("en", "de") & F.col("n_chars").between(200, 2000) & F.col("text").isNotNull() & (F.trim("text") != "") & ~F.col("source").like("src1_")).select("doc_id", "source", "lang", F.col("n_chars").alias("length"))


@query("q02_schema_describe")
def q02(spark, d):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    parts = [describe_schema(spark, table(spark, d, n), n) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("q03_manifest_left_join", f"""WITH {BOTH}, a AS (SELECT source, count(*) AS n, min(n_chars) AS least, median(n_chars) AS middle, max(n_chars) AS most, count(DISTINCT year) AS years FROM articles WHERE cluster = 'es' GROUP BY source)
  SELECT o.source, o.bias, coalesce(a.n, 0) AS n, least, middle, most, coalesce(years, 0) AS years FROM outlets o LEFT JOIN a USING (source) ORDER BY n DESC NULLS LAST, source""")  # fmt: skip
def q03(spark, d):
    a = articles(spark, d).where("cluster = 'es'").groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.median("n_chars").alias("middle"), F.max("n_chars").alias("most"), F.count_distinct("year").alias("years"))
    return outlets(spark).join(a, "source", "left").select("source", "bias", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "least", "middle", "most", F.coalesce("years", F.lit(0)).cast("long").alias("years")).orderBy(F.desc_nulls_last("n"), "source")


@query("q04_filtered_counts", f"""WITH {BOTH}, f AS (SELECT o.side, a.n_chars, {HIT} AS hit, regexp_matches({title_sql()}, '{terms_sql(TERMS[:4])}') AS hit1 FROM articles a JOIN outlets o USING (source))
  SELECT side, count(*) AS n, count(*) FILTER (WHERE hit1) AS v1, count(*) FILTER (WHERE hit) AS v2, count(*) FILTER (WHERE hit AND n_chars > 1000) AS long_hits, count(*) FILTER (WHERE hit1 AND NOT hit) AS lost,
  round(100.0 * (count(*) FILTER (WHERE hit) - count(*) FILTER (WHERE hit1)) / nullif(count(*) FILTER (WHERE hit1), 0), 6) AS gain FROM f GROUP BY side""")  # fmt: skip
def q04(spark, d):
    rows = articles(spark, d).join(F.broadcast(outlets(spark)), "source").select("side", "n_chars", tx.about(F.col("title"), TERMS).alias("hit"), tx.about(F.col("title"), TERMS[:4]).alias("hit1"))
    out = rows.groupBy("side").agg(F.count("*").alias("n"), F.count_if("hit1").alias("v1"), F.count_if("hit").alias("v2"), F.count_if(F.expr("hit AND n_chars > 1000")).alias("long_hits"), F.count_if(F.expr("hit1 AND NOT hit")).alias("lost"))
    return out.withColumn("gain", r6(F.try_divide(100.0 * (F.col("v2") - F.col("v1")), F.col("v1"))))


_RATED = f"""WITH {BOTH}, c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE {HIT}) AS n_political FROM articles GROUP BY source),
  r AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(n_political, 0) AS n_political, coalesce(n_political, 0) / greatest(coalesce(n, 0), 1) AS share FROM outlets o LEFT JOIN c USING (source))"""


def rated(spark, d) -> DataFrame:
    hit = tx.about(F.col("title"), TERMS)
    c = articles(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_political"))
    out = outlets(spark).join(c, "source", "left").withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in ("n", "n_political")})
    return out.withColumn("share", F.col("n_political") / F.greatest("n", F.lit(1)))


@query("q05_funnel_reason", _RATED + """ SELECT source, n, n_political, CASE WHEN bias IS NULL THEN 'no bias rating' WHEN factuality IS NULL THEN 'no factuality rating' WHEN kind IN ('Satire', 'Pro-Science') THEN 'source type: ' || kind
  WHEN n_political < 20 THEN 'too few political articles (' || n_political || ')' WHEN share < 0.4 THEN 'political share too low' ELSE 'KEEP' END AS reason FROM r""")  # fmt: skip
def q05(spark, d):
    few, kind = F.concat(F.lit("too few political articles ("), F.col("n_political").cast("string"), F.lit(")")), F.concat(F.lit("source type: "), F.col("kind"))
    reason = F.when(F.col("bias").isNull(), "no bias rating").when(F.col("factuality").isNull(), "no factuality rating").when(F.col("kind").isin("Satire", "Pro-Science"), kind).when(F.col("n_political") < 20, few).when(F.col("share") < 0.4, "political share too low").otherwise("KEEP")
    return rated(spark, d).select("source", "n", "n_political", reason.alias("reason"))


_STEPS = ["TRUE", "bias IS NOT NULL", "factuality IS NOT NULL", "kind NOT IN ('Satire', 'Pro-Science')", "n_political >= 20", "share >= 0.4"]


@query("q05b_funnel", _RATED + " " + " UNION ALL ".join(f"SELECT {i} AS step, count(*) AS n FROM r WHERE {' AND '.join(_STEPS[: i + 1])}" for i in range(len(_STEPS))))
def q05b(spark, d):
    sums = [F.count_if(F.expr(" AND ".join(f"({s})" for s in _STEPS[: i + 1]))).alias(f"s{i}") for i in range(len(_STEPS))]
    return rated(spark, d).agg(*sums).select(F.expr(f"stack({len(sums)}, {', '.join(f'{i}, s{i}' for i in range(len(sums)))}) AS (step, n)"))


@query("q06_ordinal_codes", f"""WITH {BOTH}, o AS (SELECT source, CASE factuality WHEN 'very low' THEN 0 WHEN 'low' THEN 1 WHEN 'mixed' THEN 2 WHEN 'high' THEN 3 WHEN 'very high' THEN 4 END AS fact,
  CASE side WHEN 'left' THEN -1 WHEN 'centre' THEN 0 ELSE 1 END AS lean, CASE bias WHEN 'center' THEN 0 WHEN 'left-center' THEN 1 WHEN 'right-center' THEN 1 WHEN 'left' THEN 2 WHEN 'right' THEN 2 WHEN 'far left' THEN 3 WHEN 'far right' THEN 3 END AS extremity,
  CASE WHEN kind IN ('News') THEN 'news' ELSE 'other' END AS class FROM outlets) SELECT source, fact, lean, extremity, class, count(*) AS n, CAST(max(l.quality * fact) AS INTEGER) AS most FROM o JOIN documents USING (source) LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")  # fmt: skip
def q06(spark, d):
    code = lambda c, m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)]
    """Codes of the outlets' labels, on their documents: how many each has, and the highest code of a good one."""
    o = outlets(spark).select(
        "source", code("factuality", {"very low": 0, "low": 1, "mixed": 2, "high": 3, "very high": 4}).alias("fact"), code("side", {"left": -1, "centre": 0, "right": 1}).alias("lean"),
        code("bias", {"center": 0, "left-center": 1, "right-center": 1, "left": 2, "right": 2, "far left": 3, "far right": 3}).alias("extremity"), F.when(F.col("kind") == "News", "news").otherwise("other").alias("class"),
    )
    rows = table(spark, d, "documents").select("doc_id", "source").join(F.broadcast(o), "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source", "fact", "lean", "extremity", "class").agg(F.count("*").alias("n"), F.max(F.col("quality") * F.col("fact")).cast("int").alias("most"))


@query("q07_domain_checks", """SELECT count(*) AS n, count(*) - count(DISTINCT c_custkey) AS repeated, count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) AS outside,
  count(*) FILTER (WHERE c_name IS NULL) AS no_name, count(*) FILTER (WHERE try_cast(split_part(c_name, '#', 2) AS INTEGER) IS NULL) AS bad_number, count(*) FILTER (WHERE regexp_matches(c_name, '(?i)customer#0*7')) AS noted, count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM customer""")  # fmt: skip
def q07(spark, d):
    return table(spark, d, "customer").agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("c_custkey")).alias("repeated"), F.count_if(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).alias("outside"), F.count_if(F.col("c_name").isNull()).alias("no_name"),
        F.count_if(F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("int").isNull()).alias("bad_number"), F.count_if(F.col("c_name").rlike("(?i)customer#0*7")).alias("noted"), F.count_if(F.col("c_acctbal") < 0).alias("negative"),
    )


@query("q08_political_filter", f"WITH {ARTICLES} SELECT source, year, count(*) AS n, count(*) FILTER (WHERE {HIT}) AS political, CAST(sum(length({title_sql()})) AS BIGINT) AS chars FROM articles GROUP BY ALL")
def q08(spark, d):
    title = tx.repaired(F.col("title"))
    return articles(spark, d).groupBy("source", "year").agg(F.count("*").alias("n"), F.count_if(tx.about(F.col("title"), TERMS)).alias("political"), F.sum(F.length(title).cast("long")).alias("chars"))


@query("q08b_term_hits", f"WITH {ARTICLES} SELECT term, count(*) FILTER (WHERE regexp_matches({title_sql()}, pattern)) AS hits FROM articles, (VALUES " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', '{terms_sql([t])}')" for t in TERMS) + ") v(term, pattern) GROUP BY term")
def q08b(spark, d):
    sums = [F.count_if(tx.repaired(F.col("title")).rlike(tx.term_pattern([t]))).alias(f"t{i}") for i, t in enumerate(TERMS)]
    one = articles(spark, d).agg(*sums)  # one scan for all terms, no product of terms and titles
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("hits")) for i, t in enumerate(TERMS)])).alias("x")).select("x.*")


@query("q09_set_ops", f"""WITH {BOTH}, a AS (SELECT DISTINCT source FROM articles WHERE cluster = 'de' AND n_chars > 3000), b AS (SELECT source FROM outlets WHERE side <> 'left')
  SELECT 'only_a' AS part, source FROM (SELECT source FROM a EXCEPT SELECT source FROM b) UNION ALL SELECT 'only_b', source FROM (SELECT source FROM b EXCEPT SELECT source FROM a)
  UNION ALL SELECT 'both', source FROM (SELECT source FROM a INTERSECT SELECT source FROM b) UNION ALL SELECT 'any', source FROM (SELECT source FROM a UNION SELECT source FROM b) UNION ALL SELECT 'missing', source FROM outlets WHERE source NOT IN (SELECT source FROM a)""")  # fmt: skip
def q09(spark, d):
    a = articles(spark, d).where("cluster = 'de' AND n_chars > 3000").select("source").distinct()
    o = outlets(spark)
    b = o.where("side <> 'left'").select("source")
    tag = lambda n, x: x.select(F.lit(n).alias("part"), "source")
    return tag("only_a", a.subtract(b)).unionByName(tag("only_b", b.subtract(a))).unionByName(tag("both", a.intersect(b))).unionByName(tag("any", a.unionByName(b).distinct())).unionByName(tag("missing", o.join(a, "source", "left_anti").select("source")))


_LEFT = "SELECT ' ' || upper(source) || CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN '.' ELSE '' END AS name, CAST(least(4, floor(5 * avg(quality))) AS INTEGER) AS own, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source"


@query("q10_normalised_key_join", f"""WITH {OUTLETS}, l AS ({_LEFT}), r AS (SELECT source, factuality FROM outlets WHERE kind = 'News'),
  m AS (SELECT l.name, l.own, l.n, coalesce(x.factuality, y.factuality) AS factuality, CASE WHEN x.source IS NOT NULL THEN 'exact' WHEN y.source IS NOT NULL THEN 'letters' ELSE 'none' END AS how
        FROM l LEFT JOIN r x ON lower(trim(l.name)) = x.source LEFT JOIN r y ON x.source IS NULL AND regexp_replace(lower(l.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(y.source), '[^a-z0-9]', '', 'g')),
  s AS (SELECT name, how, n, CASE factuality WHEN 'very low' THEN 0 WHEN 'low' THEN 1 WHEN 'mixed' THEN 2 WHEN 'high' THEN 3 WHEN 'very high' THEN 4 END - own AS steps FROM m)
  SELECT name, how, n, steps, CASE WHEN steps IS NULL THEN 'unrated' WHEN steps = 0 THEN 'agree' WHEN abs(steps) = 1 THEN 'near' ELSE 'disagree' END AS verdict FROM s""")  # fmt: skip
def q10(spark, d):
    """Outlets as documents name them, with a rating from their labels, against the list of outlets: by the trimmed name in
    lower case, else by letters and digits alone; and how many steps apart the two ratings are."""
    known = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    rated = known.groupBy("source").agg(F.least(F.lit(4), F.floor(5 * F.avg("quality"))).cast("int").alias("own"), F.count("*").alias("n"))
    left = rated.select(F.concat(F.lit(" "), F.upper("source"), F.when(F.substring("source", 4, 2).cast("int") % 2 == 0, ".").otherwise("")).alias("name"), "own", "n")
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    right = outlets(spark).where("kind = 'News'")
    x, y = right.select(F.col("source").alias("xs"), F.col("factuality").alias("xf")), right.select(key(F.col("source")).alias("ys"), F.col("factuality").alias("yf"))
    m = left.join(F.broadcast(x), tx.normal_key(F.col("name")) == F.col("xs"), "left").join(F.broadcast(y), F.col("xs").isNull() & (key(F.col("name")) == F.col("ys")), "left")
    code = F.create_map(*[F.lit(v) for kv in {"very low": 0, "low": 1, "mixed": 2, "high": 3, "very high": 4}.items() for v in kv])
    steps = code[F.coalesce("xf", "yf")] - F.col("own")
    how = F.when(F.col("xs").isNotNull(), "exact").when(F.col("ys").isNotNull(), "letters").otherwise("none")
    return m.select("name", how.alias("how"), "n", steps.alias("steps"), F.when(steps.isNull(), "unrated").when(steps == 0, "agree").when(F.abs(steps) == 1, "near").otherwise("disagree").alias("verdict"))


@query("q11_domain_mode", """WITH c AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS domain, regexp_extract(url, '/(de|en|es|fr)/', 1) AS lang FROM pages), n AS (SELECT lang, domain, count(*) AS n FROM c GROUP BY ALL)
  SELECT lang, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, domain) AS k FROM n) WHERE k = 1""")  # fmt: skip
def q11(spark, d):
    c = table(spark, d, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("domain"), F.regexp_extract("url", "/(de|en|es|fr)/", 1).alias("lang"))
    n = c.groupBy("lang", "domain").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "domain"))).where("k = 1").select("lang", "domain", "n")


@query("q12_text_artifacts", f"""WITH {ARTICLES}, y AS (SELECT year, count(*) AS n, {', '.join(f"avg(CAST(regexp_matches(title, '{p}') AS INT)) AS {k}" for k, p in ARTEFACTS_SQL.items())}, max(length(title)) AS longest,
  1000.0 * sum(length(text) - length(replace(text, '.', ''))) / nullif(sum(length(text)), 0) AS dots, avg(CAST(contains(text, ',') AS INT)) AS commas FROM articles GROUP BY year)
  SELECT year, n, {', '.join(f'round({k}, 6) AS {k}' for k in ARTEFACTS_SQL)}, longest, round(dots, 6) AS dots, round(commas, 6) AS commas, round(sum(html_entity * n) OVER () / sum(n) OVER (), 6) AS overall FROM y""")  # fmt: skip
def q12(spark, d):
    a = articles(spark, d)
    share = lambda c: F.avg(c.cast("int"))
    text, dots = F.col("text"), F.length("text") - F.length(F.replace(F.col("text"), F.lit("."), F.lit("")))
    y = a.groupBy("year").agg(F.count("*").alias("n"), *[share(F.col("title").rlike(p)).alias(k) for k, p in tx.ARTEFACTS.items()], F.max(F.length("title")).cast("long").alias("longest"), F.try_divide(1000.0 * F.sum(dots), F.sum(F.length("text"))).alias("dots"), share(F.contains(text, F.lit(","))).alias("commas"))
    total = y.agg((F.sum(F.col("html_entity") * F.col("n")) / F.sum("n")).alias("overall"))
    return y.crossJoin(F.broadcast(total)).select("year", "n", *[r6(F.col(k)).alias(k) for k in tx.ARTEFACTS], "longest", r6(F.col("dots")).alias("dots"), r6(F.col("commas")).alias("commas"), r6(F.col("overall")).alias("overall"))


@query("q20_analysis_table", f"""WITH {BOTH}, t AS (SELECT a.doc_id, a.source, a.cluster, a.year, o.side, o.factuality, l.quality, 1.0 * count(*) OVER (PARTITION BY a.cluster) / count(*) OVER () AS share, count(*) OVER (PARTITION BY a.source) AS outlet_n
  FROM articles a JOIN labels l USING (doc_id) JOIN outlets o USING (source)) SELECT * EXCLUDE (share, outlet_n), CASE WHEN share < 0.15 THEN 'other' ELSE cluster END AS cluster_model, outlet_n >= 15 AS outlet_ok,
  CASE WHEN factuality IS NULL THEN 'unrated' WHEN quality = 0 THEN 'low' ELSE 'ok' END AS status FROM t""")  # fmt: skip
def q20(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    a = articles(spark, d).select("doc_id", "source", "cluster", "year").join(labels, "doc_id").join(F.broadcast(outlets(spark).select("source", "side", "factuality")), "source")
    # group sizes by small aggregates: a window over all rows would be one task
    clusters = a.groupBy("cluster").agg(F.count("*").alias("cn"))
    total = clusters.agg(F.sum("cn").alias("tn"))
    by_outlet = a.groupBy("source").agg(F.count("*").alias("outlet_n"))
    t = a.join(F.broadcast(clusters.crossJoin(total)), "cluster").join(F.broadcast(by_outlet), "source")
    return t.select("doc_id", "source", "cluster", "year", "side", "factuality", "quality", F.when(F.col("cn") / F.col("tn") < 0.15, "other").otherwise(F.col("cluster")).alias("cluster_model"), (F.col("outlet_n") >= 15).alias("outlet_ok"), F.when(F.col("factuality").isNull(), "unrated").when(F.col("quality") == 0, "low").otherwise("ok").alias("status"))


@query("q21_count_cube", f"""WITH {BOTH} SELECT a.source, coalesce(c.cluster, 'none') AS cluster, try_cast(left(CAST(a.year AS VARCHAR) || '-01', 4) AS INTEGER) AS year, count(*) AS n_all, count(*) FILTER (WHERE {HIT}) AS n_political
  FROM articles a JOIN outlets o USING (source) LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT DISTINCT cluster FROM articles WHERE cluster <> 'es') c ON a.cluster = c.cluster AND l.doc_id IS NOT NULL GROUP BY ALL""")  # fmt: skip
def q21(spark, d):
    a, labels = articles(spark, d), table(spark, d, "labels").select("doc_id", F.lit(True).alias("known"))
    c = a.where("cluster <> 'es'").select(F.col("cluster").alias("found")).distinct()
    rows = a.join(F.broadcast(outlets(spark).select("source")), "source").join(labels, "doc_id", "left").join(F.broadcast(c), (F.col("cluster") == F.col("found")) & F.col("known").isNotNull(), "left")
    year = F.left(F.concat(F.col("year").cast("string"), F.lit("-01")), F.lit(4)).try_cast("int")
    return rows.groupBy("source", F.coalesce("found", F.lit("none")).alias("cluster"), year.alias("year")).agg(F.count("*").alias("n_all"), F.count_if(tx.about(F.col("title"), TERMS)).alias("n_political"))


@query("q22_cluster_coverage", f"""WITH {ARTICLES}, t AS (SELECT a.cluster, count(*) AS articles, count(l.doc_id) AS matched FROM articles a LEFT JOIN labels l USING (doc_id) GROUP BY a.cluster)
  SELECT cluster, articles, matched, round(100.0 * matched / articles, 4) AS pct, round(100.0 * articles / sum(articles) OVER (), 4) AS share FROM t""")  # fmt: skip
def q22(spark, d):
    t = articles(spark, d).select("doc_id", "cluster").join(table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("k")), "doc_id", "left").groupBy("cluster").agg(F.count("*").alias("articles"), F.count("k").alias("matched"))
    return t.select("cluster", "articles", "matched", F.round(100.0 * F.col("matched") / F.col("articles"), 4).alias("pct"), F.round(100.0 * F.col("articles") / F.sum("articles").over(Window.partitionBy()), 4).alias("share"))


_OLD = "SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 3"
_NEW = "SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents WHERE doc_id % 10 <> 4"


@query("q23_version_diff", f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT count(*) AS kept, count(*) FILTER (WHERE n.doc_id IS NULL) AS missing, count(*) FILTER (WHERE o.n_chars <> n.n_chars) AS changed, CAST(max(abs(n.n_chars - o.n_chars)) AS BIGINT) AS most,
  (SELECT count(*) FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)) AS new_rows FROM o LEFT JOIN n USING (doc_id)""")  # fmt: skip
def q23(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    old, new = t.where("doc_id % 10 <> 3"), t.where("doc_id % 10 <> 4").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("n_chars"))
    both = old.join(new.select("doc_id", F.col("n_chars").alias("m")), "doc_id", "left")
    out = both.agg(F.count("*").alias("kept"), F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.expr("n_chars <> m")).alias("changed"), F.max(F.abs(F.col("m") - F.col("n_chars"))).alias("most"))
    return out.crossJoin(new.exceptAll(old).agg(F.count("*").alias("new_rows")))


@query("q24_checked_m2o_join", f"""WITH {BOTH}, m AS (SELECT a.doc_id, a.source, o.side FROM articles a LEFT JOIN outlets o ON a.source = o.source) SELECT side, count(*) AS n, count(DISTINCT source) AS outlets FROM m GROUP BY side""")
def q24(spark, d):
    from quillspark.operators.joins import many_to_one

    return many_to_one(articles(spark, d).select("doc_id", "source"), outlets(spark).select("source", "side"), "source").groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("source").alias("outlets"))


_TABLE = f"""WITH {BOTH}, t AS (SELECT side, cluster, count(*) AS o FROM articles JOIN outlets USING (source) GROUP BY ALL), m AS (SELECT s.side, c.cluster, coalesce(o, 0) AS o, rs, cs, (SELECT sum(o) FROM t) AS n
  FROM (SELECT side, sum(o) AS rs FROM t GROUP BY side) s CROSS JOIN (SELECT cluster, sum(o) AS cs FROM t GROUP BY cluster) c LEFT JOIN t ON t.side = s.side AND t.cluster = c.cluster)"""


@query("q25_crosstab", f"WITH {BOTH} SELECT side, {', '.join(f'count(*) FILTER (WHERE cluster = {chr(39)}{c}{chr(39)}) AS {c}' for c in ('de', 'en', 'es', 'fr'))} FROM articles JOIN outlets USING (source) GROUP BY side")
def q25(spark, d):
    rows = articles(spark, d).select("source", "cluster").join(F.broadcast(outlets(spark).select("source", "side")), "source")
    return rows.groupBy("side").pivot("cluster", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).fillna(0)


@query("q25b_cramers_ari", _TABLE + """ SELECT round(sqrt(sum((o - rs * cs / n) * (o - rs * cs / n) / (rs * cs / n)) / (max(n) * (least(count(DISTINCT side), count(DISTINCT cluster)) - 1))), 6) AS cramers_v,
  round((sum(o * (o - 1) / 2.0) - x) / ((max(p) + max(q)) / 2.0 - x), 6) AS ari FROM (SELECT *, p * q / (n * (n - 1) / 2.0) AS x FROM (SELECT m.*, (SELECT sum(rs * (rs - 1) / 2.0) FROM (SELECT DISTINCT side, rs FROM m)) AS p, (SELECT sum(cs * (cs - 1) / 2.0) FROM (SELECT DISTINCT cluster, cs FROM m)) AS q FROM m)) GROUP BY x""")  # fmt: skip
def q25b(spark, d):
    from quillspark.operators.agreement import association

    return association(articles(spark, d).select("source", "cluster").join(F.broadcast(outlets(spark).select("source", "side")), "source"), "side", "cluster")
