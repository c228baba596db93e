"""Article features, lexicon scores, vocabularies and samples (Q13 to Q19, Q39, Q43)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import sampling
from quillspark.sources.tables import sized, stored, table

from .base import ARTICLES, BOTH, articles, query

STOP = ["the", "and", "that", "les", "des", "que", "los", "las", "der", "die", "das", "with", "for"]
EXCLUDED = sorted({*tx.FUNCTION_WORDS, *tx.FEATURE_WORDS, *STOP})
_in = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
CLEAN = r"""clean AS (SELECT doc_id, source, cluster, coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(replace(replace(text, '’', ''''), '‘', ''''), '<copyright>|<twitter>|<url>|<?selfref>?', ' ', 'gi'), chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), lambda x: CASE WHEN contains('.!?:;,"'')]”', right(x, 1)) THEN x ELSE x || '.' END), ' '), '') AS t FROM articles)"""
_OPENED = tx.OPENED.replace("'", "''")
#: Words with their place in the sentence, then with the names of their text.
TOKENS = rf"""opened AS (SELECT doc_id, source, cluster, t, list_transform(regexp_extract_all(t, '{_OPENED}'), lambda x, i: {{'w': regexp_extract(x, '({tx.WORD.replace("'", "''")})$', 1),
    'initial': regexp_matches(x, '^[.!?:;]') OR (i = 1 AND regexp_matches(t, '{tx.STARTS.replace("'", "''")}'))}}) AS toks FROM clean),
  named AS (SELECT *, list_transform(list_filter(toks, lambda p: regexp_matches(p.w, '^[A-Z]') AND upper(p.w) <> p.w AND NOT p.initial), lambda p: lower(p.w)) AS names FROM opened),
  tokens AS (SELECT doc_id, source, cluster, p.w AS w, lower(p.w) AS low, ((regexp_matches(p.w, '^[A-Z]') AND upper(p.w) <> p.w) OR upper(p.w) = p.w) AND list_contains(names, lower(p.w)) AS proper FROM (SELECT doc_id, source, cluster, names, unnest(toks) AS p FROM named))"""  # fmt: skip
CODE = "CAST('0x' || substr(md5({w}), 1, 6) AS BIGINT)"
#: A made lexicon: a third of all words, scores in thousandths (so that sums are exact) from their md5.
LEXICON = f"lexicon AS (SELECT w AS term, ({CODE.format(w='w')} // 3) % 2001 - 1000 AS valence, ({CODE.format(w='w')} // 7) % 2001 - 1000 AS arousal, ({CODE.format(w='w')} // 11) % 2001 - 1000 AS dominance FROM (SELECT DISTINCT low AS w FROM tokens) WHERE {CODE.format(w='w')} % 3 = 0)"
#: Lexicon words of four letters and more that are mostly written in lower case: their capitals are emphasis.
SHOUT = f"""shout AS (SELECT low AS word FROM tokens JOIN lexicon ON low = term WHERE length(w) >= 4 AND low NOT IN {_in(sorted({*EXCLUDED, *tx.CAPS_BOILERPLATE}))} GROUP BY low HAVING 1.0 * count(*) FILTER (WHERE w = upper(w)) / count(*) < 0.5)"""
FEATURES = f"WITH {ARTICLES}, {CLEAN}, {TOKENS}, {LEXICON}, {SHOUT}"


def clean(spark, d) -> DataFrame:
    return articles(spark, d).select("doc_id", "source", "cluster", tx.cleaned(F.col("text"), tx.MASKS_PLAIN).alias("t"), tx.masked(F.col("text"), tx.MASKS_PLAIN).alias("n_masked"))


def tokens(spark, d) -> DataFrame:
    """(doc_id, w, initial): each word, and whether it opens a sentence."""
    t = F.col("t")
    rows = clean(spark, d).select("doc_id", t.rlike(tx.STARTS).alias("starts"), F.posexplode(F.regexp_extract_all(t, F.lit(tx.OPENED), F.lit(0))).alias("i", "x"))
    return rows.select("doc_id", F.ltrim("x", F.lit(" .!?:;\"'“([*")).alias("w"), (F.left("x", F.lit(1)).isin(*".!?:;") | ((F.col("i") == 0) & F.col("starts"))).alias("initial"))


def word_rows(spark, d) -> DataFrame:
    """(doc_id, low, n, caps, n_names): a document's words, counted before anything is sent: how often it has each, how
    often in capitals without being a name, and how often as a name.

    A name is a word that stands with a capital first letter inside a sentence somewhere in the document, where it's
    written so or in capitals. Rows come together by document, so the sums by document that follow need no other shuffle.
    """
    w = F.col("w")
    upper = w == F.upper(w)
    title = w.rlike("^[A-Z]") & ~upper
    forms = tokens(spark, d).select("doc_id", F.lower(w).alias("low"), (title & ~F.col("initial")).alias("named"), (title | upper).alias("formed"), (upper & (F.length(w) >= 4)).alias("shout"))
    by = forms.groupBy("doc_id", "low").agg(F.count("*").alias("n"), F.count_if("formed").alias("formed"), F.count_if("shout").alias("caps"), F.bool_or("named").alias("named"))
    unless = lambda c: F.when(F.col("named"), 0).otherwise(F.col(c)).cast("long")
    return by.select("doc_id", "low", "n", unless("caps").alias("caps"), F.col("caps").alias("all_caps"), F.when(F.col("named"), F.col("formed")).otherwise(0).cast("long").alias("n_names"))


def made_lexicon(words: DataFrame) -> DataFrame:
    """(term, valence, arousal, dominance) for a third of the words (low)."""
    code = F.conv(F.substring(F.md5("low"), 1, 6), 16, 10).cast("long")
    w = words.select("low").distinct().withColumn("code", code).where("code % 3 = 0")
    score = lambda by: F.floor(F.col("code") / by) % 2001 - 1000
    return w.select(F.col("low").alias("term"), score(3).alias("valence"), score(7).alias("arousal"), score(11).alias("dominance"))


def known(words: DataFrame, lexicon: DataFrame, how: str = "left") -> DataFrame:
    """Words (low) with their lexicon entry. A lexicon of a checked size is broadcast, so hot words stay where they are."""
    return words.join(sized(lexicon), F.col("low") == F.col("term"), how)


def shouted_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(term): lexicon words that are mostly written in lower case and belong to no site's furniture."""
    c = words.where(F.length("low") >= 4).groupBy("low").agg(F.sum("n").alias("n"), F.sum("all_caps").alias("caps"))
    c = c.where((F.col("caps") / F.col("n") < 0.5) & ~F.col("low").isin(*EXCLUDED, *tx.CAPS_BOILERPLATE))
    return known(c, lexicon, "inner").select(F.col("low").alias("shouted"))


_N = lambda words: f"len(regexp_extract_all(t, '(?i)\\b(?:{'|'.join(words)})\\b'))"
_CONTENT = f"NOT k.proper AND k.low NOT IN {_in(EXCLUDED)}"
_MEAN = lambda c: f"CAST(sum(l.{c}) FILTER (WHERE {_CONTENT}) AS BIGINT) / (1000.0::DOUBLE * nullif(count(l.term) FILTER (WHERE {_CONTENT}), 0)) AS {c}"
_SENTENCES = "greatest(1, len(regexp_extract_all(t, '[.!?]+(?:\\s|$|[\"'')\\]”])')))"


@query("q13_article_features", FEATURES + rf""", v AS (SELECT k.doc_id, count(*) AS n_tokens, count(l.term) FILTER (WHERE {_CONTENT}) AS n_matched, count(l.term) FILTER (WHERE k.proper) AS n_proper_skipped, {_MEAN('valence')}, {_MEAN('arousal')}, {_MEAN('dominance')},
    CAST(sum(l.arousal) FILTER (WHERE NOT k.proper) AS BIGINT) / (1000.0::DOUBLE * nullif(count(l.term) FILTER (WHERE NOT k.proper), 0)) AS arousal_all, count(*) FILTER (WHERE k.w = upper(k.w) AND length(k.w) >= 4 AND s.word IS NOT NULL AND NOT k.proper) AS shouted
    FROM tokens k LEFT JOIN lexicon l ON k.low = l.term LEFT JOIN shout s ON k.low = s.word GROUP BY k.doc_id)
  SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_matched, 0) AS n_matched, coalesce(n_proper_skipped, 0) AS n_proper_skipped, 0 AS n_masked, CASE WHEN n_tokens > 0 THEN {_SENTENCES} END AS n_sentences, valence, arousal, dominance, arousal_all, round({_N(tx.ATTRIBUTION)} / n_tokens, 6) AS attribution,
  round(({_N(tx.HEDGES)} + len(regexp_extract_all(t, '\bmay\b'))) / n_tokens, 6) AS hedging, round({_N(tx.CERTAINTY)} / n_tokens, 6) AS certainty, round(shouted / n_tokens, 6) AS caps_ratio, round((length(t) - length(replace(t, '!', ''))) / {_SENTENCES}, 6) * (n_tokens > 0)::INT AS exclamation_rate,
  CASE WHEN n_tokens > 0 THEN len(regexp_extract_all(t, '["“”]')) / 2.0 END AS quote_pairs, round(ln(n_tokens), 6) AS log_length, coalesce(n_matched, 0) >= 50 AS keep FROM clean LEFT JOIN v USING (doc_id)""")  # fmt: skip
def q13(spark, d):
    return article_features(clean(spark, d), stored(word_rows(spark, d), "word-rows"))


def article_features(texts: DataFrame, words: DataFrame) -> DataFrame:
    """All features of an article in one row. texts: doc_id, t, n_masked; words: as word_rows gives them.

    Names are left out of the lexicon means and of the capitals; grammar words and the words that define the other
    features are left out of the means. An article without words has null for all but its counts.
    """
    lex = stored(made_lexicon(words), "lexicon")
    shout = stored(shouted_words(words, lex), "shouted")
    rows = known(words, lex).join(sized(shout), F.col("low") == F.col("shouted"), "left")
    in_lexicon, k = F.col("term").isNotNull(), F.col("n") - F.col("n_names")
    content = ~F.col("low").isin(*EXCLUDED) & in_lexicon
    total = lambda ok: F.sum(F.when(ok, k).otherwise(0))
    mean = lambda c, ok: F.when(total(ok) > 0, F.sum(F.when(ok, F.col(c) * k))) / (1000.0 * total(ok))
    means = [mean(c, content).alias(c) for c in ("valence", "arousal", "dominance")]
    v = rows.groupBy("doc_id").agg(
        F.sum("n").alias("n_tokens"), total(content).alias("n_matched"), F.sum(F.when(in_lexicon, F.col("n_names")).otherwise(0)).alias("n_proper_skipped"), *means, mean("arousal", in_lexicon).alias("arousal_all"),
        F.sum(F.when(F.col("shouted").isNotNull(), F.col("caps")).otherwise(0)).alias("shouts"),
    )
    t, n = F.col("t"), F.col("n_tokens")
    some = lambda c: F.when(n > 0, c)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    exclamations = F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))
    return texts.join(v, "doc_id", "left").select(
        "doc_id", zero("n_tokens"), zero("n_matched"), zero("n_proper_skipped"), F.col("n_masked").cast("int").alias("n_masked"), some(tx.sentences(t)).cast("long").alias("n_sentences"), "valence", "arousal", "dominance", "arousal_all",
        F.round(tx.rate(t, tx.ATTRIBUTION, n), 6).alias("attribution"), F.round(tx.hedging(t, n), 6).alias("hedging"), F.round(tx.rate(t, tx.CERTAINTY, n), 6).alias("certainty"), F.round(F.col("shouts") / n, 6).alias("caps_ratio"),
        some(F.round(exclamations / tx.sentences(t), 6)).alias("exclamation_rate"), some(F.regexp_count(t, F.lit('["“”]')) / 2.0).alias("quote_pairs"), F.round(F.ln(n), 6).alias("log_length"), (F.coalesce("n_matched", F.lit(0)) >= 50).alias("keep"),
    )


@query("q13b_readability_diversity")
def q13b(spark, d):
    """Names, sentences, reading grade and lexical diversity: sequential definitions, held to unit cases."""
    x = clean(spark, d).select("doc_id", "t", tx.words(F.col("t")).alias("w"), tx.proper_flags(F.col("t")).alias("p"))
    n, s = F.size("w"), tx.sentences(F.col("t"))
    beats = F.aggregate("w", F.lit(0), lambda a, w: a + tx.syllables(w))
    return x.select("doc_id", n.alias("n_tokens"), s.cast("int").alias("n_sentences"), F.size(F.filter("p", lambda p: p["proper"])).alias("n_proper"), F.when(n > 0, F.round(0.39 * n / s + 11.8 * beats / n - 15.59, 6)).alias("grade"), F.round(tx.mtld(F.transform("w", lambda w: F.lower(w))), 6).alias("mtld"))


@query("q14_caps_shouting", FEATURES + """ SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE w = upper(w) AND length(w) >= 4 AND s.word IS NOT NULL AND NOT proper) AS shouted, round(1.0 * count(*) FILTER (WHERE w = upper(w) AND length(w) >= 4 AND s.word IS NOT NULL AND NOT proper) / count(*), 6) AS caps_ratio
  FROM tokens LEFT JOIN shout s ON low = s.word GROUP BY doc_id""")  # fmt: skip
def q14(spark, d):
    words = stored(word_rows(spark, d), "word-rows")
    shout = stored(shouted_words(words, stored(made_lexicon(words), "lexicon")), "shouted")
    rows = words.join(sized(shout), F.col("low") == F.col("shouted"), "left")
    out = rows.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("shouted").isNotNull(), F.col("caps")).otherwise(0)).alias("shouts"))
    return out.select("doc_id", "n_tokens", F.col("shouts").alias("shouted"), F.round(F.col("shouts") / F.col("n_tokens"), 6).alias("caps_ratio"))


@query("q15_driving_words", FEATURES + """, c AS (SELECT doc_id, term, count(*) AS n, max(arousal) AS arousal FROM tokens JOIN lexicon ON low = term WHERE NOT proper GROUP BY ALL)
  SELECT doc_id, rank, term, n, n * arousal AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n * arousal DESC, term) AS INTEGER) AS rank FROM c) WHERE rank <= 8""")  # fmt: skip
def q15(spark, d):
    words = stored(word_rows(spark, d), "word-rows")
    c = known(words.select("doc_id", "low", (F.col("n") - F.col("n_names")).alias("n")).where("n > 0"), stored(made_lexicon(words), "lexicon"), "inner")
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.col("n") * F.col("arousal")), "term")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("doc_id", "rank", "term", "n", (F.col("n") * F.col("arousal")).alias("score"))


VOCABULARY = f"""raw AS (SELECT source, cluster, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM articles), words AS (SELECT * FROM raw WHERE length(w) >= 3 AND w NOT IN {_in(STOP)}),
  vocabulary AS (SELECT w, CAST(sum(n) AS BIGINT) AS total, count(*) AS outlets FROM (SELECT w, source, count(*) AS n FROM words GROUP BY ALL) GROUP BY w HAVING outlets >= 5 ORDER BY total DESC, w LIMIT 10000)"""  # fmt: skip


def word_counts(spark, d) -> DataFrame:
    """(source, cluster, w, n): aggregated as the tokens stream, never kept."""
    w = articles(spark, d).select("source", "cluster", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    return w.where((F.length("w") >= 3) & ~F.col("w").isin(*STOP)).groupBy("source", "cluster", "w").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, least: int = 5, size: int = 10_000) -> DataFrame:
    return counts.groupBy("w", "source").agg(F.sum("n").alias("n")).groupBy("w").agg(F.sum("n").alias("total"), F.count("*").alias("outlets")).where(F.col("outlets") >= least).orderBy(F.desc("total"), "w").limit(size)


def cube(spark, d, size: int = 10_000) -> DataFrame:
    """(source, cluster, word, n), written once and read again, so that the texts are read once however often it's used."""
    counts = stored(word_counts(spark, d), "word-counts")
    # the vocabulary is a bounded number of words, so it's broadcast
    return counts.join(F.broadcast(vocabulary(counts, size=size).select("w")), "w").select("source", "cluster", F.col("w").alias("word"), "n")


CUBE = f"{VOCABULARY}, cube AS (SELECT source, cluster, w AS word, count(*) AS n FROM words JOIN vocabulary USING (w) GROUP BY ALL)"


@query("q16_vocabulary", f"WITH {ARTICLES}, {VOCABULARY} SELECT w, total, outlets FROM vocabulary")
def q16(spark, d):
    return vocabulary(word_counts(spark, d))


@query("q17_word_count_cube", f"WITH {ARTICLES}, {CUBE} SELECT * FROM cube ORDER BY ALL")
def q17(spark, d):
    return cube(spark, d)


@query("q18_capped_cell_sample", f"WITH {ARTICLES} SELECT doc_id, source, cluster, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY source, cluster ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS pick FROM articles) WHERE pick <= 5")
def q18(spark, d):
    return sampling.capped(articles(spark, d).select("doc_id", "source", "cluster"), ["source", "cluster"], "doc_id", 5)


_ALLOC = f"""WITH {ARTICLES}, c AS (SELECT source, year, count(*) AS n FROM articles GROUP BY ALL), e AS (SELECT *, n * least(sum(n) OVER w, 12) / sum(n) OVER w AS exact, least(sum(n) OVER w, 12) AS want FROM c WINDOW w AS (PARTITION BY source)),
  f AS (SELECT *, floor(exact) AS low, want - sum(floor(exact)) OVER (PARTITION BY source) AS rest, row_number() OVER (PARTITION BY source ORDER BY round(exact - floor(exact), 9) DESC, year) AS k FROM e),
  alloc AS (SELECT source, year, n, CAST(low + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM f)"""  # fmt: skip


@query("q19_stratified_draw", _ALLOC + " SELECT r.source, r.year, r.doc_id, a.alloc FROM (SELECT *, row_number() OVER (PARTITION BY source, year ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS pick FROM articles) r JOIN alloc a ON r.source = a.source AND r.year = a.year WHERE pick <= alloc")
def q19(spark, d):
    return sampling.stratified(articles(spark, d), "source", "year", "doc_id", 12).select("source", "year", "doc_id", "alloc")


@query("q19b_quantile_bins", "WITH e AS (SELECT quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8]) AS e FROM documents) SELECT CAST(1 + (n_chars > e[1])::INT + (n_chars > e[2])::INT + (n_chars > e[3])::INT + (n_chars > e[4])::INT AS INTEGER) AS bin, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents, e GROUP BY 1")
def q19b(spark, d):
    t = table(spark, d, "documents").select("n_chars")
    edges = t.agg(F.percentile("n_chars", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    bin_ = sum(((F.col("n_chars") > F.element_at("e", i)).cast("int") for i in range(1, 5)), F.lit(1))
    return t.crossJoin(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("q39_blinded_excerpt", f"""WITH {ARTICLES}, a AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS p FROM articles), h AS (SELECT doc_id, p, array_to_string(p[1:180], ' ') AS head FROM a),
  c AS (SELECT *, length(regexp_extract(head, '^(?s)(.*[.!?]) ', 1)) AS cut FROM h) SELECT doc_id, CASE WHEN len(p) <= 180 THEN array_to_string(p, ' ') ELSE CASE WHEN cut - 1 > length(head) * 0.6 THEN left(head, cut) ELSE head END || ' [...]' END AS excerpt FROM c""")  # fmt: skip
def q39(spark, d):
    return articles(spark, d).select("doc_id", tx.blinded(F.col("text"), F.col("source")).alias("excerpt"))


#: Put into texts for the next two queries: masks of either case, references by name and number, the outlet's own name.
_MASKED = " <URL> says <selfref> and Selfref, selfref> <Copyright>\n<twitter> &quot;caf&eacute;&quot; &#33; it&#x2019;s &amp;lt; here"
_DECODED = {"&quot;": '"', "&eacute;": "é", "&#33;": "!", "&#x2019;": "’", "&amp;lt;": "&lt;"}


def marked(spark, d) -> DataFrame:
    """Articles of which two thirds hold masks, references and addresses, and name their outlet in several spellings."""
    spelt = F.concat(F.lit(" As "), F.upper("source"), F.lit(", "), F.array_join(F.filter(F.split("source", ""), lambda c: c != ""), "-"), F.lit(" and "), F.initcap("source"), F.lit(" wrote at https://www."), F.col("source"), F.lit(".example/a?b and www.example.org: "))
    put = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(_MASKED))).when(F.col("doc_id") % 3 == 1, F.concat(spelt, F.lit(_MASKED), F.lit(" "), F.col("text")))
    return articles(spark, d).withColumn("text", F.coalesce(put, F.col("text")))


_SPELT = "' As ' || upper(source) || ', ' || array_to_string(string_split(source, ''), '-') || ' and ' || upper(source[1]) || source[2:] || ' wrote at https://www.' || source || '.example/a?b and www.example.org: '"
_M = "'" + _MASKED.replace("'", "''") + "'"
_PUT = f"coalesce(CASE doc_id % 3 WHEN 0 THEN text || {_M} WHEN 1 THEN {_SPELT} || {_M} || ' ' || text END, text)"
_PLAIN = "put"
for _found, _is in _DECODED.items():
    _PLAIN = f"replace({_PLAIN}, '{_found}', '{_is}')"
_MARKED = f"{ARTICLES.replace('articles AS', 'given AS', 1)}, articles AS (SELECT * EXCLUDE (text, put), {_PLAIN} AS text FROM (SELECT *, {_PUT} AS put FROM given))"
_MASK_SQL = "(?i)<copyright>|<twitter>|<url>|<?selfref>?"


@query("q13d_masks_and_references", f"""WITH {_MARKED}, {CLEAN} SELECT doc_id, CAST(len(regexp_extract_all(text, '{_MASK_SQL}')) AS INTEGER) AS n_masked, length(t) AS n_clean, md5(t) AS clean_md5, len(string_split(t, ' ')) AS n_parts FROM clean JOIN articles USING (doc_id)""")
def q13d(spark, d):
    """Cleaning of texts that hold masks and references: how many masks went, and the text that is left."""
    t = marked(spark, d).select("doc_id", tx.masked(F.col("text"), tx.MASKS_PLAIN).cast("int").alias("n_masked"), tx.cleaned(F.col("text"), tx.MASKS_PLAIN).alias("t"))
    return t.select("doc_id", "n_masked", F.length("t").cast("long").alias("n_clean"), F.md5("t").alias("clean_md5"), F.size(F.split("t", " ")).cast("long").alias("n_parts"))


_NAME = "'(?i)\\b' || array_to_string(string_split(source, ''), '[\\s\\-.]?') || '\\b'"


@query("q39b_outlet_names", f"""WITH {_MARKED}, m AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '(?i)<copyright>|<twitter>|<url>|\\b<?selfref\\b>?|<selfref\\b>?', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'g') AS t FROM articles),
  n AS (SELECT doc_id, CASE WHEN length(source) >= 5 THEN regexp_replace(t, {_NAME}, '[outlet]', 'g') ELSE t END AS t FROM m), a AS (SELECT doc_id, string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ') AS p FROM n), h AS (SELECT doc_id, p, array_to_string(p[1:180], ' ') AS head FROM a),
  c AS (SELECT *, length(regexp_extract(head, '^(?s)(.*[.!?]) ', 1)) AS cut FROM h), e AS (SELECT doc_id, CASE WHEN len(p) <= 180 THEN array_to_string(p, ' ') ELSE CASE WHEN cut - 1 > length(head) * 0.6 THEN left(head, cut) ELSE head END || ' [...]' END AS excerpt FROM c)
  SELECT doc_id, excerpt, len(string_split(excerpt, '[outlet]')) - 1 AS n_named FROM e""")  # fmt: skip
def q39b(spark, d):
    """Excerpts of texts that name their outlet; names of four characters and fewer stay, as they are common words."""
    e = marked(spark, d).select("doc_id", tx.blinded(F.col("text"), F.col("source")).alias("excerpt"))
    return e.select("doc_id", "excerpt", (F.size(F.split("excerpt", r"\[outlet\]", -1)) - 1).cast("long").alias("n_named"))


@query("q43_folds", "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def q43(spark, d):
    from quillspark.functions.stats import pick_key

    k = F.row_number().over(Window.partitionBy("quality").orderBy(pick_key("doc_id"), "doc_id"))
    return table(spark, d, "labels").select("doc_id", "quality", ((k - 1) % 5).cast("int").alias("fold"))


@query("q43b_grouped_folds")
def q43b(spark, d):
    """Outlets are few by nature, so their class counts go to the driver, which assigns whole outlets to folds."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    counts = [(r.source, r.quality, r.n) for r in rows.groupBy("source", "quality").agg(F.count("*").alias("n")).collect()]
    fold = spark.createDataFrame(sorted(sampling.grouped_folds(counts, 5).items()), "source string, fold int")
    return rows.join(F.broadcast(fold), "source").select("doc_id", "source", "quality", "fold")
