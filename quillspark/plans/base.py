"""The tables that the queries work on: articles and rated outlets, from the driver's tables; the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


TERMS = ["from", "sur", "por", "mit", "not", "pas", "that", "los", "das", "i'm", "with &"]
DAMAGE = " aposThis &amp; quotThat&#8217;s Iaposm Ouraposs endquot with &amp;amp;"
CLUSTERS = ["de", "en", "es", "fr"]


def articles(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, cluster, year, title (some with damage put in), text, n_chars."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, d, "documents").select(
        "doc_id", "source", F.col("lang").alias("cluster"), (2017 + F.col("doc_id") % 6).cast("int").alias("year"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(title, F.lit(DAMAGE))).otherwise(title).alias("title"), "text", "n_chars",
    )


ARTICLES = f"""articles AS (SELECT doc_id, source, lang AS cluster, CAST(2017 + doc_id % 6 AS INTEGER) AS year,
  split_part(text, chr(10), 1) || CASE WHEN doc_id % 5 = 0 THEN '{DAMAGE}' ELSE '' END AS title, text, n_chars FROM documents)"""


def outlets(spark: SparkSession) -> DataFrame:
    """source, side, bias (null for some), factuality, kind: 20 rows, so always small enough to broadcast."""
    i = F.col("id")
    pick = lambda by, names: F.element_at(F.array(*[F.lit(n) for n in names]), (i % by + 1).cast("int"))
    return spark.range(20).select(
        F.concat(F.lit("src"), i.cast("string")).alias("source"), F.when(i < 8, "left").when(i < 17, "right").otherwise("centre").alias("side"),
        F.when(i == 19, None).otherwise(pick(7, ["far left", "left", "left-center", "center", "right-center", "right", "far right"])).alias("bias"),
        F.when(i == 18, None).otherwise(pick(5, ["very low", "low", "mixed", "high", "very high"])).alias("factuality"), pick(6, ["News", "News", "Satire", "News", "Pro-Science", "News"]).alias("kind"),
    )


OUTLETS = """outlets AS (SELECT 'src' || i AS source, CASE WHEN i < 8 THEN 'left' WHEN i < 17 THEN 'right' ELSE 'centre' END AS side,
  CASE WHEN i <> 19 THEN ['far left','left','left-center','center','right-center','right','far right'][CAST(i % 7 + 1 AS INT)] END AS bias,
  CASE WHEN i <> 18 THEN ['very low','low','mixed','high','very high'][CAST(i % 5 + 1 AS INT)] END AS factuality,
  ['News','News','Satire','News','Pro-Science','News'][CAST(i % 6 + 1 AS INT)] AS kind FROM range(20) t(i))"""
BOTH = f"{ARTICLES}, {OUTLETS}"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _repairs() -> list[tuple[str, tuple[str, ...]]]:
    """Each step of the headline repair as a DuckDB function and what follows its first argument."""
    steps: list[tuple[str, tuple[str, ...]]] = [("replace", pair) for pair in tx.ENTITIES]
    for found, put in tx.GLUED:
        steps.append(("regexp_replace", (found.replace(tx.NO_WORD_AFTER, r"\b"), put.replace("$", "\\"), "g")))
    return steps


def title_sql(col: str = "title") -> str:
    steps = _repairs()
    opened = "".join(f"{name}(" for name, _ in reversed(steps))
    closed = "".join("".join(f", {_quoted(x)}" for x in rest) + ")" for _, rest in steps)
    return f"lower({opened}ifnull({col}, ''){closed})"


def terms_sql(terms: list[str]) -> str:
    return tx.term_pattern(terms).replace("(?<![0-9A-Za-z_])", "\\b").replace("(?![0-9A-Za-z_])", "\\b").replace("\\ ", " ").replace("\\&", "&").replace("'", "''")


def _artefacts() -> dict[str, str]:
    return {k: p.replace(tx.NO_WORD_AFTER, "\\b").replace("'", "''") for k, p in tx.ARTEFACTS.items()}


ARTEFACTS_SQL = _artefacts()
