"""Models (Q45, Q46): clustering, forests, text classification, fixed effects, ordinal logit, mixed model."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import models as md
from quillspark.sources.tables import table

from .base import outlets, query
from .statistics import frame


@query("q45_kmeans")
def q45(spark, d):
    return md.best_kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 10, seeds=(1, 2, 3))


@query("q45b_forest_cv")
def q45b(spark, d):
    return md.forest_by_group(frame(spark, d), ["n_chars", "lines", "shouts"], "quality", "source", folds=3)


@query("q45c_tfidf_one_vs_rest")
def q45c(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return md.tfidf_one_vs_rest(docs, "text", "lang")


@query("q46_fixed_effects")
def q46(spark, d):
    """Outlet means once the effects of cluster and year are out."""
    x = frame(spark, d).select("source", "cluster", (2017 + F.col("doc_id") % 6).alias("year"), F.ln(F.col("n_chars") + 1).alias("y"))
    return md.two_way_effects(x, "y", "source", "cluster", "year")


@query("q46b_ordinal_logit")
def q46b(spark, d):
    x = frame(spark, d).groupBy("source").agg(F.avg("quality").alias("quality"), F.avg(F.ln("n_chars")).alias("size")).join(outlets(spark), "source").where("factuality IS NOT NULL")
    code = F.create_map(*[F.lit(v) for kv in {"very low": 0, "low": 1, "mixed": 2, "high": 3, "very high": 4}.items() for v in kv])
    return md.ordinal_logit(x.select(code[F.col("factuality")].alias("y"), "quality", "size"), "y", ["quality", "size"])


@query("q46c_mixed_model")
def q46c(spark, d):
    x = frame(spark, d).select("source", "cluster", F.ln("n_chars").alias("y"))
    return md.variance_shares(x, "y", "source", "cluster")


@query("q46d_proportional_odds")
def q46d(spark, d):
    """One logistic model for each cut of factuality, against the slope of the ordinal one."""
    x = frame(spark, d).groupBy("source").agg(F.avg(F.ln("n_chars")).alias("size")).join(outlets(spark), "source").where("factuality IS NOT NULL")
    code = F.create_map(*[F.lit(v) for kv in {"very low": 0, "low": 1, "mixed": 2, "high": 3, "very high": 4}.items() for v in kv])
    return md.proportional_odds(x.select(code[F.col("factuality")].alias("y"), "size"), "y", "size")


@query("q46e_mixed_specs")
def q46e(spark, d):
    """The mixed model with covariates, and again with fewer of them, without an outlet, and without a year."""
    x = frame(spark, d).select("source", "cluster", (2017 + F.col("doc_id") % 6).alias("year"), "quality", (F.col("lines") / 10).alias("tens"), F.ln(F.col("n_chars") + 1).alias("y"))
    both = ["quality", "tens"]
    specs = {"all": (both, None), "quality only": (["quality"], None), "no src1": (both, "source <> 'src1'"), "no 2018": (both, "year <> 2018"), "short": (both, "tens < 2")}
    return md.mixed_model(x, "y", both, "source", "cluster", specs)
