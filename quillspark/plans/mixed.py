"""Mixed models (Q48): random slopes, comparison, the ten robustness specifications, refits of draws and without each group."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import mixed as mx
from quillspark.operators import ordinal as od
from quillspark.sources.tables import table

from .base import articles, outlets, query
from .learned import CLASSES, FEATURES, rated

YEARS = {f"year {y}": f"CAST(year = {y} AS DOUBLE)" for y in range(2018, 2023)}
MAIN = {"quality": "quality - 0.5", "tens": "lines / 10 - 1"}
BOTH = MAIN | {"quality:tens": "(quality - 0.5) * (lines / 10 - 1)"}
SIDES = {"extremity": "extremity", "left": "CAST(side = 'left' AS DOUBLE)", "right": "CAST(side = 'right' AS DOUBLE)"}
GROUPS = ("source", "cluster")


def rows(spark, d):
    """One row a labelled article: response and covariates, with its outlet's side and how extreme its bias is."""
    far = F.when(F.col("bias").contains("far"), 3).when(F.col("bias").contains("center"), 1).when(F.col("bias").isNull(), None).otherwise(2)
    known = outlets(spark).select("source", "side", "kind", F.when(F.col("bias") == "center", 0).otherwise(far).cast("double").alias("extremity"))
    text = F.col("text")
    a = articles(spark, d).select("doc_id", "source", "cluster", "year", F.ln(F.length(text) + 1).alias("y"), (F.size(F.split(text, "\n", -1)).cast("double")).alias("lines"), F.ln(F.size(F.split(text, " ", -1)) + 1).alias("y_words"), F.size(F.split(text, " ", -1)).cast("double").alias("words"), F.try_divide(F.regexp_count(text, F.lit(",")), F.length(text)).alias("commas"))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return a.join(labels, "doc_id").join(F.broadcast(known), "source")


STEPS = {
    "M0 null": mx.Spec("y"),
    "M1 + year": mx.Spec("y", YEARS),
    "M2 + main effects": mx.Spec("y", YEARS | MAIN),
    "M3 + interaction": mx.Spec("y", YEARS | BOTH),
    "M4 + random slope": mx.Spec("y", YEARS | BOTH, slope="tens"),
    "M5 + controls": mx.Spec("y", YEARS | BOTH | SIDES, only="extremity IS NOT NULL", slope="tens"),
}
SUBSET = {"M6 common support": mx.Spec("y", YEARS | BOTH, only="extremity = 2")}


@query("q48_mixed_steps")
def q48(spark, d):
    """Null model, year, main effects, interaction, random slope by outlet, controls, and the common support."""
    return mx.models(rows(spark, d), STEPS | SUBSET, *GROUPS)


@query("q48b_model_comparison")
def q48b(spark, d):
    """The steps again by maximum likelihood over the same rows, each against the one before."""
    steps = {k: mx.Spec(s.y, s.terms, "extremity IS NOT NULL", s.weight, s.slope) for k, s in STEPS.items()}
    return mx.compared(rows(spark, d), steps, *GROUPS)


ROBUST = {
    "1 primary": mx.Spec("y", BOTH),
    "2 + extremity": mx.Spec("y", BOTH | {"extremity": "extremity"}),
    "3 common support": mx.Spec("y", BOTH, only="extremity = 2"),
    "4 weighted by words": mx.Spec("y", BOTH, weight="words"),
    "5 + commas": mx.Spec("y", BOTH | {"commas": "100 * commas"}),
    "6 without outliers": mx.Spec("y", BOTH, only="source NOT IN ('src1', 'src7')"),
    "7 one kind only": mx.Spec("y", BOTH, only="kind = 'News'"),
    "8 toxic left out": mx.Spec("y", BOTH, only="toxic = 0"),
    "9 + year": mx.Spec("y", BOTH | YEARS),
    "10 words as response": mx.Spec("y_words", BOTH),
}


@query("q48c_robustness_specs")
def q48c(spark, d):
    """Ten specifications in one pass over the rows: the effects with their errors and p-values."""
    return mx.models(rows(spark, d), ROBUST, *GROUPS).where(F.col("part").isin(*BOTH)).select("spec", "n", "groups_a", "groups_b", "part", "value", "se", "p", "converged")


@query("q48d_outlet_bootstrap")
def q48d(spark, d):
    """The primary model refitted on 500 draws of outlets."""
    return mx.bootstrap(rows(spark, d), ROBUST["1 primary"], *GROUPS)


@query("q48e_influence")
def q48e(spark, d):
    """The primary model without one outlet, then without one cluster, at a time."""
    return mx.influence(rows(spark, d), ROBUST["1 primary"], *GROUPS)


@query("q48f_ordinal_bootstrap")
def q48f(spark, d):
    """Odds ratios of a proportional-odds model of all rated articles, with intervals from 500 draws of outlets."""
    return od.bootstrap(rated(spark, d), "source", "rating", FEATURES, CLASSES)
