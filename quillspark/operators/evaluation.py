"""Evaluation of classifiers on groups that they have not seen: nested search, out-of-bag votes, intervals, importance.

What comes to the driver are confusion counts and groups' class counts; rows stay where they are.
"""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import pick_key
from quillspark.sources.tables import removed, sized, stored

from . import boosting as bo
from . import logistic as lg
from .sampling import grouped_folds


def metrics(c: np.ndarray) -> dict[str, np.ndarray]:
    """qwk, accuracy and macro_f1 (over the classes that occur) of confusion counts (..., true class, predicted class).

    Without any spread in both margins the kappa is not defined, and nan.
    """
    c = np.asarray(c, float)
    k = c.shape[-1]
    w = (np.arange(k)[:, None] - np.arange(k)) ** 2 / max(1, k - 1) ** 2
    rows, cols, n, hit = c.sum(-1), c.sum(-2), c.sum((-1, -2)), np.diagonal(c, axis1=-2, axis2=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        chance = (w * rows[..., :, None] * cols[..., None, :]).sum((-1, -2)) / n
        f1 = np.where(rows + cols > 0, 2 * hit / (rows + cols), 0.0)
        return {"qwk": 1 - (w * c).sum((-1, -2)) / chance, "accuracy": hit.sum(-1) / n, "macro_f1": f1.sum(-1) / (rows + cols > 0).sum(-1)}


def argmax(p="p"):
    """The first class with the highest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def counts_of(predictions: DataFrame, key: str, classes: int) -> dict:
    """Confusion counts of predictions (key, y, p) by key."""
    out: dict = {}
    for r in predictions.groupBy(key, "y", argmax().alias("c")).agg(F.count("*").alias("n")).collect():  # keys times classes squared
        out.setdefault(r[0], np.zeros((classes, classes)))[r.y, r.c] += r.n
    return out


class Rows:
    """Binned rows, written once, and the class counts of their groups."""

    def __init__(self, df: DataFrame, id_col: str, group: str, label: str, features: list[str], classes: int) -> None:
        self.edges, self.classes = bo.edges_of(df, features), classes
        self.features, self.width = len(features), max((len(e) for e in self.edges), default=0) + 2
        self.table = stored(bo.binned(df, id_col, group, label, features, self.edges), "binned")
        self.counts = [(r.g, r.y, r.n) for r in self.table.groupBy("g", "y").agg(F.count("*").alias("n")).orderBy("g", "y").collect()]

    def of(self, groups) -> list[tuple]:
        return [c for c in self.counts if c[0] in groups]

    def fit(self, roles: dict, settings: list[bo.Setting]) -> list[bo.Model]:
        return bo.fitted(self.table, roles, self.classes, settings, self.features, self.width)

    def split(self, groups: set, folds: int = 5) -> set:
        """The groups of `groups` that validate: one fold of them."""
        return {g for g, f in grouped_folds(self.of(groups), folds).items() if f == 0}


def _roles(parts: list[tuple[set, set, set]]) -> dict:
    """group -> its part in each model, from (training, validation, held-out) groups of each model."""
    names = set().union(*(s for p in parts for s in p)) if parts else set()
    return {g: [bo.TRAIN if g in a else bo.VALIDATE if g in b else bo.HELD if g in c else 0 for a, b, c in parts] for g in names}


def nested_search(rows: Rows, grid: list[bo.Setting], outer: int = 5, inner: int = 4, together: int = 64) -> tuple[list[dict], DataFrame]:
    """(the choice of each outer fold, predictions (fold, id, g, y, p) of all rows by the model that has not seen them).

    In every outer training set, inner folds choose the setting with the best mean kappa (of equal ones the first in the
    grid); the rounds come from early stopping on groups of the training set, and the model is fitted again on all of it
    with as many rounds. Groups are never cut, at either level. All models of a level grow together, `together` at a time.
    """
    folds = grouped_folds(rows.counts, outer)
    groups = {o: {g for g, f in folds.items() if f == o} for o in range(outer)}
    plan = []
    for o in range(outer):
        left = set(folds) - groups[o]
        for i, name in product(range(inner), [grouped_folds(rows.of(left), inner)]):
            held = {g for g, f in name.items() if f == i}
            valid = rows.split(left - held)
            plan += [(o, i, s, (left - held - valid, valid, held)) for s in range(len(grid))]
    scores: dict = {}
    for start in range(0, len(plan), together):
        part = plan[start : start + together]
        roles = _roles([p[3] for p in part])
        fits = rows.fit(roles, [grid[s] for _, _, s, _ in part])
        found = counts_of(bo.predicted(rows.table, fits, roles), "model", rows.classes)
        for j, (o, _, s, _) in enumerate(part):
            score = float(metrics(found[j])["qwk"]) if j in found else np.nan
            scores.setdefault((o, s), []).append(0.0 if np.isnan(score) else score)
    best = {o: max(range(len(grid)), key=lambda s: (np.mean(scores[o, s]), -s)) for o in range(outer)}
    parts = [(set(folds) - groups[o] - rows.split(set(folds) - groups[o]), rows.split(set(folds) - groups[o]), set()) for o in range(outer)]
    stopped = rows.fit(_roles(parts), [grid[best[o]] for o in range(outer)])
    rounds = [len(m.rounds) for m in stopped]
    roles = _roles([(set(folds) - groups[o], set(), groups[o]) for o in range(outer)])
    again = [bo.Setting(grid[best[o]].rate, grid[best[o]].leaves, rounds[o], None, grid[best[o]].least, grid[best[o]].penalty) for o in range(outer)]
    predictions = stored(bo.predicted(rows.table, rows.fit(roles, again), roles).withColumnRenamed("model", "fold"), "predictions")
    return [{"fold": o, "setting": grid[best[o]], "rounds": rounds[o], "inner_qwk": float(np.mean(scores[o, best[o]])), "capped": rounds[o] >= grid[best[o]].rounds} for o in range(outer)], predictions


def tally(choices: list[dict], grid: list[bo.Setting], names: tuple[str, ...] = ("rate", "leaves")) -> list[tuple[str, float, int, bool]]:
    """(parameter, value, outer folds that chose it, whether the most frequent value of the parameter lies on the grid's edge)."""
    out = []
    for name in names:
        times = Counter(getattr(c["setting"], name) for c in choices)
        values = sorted({getattr(s, name) for s in grid})
        most = max(values, key=lambda v: (times[v], -values.index(v)))
        out += [(name, float(v), times[v], most in (values[0], values[-1])) for v in values]
    return out


def placed(p, classes: list[int], k: int):
    """Probabilities of k classes from those of the classes that a model knows; the others get 0."""
    return F.array(*[F.element_at(p, classes.index(c) + 1) if c in classes else F.lit(0.0) for c in range(k)])


def out_of_bag(df: DataFrame, id_col: str, label: str, features: list[str], classes: int, trees: int = 20, least: int = 5) -> DataFrame:
    """(id, y, votes, p): a forest whose every tree votes only on rows that its bag left out; p is null where no tree may vote.

    How often a row is in a tree's bag is a Poisson number from a hash of the row's id and the tree, so a bag is a column,
    the same on every run. Classes are balanced by weight; a tree sees the square root of the features at a node.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    size = {r.y: r.n for r in df.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect() if r.y is not None}
    total = sum(size.values())
    weight = F.create_map(*[F.lit(x) for y in sorted(size) for x in (y, total / (len(size) * size[y]))])
    names = [f"x{i}" for i in range(len(features))]
    kept = df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("y"), weight[F.col(label)].alias("w"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    rows = VectorAssembler(inputCols=names, outputCol="x", handleInvalid="skip").transform(kept).select("id", F.col("y").cast("double").alias("y"), "x", "w")
    rows = stored(rows, "bags")
    out = rows.select("id", "y", "x", F.array(*[F.lit(0.0)] * classes).alias("p"), F.lit(0).alias("votes"))
    for t in range(trees):
        times = bag(F.col("id"), t)
        fit = RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="wt", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", minInstancesPerNode=least, maxDepth=10, seed=42 + t)
        model = fit.fit(rows.where(times > 0).withColumn("wt", F.col("w") * times))
        voted = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("v").transform(out)
        left = times == 0
        known = F.transform(vector_to_array("v"), lambda x: F.when(left, x).otherwise(0.0))
        known = F.concat(known, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(classes) - F.size(known))))
        out = voted.select("id", "y", "x", F.zip_with("p", known, lambda a, b: a + b).alias("p"), (F.col("votes") + left.cast("int")).alias("votes"))
    mean = F.when(F.col("votes") > 0, F.transform("p", lambda x: x / F.col("votes")))
    return out.select("id", F.col("y").cast("int").alias("y"), "votes", mean.alias("p"))


def bag(id_, tree: int):
    """How often a row is in a tree's bag: Poisson with mean 1, by a hash."""
    u = F.pmod(F.xxhash64(id_.cast("string"), F.lit(f"bag-{tree}")), F.lit(1 << 40)) / float(1 << 40)
    ends, p, seen = [], 1.0, 0.0
    for k in range(9):
        p = np.exp(-1.0) if k == 0 else p / k
        seen += p
        ends.append(float(seen))
    return sum(((u >= e).cast("int") for e in ends), F.lit(0))


def resampled(predictions: DataFrame, draws: DataFrame, classes: int) -> DataFrame:
    """(rep, n, qwk, accuracy, macro_f1) of each draw of groups, from each group's confusion counts.

    predictions: (g, y, c); draws: (rep, g, m), m times a group is drawn. A group is drawn with all of its rows.
    """
    cells = predictions.groupBy("g", "y", "c").agg(F.count("*").alias("n"))
    return scored(cells.join(draws, "g").groupBy("rep", "y", "c").agg(F.sum(F.col("n") * F.col("m")).alias("n")), classes, "rep")


def scored(counts: DataFrame, classes: int, by: str) -> DataFrame:
    """(by, n, qwk, accuracy, macro_f1) from counts (by, y, c, n), all in grouped sums: nothing is paired but margins."""
    w = (F.col("y") - F.col("c")) * (F.col("y") - F.col("c")) / float((classes - 1) ** 2)
    whole = counts.groupBy(by).agg(F.sum("n").alias("n"), F.sum(w * F.col("n")).alias("seen"), F.sum(F.when(F.col("y") == F.col("c"), F.col("n")).otherwise(0)).alias("hit"))
    sides = counts.select(by, F.explode(F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("r"), F.lit(0).cast("long").alias("s")), F.struct(F.col("c").alias("k"), F.lit(0).cast("long").alias("r"), F.col("n").alias("s")))).alias("x"), F.when(F.col("y") == F.col("c"), F.col("n")).otherwise(0).alias("t"))
    # a hit is seen from both sides
    each = sides.groupBy(by, "x.k").agg(F.sum("x.r").alias("r"), F.sum("x.s").alias("s"), (F.sum("t") / 2).alias("t"))
    grid = F.collect_list(F.struct("k", "r", "s"))
    margins = each.groupBy(by).agg(F.avg(2 * F.col("t") / (F.col("r") + F.col("s"))).alias("f1"), grid.alias("m"))  # as many as classes
    chance = F.aggregate("m", F.lit(0.0), lambda a, x: a + F.aggregate("m", F.lit(0.0), lambda b, z: b + (x["k"] - z["k"]) * (x["k"] - z["k"]) / float((classes - 1) ** 2) * x["r"] * z["s"]))
    return whole.join(margins.select(by, "f1", chance.alias("chance")), by).select(by, "n", (1 - F.try_divide(F.col("seen") * F.col("n"), F.col("chance"))).alias("qwk"), (F.col("hit") / F.col("n")).alias("accuracy"), F.col("f1").alias("macro_f1"))


def importance(rows: Rows, models: list[bo.Model], roles: dict, targets: dict[str, list[int]], repeats: int = 3) -> DataFrame:
    """(feature, drop, lo, hi): how much the kappa on held-out rows falls when the features of a target are shuffled together.

    models: one a fold; each scores the rows that it holds out. Within a fold a row takes the target's bins of the row at
    its rank in another order, by a join of ranks; ranks come from ranges and offsets, not from one sorted task.
    """
    rows_ = rows.table.select("id", "g", "y", "bins", F.xxhash64(F.col("id").cast("string")).alias("h"))
    folds = rows.table.sparkSession.createDataFrame([(g, next((j for j, r in enumerate(rs) if r == bo.HELD), -1)) for g, rs in sorted(roles.items())], f"g {dict(rows.table.dtypes)['g']}, fold int")
    held = stored(rows_.join(sized(folds.where("fold >= 0")), "g"), "held")
    base = metrics(sum(counts_of(_again(held, models), "fold", rows.classes).values()))["qwk"]
    mine, drops = stored(ranked_in(held, "fold", ["h", "id"], "k"), "ranks"), {t: [] for t in targets}
    for r in range(repeats):
        order = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-perm-{r}")))
        other = ranked_in(held.withColumn("o", order), "fold", ["o", "id"], "k").select("fold", "k", F.col("bins").alias("from"))
        pairs = stored(mine.join(other, ["fold", "k"]), "shuffled")
        for name, columns in targets.items():
            width = rows.features
            mixed = F.concat(*[F.substring(F.col("from") if f in columns else F.col("bins"), f + 1, 1) for f in range(width)])
            score = metrics(sum(counts_of(_again(pairs.withColumn("bins", mixed), models), "fold", rows.classes).values()))["qwk"]
            drops[name].append(float(base - score))
        removed(pairs)
    removed(held, mine)
    out = [(t, round(float(np.mean(d)), 6), round(float(np.percentile(d, 2.5)), 6), round(float(np.percentile(d, 97.5)), 6)) for t, d in drops.items()]
    return rows.table.sparkSession.createDataFrame(out, "feature string, drop double, lo double, hi double")


def _again(rows: DataFrame, models: list[bo.Model]) -> DataFrame:
    """(fold, y, p): each row scored by its fold's model."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fold = b.column(0).to_numpy()
            bins = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for j in np.unique(fold):
                on = np.flatnonzero(fold == j)
                p = shared.value[j].probabilities(bins[on])
                yield pa.RecordBatch.from_arrays([pa.array(fold[on]), b.column(1).take(pa.array(on)), pa.array(p.tolist(), pa.list_(pa.float64()))], ["fold", "y", "p"])

    return rows.select("fold", "y", "bins").mapInArrow(run, "fold int, y int, p array<double>")


def ranked_in(df: DataFrame, by: str, order: list[str], name: str, amount: str | None = None) -> DataFrame:
    """Row numbers from 1 within few large groups: rows are ordered by ranges, each range numbers its own, and the counts of
    the ranges before are added. No group is sorted in one task. amount: if given, running sums of it, not of rows."""
    parts = df.repartitionByRange(by, *order).withColumn("part", F.spark_partition_id())
    parts = stored(parts, "ranges")
    one = F.lit(1) if amount is None else F.col(amount)
    own = F.sum(one).over(Window.partitionBy("part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = parts.groupBy(by, "part").agg(F.sum(one).alias("s"))
    before = sizes.select(by, "part", (F.sum("s").over(Window.partitionBy(by).orderBy("part")) - F.col("s")).alias("before"))
    return parts.withColumn("own", own).join(sized(before), [by, "part"]).withColumn(name, F.col("own") + F.col("before")).drop("own", "before", "part")


#: Latin letters with marks, by the letter that stands for them without.
_MARKED = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}


def unaccented(text):
    return F.translate(text, "".join(_MARKED.values()), "".join(k * len(v) for k, v in _MARKED.items()))


def scaled(train: DataFrame, columns: list[str]):
    """Columns as z-scores by the means and deviations (over n) of the training rows alone; nulls are at the mean."""
    got = train.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [F.coalesce((F.col(c) - F.lit(got[f"m{i}"])) / F.lit(got[f"s{i}"] or 1.0), F.lit(0.0)).alias(c) for i, c in enumerate(columns)]


def word_weights(train: DataFrame, size: int, least: int):
    """A function that adds sublinear TF-IDF of column t as `words`: a count goes in as 1 + ln(count); vocabulary and document
    counts are the training rows' alone."""
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, Tokenizer
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def dampened(v):
        return SparseVector(v.size, v.indices, 1 + np.log(v.values))

    split = Tokenizer(inputCol="t", outputCol="w")
    count = CountVectorizer(inputCol="w", outputCol="c", minDF=least, vocabSize=size).fit(split.transform(train))
    damped = lambda df: count.transform(split.transform(df)).withColumn("d", dampened("c"))
    idf = IDF(inputCol="d", outputCol="i").fit(damped(train))
    return lambda df: Normalizer(inputCol="i", outputCol="words").transform(idf.transform(damped(df))).drop("w", "c", "d", "i")


def text_in_folds(df: DataFrame, text: str, label: str, group: str, dense: list[str], classes: int, folds: int = 3, size: int = 50_000, least: int = 5) -> DataFrame:
    """(features, g, y, c, n) of rows held out by group: logistic models on words, on dense features, and on both in one vector.

    Whatever is learned from data is learned once a fold, from its training groups: words and their document counts, means
    and deviations, class weights and models. label: a class from 0.
    """
    df = df.where(F.col(label).isNotNull() & F.col(group).isNotNull())
    counts = [tuple(r) for r in df.groupBy(group, label).agg(F.count("*").alias("n")).orderBy(group, label).collect()]  # groups times classes
    of = grouped_folds(counts, folds)
    fold = df.sparkSession.createDataFrame(sorted(of.items()), f"{group} {dict(df.dtypes)[group]}, fold int")
    plain = F.regexp_replace(unaccented(F.lower(text)), r"[^\p{L}]+", " ")
    rows = stored(df.join(sized(fold), group).select("fold", F.col(group).alias("g"), F.col(label).cast("int").alias("y"), plain.alias("t"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(dense)]), "text-folds")
    names = [f"x{i}" for i in range(len(dense))]
    words, weights = lg.vocabulary(rows, folds, size, least)
    z = [c.alias(f"z{f}_{i}") for f in range(folds) for i, c in enumerate(scaled(rows.where(F.col("fold") != f), names) if names else [])]
    table = lg.blocks(rows.select("fold", "g", "y", "t", *z), [f"z{f}_{i}" for f in range(folds) for i in range(len(names))], words, weights)
    removed(rows)
    fits, alone, kinds = [], [], ["words", "both", "dense"]
    for f in range(folds):
        own = Counter()
        for g, y, n in counts:
            own[int(y)] += n * (of[g] != f)
        known = [k for k in range(classes) if 0 < own[k] < sum(own.values())]  # not what the training rows lack, or have alone
        alone.append([1.0 if own[k] else -1.0 for k in range(classes)])
        models = [(kind, k) for kind in kinds for k in known]
        fits.append(dict(zip(models, lg.fitted(table, f, folds, weights, len(names), models, own).T)) if models else {})
    return lg.held_out(table, folds, weights, len(names), kinds, classes, fits, alone)
