"""Samples that any engine draws alike: order by md5, then rank within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import pick_key


def capped(df: DataFrame, by: list[str], id_col: str, cap: int, salt: str = "-42") -> DataFrame:
    """At most so many rows a group; only ids and keys should be passed, the rest joined afterwards."""
    return df.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy(pick_key(id_col, salt=salt), id_col))).where(F.col("pick") <= cap)


def allocation(counts: DataFrame, group: str, stratum: str, most: int) -> DataFrame:
    """(group, stratum, n, alloc): min(most, total) shared by largest remainders, ties by stratum. counts: group, stratum, n."""
    w = Window.partitionBy(group)
    total = F.sum("n").over(w)
    want = F.least(total, F.lit(most))
    rows = counts.withColumn("exact", F.col("n") * want / total).withColumn("floor", F.floor("exact")).withColumn("want", want)
    rows = rows.withColumn("left", F.col("want") - F.sum("floor").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), stratum)))
    return rows.select(group, stratum, "n", (F.col("floor") + F.when(F.col("k") <= F.col("left"), 1).otherwise(0)).alias("alloc"))


def stratified(df: DataFrame, group: str, stratum: str, id_col: str, most: int) -> DataFrame:
    counts = df.groupBy(group, stratum).agg(F.count("*").alias("n"))
    alloc = allocation(counts, group, stratum, most).select(group, stratum, "alloc")
    ranked = df.select(group, stratum, id_col, F.row_number().over(Window.partitionBy(group, stratum).orderBy(pick_key(id_col), id_col)).alias("pick"))
    # the ranks are dealt by the same keys already, so this join moves no row of them
    return ranked.join(alloc, [group, stratum]).where("pick <= alloc")


def grouped_folds(counts: list[tuple[str, int, int]], folds: int) -> dict[str, int]:
    """A fold for each group so that no group is cut and the classes stay balanced: groups with the most uneven classes go
    first, each to the fold whose class shares then spread least. counts: (group, class, n), one row a group and class."""
    classes = sorted({c for _, c, _ in counts})
    by: dict[str, list[int]] = {}
    for g, c, n in counts:
        by.setdefault(g, [0] * len(classes))[classes.index(c)] += n
    total = [sum(v[i] for v in by.values()) for i in range(len(classes))]
    held = [[0.0] * len(classes) for _ in range(folds)]

    def sd(v: list[float]) -> float:
        mean = sum(v) / len(v)
        return (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5

    out = {}
    for g, v in sorted(by.items(), key=lambda x: (-sd([float(n) for n in x[1]]), x[0])):
        def spread(f: int) -> tuple:
            after = [[h + (n if k == f else 0) for h, n in zip(held[k], v)] for k in range(folds)]
            return (round(sum(sd([row[i] / max(1, total[i]) for row in after]) for i in range(len(classes))), 12), sum(held[f]), f)

        best = min(range(folds), key=spread)
        held[best] = [h + n for h, n in zip(held[best], v)]
        out[g] = best
    return out


def greedy_sheet(rows: list[tuple], each: int, most: int) -> list[tuple]:
    """(cell, outlet, id) picked in order: up to `each` of a cell while no outlet has more than `most` over all cells, then
    cells still short are filled up without regard to outlets. rows: (cell, outlet, id) in order of preference."""
    picked: list[tuple] = []
    cells: dict = {}
    outlets: dict = {}
    for limited in (True, False):
        for r in rows:
            if cells.get(r[0], 0) < each and r not in picked and not (limited and outlets.get(r[1], 0) >= most):
                picked.append(r)
                cells[r[0]], outlets[r[1]] = cells.get(r[0], 0) + 1, outlets.get(r[1], 0) + 1
    return picked
