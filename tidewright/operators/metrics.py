"""Evaluation of predictions held in long form: (key, label, truth, pred, prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    one = lambda t, p: F.sum(((F.col("truth") == t) & (F.col("pred") == p)).cast("long"))
    return rows.groupBy(*keys).agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"))


def scores(c: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; a ratio of nothing to nothing is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def overall(rows: DataFrame, key: str) -> DataFrame:
    """Macro F1 over all labels, micro F1, and the share of keys whose labels are all right."""
    by_label = scores(confusion(rows, "label")).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    micro = scores(confusion(rows)).select(F.round("f1", 6).alias("micro_f1"))
    exact = rows.groupBy(key).agg(F.min((F.col("truth") == F.col("pred")).cast("int")).alias("ok")).agg(F.round(F.avg("ok"), 6).alias("subset_accuracy"))
    return by_label.crossJoin(micro).crossJoin(exact)  # one row each


def reliability(rows: DataFrame, bins: int) -> DataFrame:
    """(bin, n, confidence, observed, gap) of equal-width bins, probability one in the last."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("prob") * bins)).cast("long")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("confidence"), F.avg("truth").alias("observed")).withColumn("gap", F.abs(F.col("confidence") - F.col("observed")))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two ratings over the observed categories; 1 or 0 where chance agreement is complete."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("x")), cells.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("s"))
    both = total.crossJoin(chance).select("t", (F.col("same") / F.col("t")).alias("po"), (F.col("s") / (F.col("t").cast("double") * F.col("t"))).alias("pe"))  # one row each
    return both.select(F.col("t").alias("n"), F.round("po", 6).alias("observed"), F.round("pe", 6).alias("chance"), F.round(F.when(F.col("pe") >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def weighted_kappa(rows: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Quadratic-weighted kappa of two ordinal ratings 0..levels-1."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    weight = ((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) / float((levels - 1) ** 2)
    seen = cells.agg(F.sum("n").alias("t"), F.sum(weight * F.col("n")).alias("o"))
    left, right = cells.groupBy(a).agg(F.sum("n").alias("x")), cells.groupBy(b).agg(F.sum("n").alias("y"))
    expected = left.crossJoin(F.broadcast(right)).agg(F.sum(weight * F.col("x") * F.col("y")).alias("e"))  # levels x levels
    return seen.crossJoin(expected).select(F.col("t").alias("n"), F.round(1 - F.when(F.col("e") == 0, 0.0).otherwise(F.col("o") / (F.col("e") / F.col("t"))), 6).alias("kappa"))


def best_thresholds(rows: DataFrame, grid: list[float]) -> DataFrame:
    """(label, threshold, f1): the grid's threshold with the greatest F1, of equal ones the nearest to one half, then the smaller."""
    points = rows.select("label", "truth", "prob", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    f = scores(confusion(points.withColumn("pred", (F.col("prob") >= F.col("threshold")).cast("int")), "label", "threshold")).withColumn("f1", F.round("f1", 6))
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.round(F.abs(F.col("threshold") - 0.5), 6), -F.col("threshold")))
    return f.groupBy("label").agg(best.alias("b")).select("label", "b.threshold", "b.f1")
