"""Deterministic splits, samples and resamples. Draws are hashes of seed and key: the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import draw
from tidewright.session import cut


def random_split(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """rows with side: the keys with the greatest draws are the test side, ceil(n share) of them.

    The cut is found from counts by draw prefix, so nothing is sorted in one task.
    """
    drawn = rows.withColumn("u", draw(F.lit(seed), F.col(key))).withColumn("cell", F.shiftright("u", 16))
    counts = drawn.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # 65536 rows at most
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    within = Window.partitionBy("cell").orderBy("u", key)
    ranked = drawn.join(F.broadcast(placed.select("cell", "before", "total")), "cell").withColumn("rank", F.col("before") + F.row_number().over(within))
    return ranked.withColumn("side", F.when(F.col("rank") <= F.floor(F.col("total") * (1 - share)), "train").otherwise("test")).drop("u", "cell", "before", "total", "rank")


def group_disjoint_split(rows: DataFrame, key: str, groups: Column, share: float, seed: int) -> DataFrame:
    """(key, side): rows whose groups all fall on one side; straddlers are discarded, rows without groups go by their own draw."""
    side = lambda x: draw(F.lit(seed), x) < F.lit(int(share * 2**32))
    drawn = rows.select(F.col(key), F.transform(groups, side).alias("sides"), side(F.col(key)).alias("own"))
    return drawn.select(key, F.when(F.size("sides") == 0, F.when(F.col("own"), "test").otherwise("train")).when(F.forall("sides", lambda x: x), "test").when(~F.exists("sides", lambda x: x), "train").otherwise("discarded").alias("side"))


def row_numbers(rows: DataFrame, stratum: str, order: list[Column], name: str = "rn") -> DataFrame:
    """rows with `name`, 1, 2, ... in each stratum by the order, and `name`_of, the stratum's size.

    Rows are sorted by ranges of (stratum, order), so that a large stratum is spread over tasks; a range's rows are numbered on
    from the count of the stratum's rows in the ranges before it.
    """
    placed = cut(rows.repartitionByRange(F.col(stratum), *order).withColumn("__range", F.spark_partition_id()))
    counts = placed.groupBy(stratum, "__range").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(stratum)
    before = counts.select(
        F.col(stratum).alias("__s"), F.col("__range").alias("__r"), F.sum("__n").over(every).alias(f"{name}_of"),
        F.coalesce(F.sum("__n").over(every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    within = Window.partitionBy(stratum, "__range").orderBy(*order)
    numbered = placed.withColumn(name, F.row_number().over(within)).join(before, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    return numbered.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__s", "__r", "__before")


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """rows with sum_<value> for each value: its sum over the rows of equal keys up to this one, in an order without ties.

    Rows are sorted by ranges of (keys, order), so that a large group is spread over tasks; what a group has in the ranges before is
    added to what it has in its own.
    """
    placed = cut(rows.repartitionByRange(*map(F.col, keys), *order).withColumn("__range", F.spark_partition_id()))
    upto = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "__range").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    before = sums.select(*keys, "__range", *(F.coalesce(F.sum(f"__t_{v}").over(upto), F.lit(0)).alias(f"__b_{v}") for v in values))
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("*", *(F.sum(v).over(within).alias(f"__w_{v}") for v in values)).join(before, [*keys, "__range"])
    return own.select(*rows.columns, *((F.col(f"__w_{v}") + F.col(f"__b_{v}")).alias(f"sum_{v}") for v in values))


def stratified(rows: DataFrame, stratum: str, order: list[Column], n: int | Column) -> DataFrame:
    """The first n rows of each stratum. n may read rn_of, the stratum's size."""
    return row_numbers(rows, stratum, order).where(F.col("rn") <= n)


def poisson_bootstrap(rows: DataFrame, key: str, value: str, resamples: int, seed: int) -> DataFrame:
    """(mean, low, high): percentile bounds of the mean over `resamples` weighted resamples.

    A row's weight in resample r is a Poisson(1) draw from the hash of seed, r and key, so all resamples are sums that every
    partition adds up for itself: resamples x partitions numbers are shuffled, not resamples x rows.
    """
    u = draw(F.lit(seed), F.col("r"), F.col(key)) / float(2**32)
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    each = rows.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).withColumn("w", weight)
    means = each.groupBy("r").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m")).groupBy().agg(F.array_sort(F.collect_list("m")).alias("ms"))  # `resamples` numbers
    low, high = int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(means).select(F.round("mean", 6).alias("mean"), F.round(F.get("ms", low), 6).alias("low"), F.round(F.get("ms", high), 6).alias("high"))


def weighted_draw(rows: DataFrame, key: str, group: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement, likelier for greater weights: the smallest exponential keys -ln(u) / w."""
    u = (draw(F.lit(seed), F.col(key)) + 1) / float(2**32 + 1)
    return stratified(rows.where(weight > 0).withColumn("e", F.round(-F.log(u) / weight, 9)), group, [F.col("e"), F.col(key)], n)
