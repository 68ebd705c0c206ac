"""Corpus profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parent_context(rows: DataFrame, parent: str, index: str, text: str) -> DataFrame:
    """(parent, context): the texts of each parent's children, in order of index, joined by blanks."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(index), F.col(text))))
    return rows.groupBy(parent).agg(F.array_join(F.transform(listed, lambda x: x[text]), " ").alias("context"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, share): the share of rows in which each column isn't null."""
    one = rows.agg(*(F.round(F.avg(F.col(c).isNotNull().cast("double")), 9).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns))).alias("x")).select("x.*")


def describe(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, sample deviation (zero for one row), least, nearest-rank percentiles and greatest by key."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})").cast("long")
    return rows.groupBy(key).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"), F.min(value).alias("low"),
        at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.9).alias("p90"), F.max(value).alias("high"),
    )


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of equal widths, the last bin closed; one bin if all values are equal."""
    span = F.broadcast(rows.agg(F.min(value).alias("lo"), ((F.max(value) - F.min(value)) / float(bins)).alias("w")))  # one row
    at = F.when(F.col("w") == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.nullif("w", F.lit(0.0)))))
    return rows.crossJoin(span).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """tokens, types, hapax and type-token ratio of tokens(token)."""
    c = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("hapax"), F.round(F.count(F.lit(1)) / F.sum("n"), 9).alias("ttr"))
