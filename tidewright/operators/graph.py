"""Components of links, and choices along them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.joins import join_dealt
from tidewright.session import cut, share_package

#: Links of a component that one task may hold.
MOST_LINKS = 200_000


def _least(links: DataFrame) -> DataFrame:
    """links(u, v) with m, the least of u and its partners; a hub's rows are dealt over copies of its least."""
    least = links.groupBy("u").agg(F.min("v").alias("lv")).select("u", F.least("u", "lv").alias("m"))
    return join_dealt(links, least, "u")


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of every id in pairs(a, b): the least id it reaches. Each round links every id's greater partners, then its smaller
    ones, with the least of them, which roughly halves distances; it ends when a round changes nothing."""
    star = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        star = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return star.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """first_kept() for components of any size: each round settles the ids whose smaller partners are all settled."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    settled = cut(ids.join(pairs.select(F.col("b").alias("id")), "id", "left_anti").withColumn("kept", F.lit(True)))
    total = ids.count()
    while settled.count() < total:
        known = join_dealt(pairs, settled.withColumnRenamed("id", "a"), "a", "left").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("hit"), F.min(F.col("kept").isNotNull()).alias("all"))
        new = known.where(F.col("hit") | F.col("all")).join(settled, "id", "left_anti").select("id", (~F.col("hit")).alias("kept"))
        settled = cut(settled.unionByName(new))
    return settled


def first_kept(pairs: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(id, kept) of every id in pairs(a, b), a < b: an id is kept unless a kept smaller one is its partner.

    At most `most_links` links are decided in one task. Of more, components are found first; each of at most that many links is
    decided whole in the order of its ids, in one task, so a long chain takes no more rounds than a short one. Larger components, if
    there are any, are decided by rounds.
    """
    share_package(pairs.sparkSession)
    pairs = cut(pairs.select("a", "b").where("a < b").distinct())
    kind = pairs.schema["a"].dataType.simpleString()

    def decide(table: pa.Table) -> pa.Table:
        smaller: dict = {}
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            smaller.setdefault(a, [])
            smaller.setdefault(b, []).append(a)
        kept: dict = {}
        for i in sorted(smaller):
            kept[i] = not any(kept[s] for s in smaller[i])
        return pa.table({"id": pa.array(list(kept), table.schema.field("a").type), "kept": pa.array(list(kept.values()), pa.bool_())})

    if pairs.count() <= most_links:  # all components in one task
        return cut(pairs.groupBy().applyInArrow(decide, f"id {kind}, kept boolean"))
    placed = cut(join_dealt(pairs, components(pairs).withColumnRenamed("id", "a"), "a"))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("links"))
    great = cut(sizes.where(F.col("links") > most_links).select("root"))
    if great.isEmpty():
        return cut(placed.groupBy("root").applyInArrow(decide, f"id {kind}, kept boolean"))
    great = F.broadcast(great)  # fewer rows than links / most_links
    few = placed.join(great, "root", "left_anti").groupBy("root").applyInArrow(decide, f"id {kind}, kept boolean")
    return cut(few.unionByName(_by_rounds(cut(placed.join(great, "root", "left_semi").select("a", "b")))))
