"""Chat formatting with cumulative snapshots collapsed.

A log that stores a conversation after every turn holds it many times, each a prefix of the next. Rolling hashes of the
turns name every prefix; a conversation whose own hash is a proper prefix of another's is a snapshot and goes by an
anti-join; of equal conversations the one with the smallest conv_id stays. Those kept are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, read_table

#: Turns that one window reads at once; longer conversations are cut into such blocks and their sums carried over.
BLOCK = 256
ORDER = ("conv_id", "turn", "role", "text")


def prefix_hashes(turns: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, text, at (1, 2, ...), h1, h2 for every one of the different rows of turns: the hash of the turns up to it.

    A turn's part is a 64-bit hash of its place, role and text under two seeds; a prefix's hash is the pair of sums of its
    parts, which can be carried from block to block. Places are ranks: order by turn, then role and text, nulls first. The rows
    are sorted by ranges and cut into blocks by their position, so a conversation may be spread over any number of tasks,
    whatever its turn numbers are.
    """
    sorted_ = turns.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id())
    placed = scratch.keep(sorted_, "sorted").withColumn("block", F.shiftright("pos", block.bit_length() - 1))
    within = Window.partitionBy("conv_id", "block").orderBy("pos")
    sizes = placed.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "start")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    ranked = placed.withColumn("k", F.row_number().over(within)).join(starts, same).withColumn("at", F.col("start") + F.col("k")).drop("c", "b", "k", "start")
    part = lambda seed: F.xxhash64(F.lit(seed), F.col("at"), F.coalesce("role", F.lit("\x00")), F.coalesce("text", F.lit("\x00"))).cast("decimal(38,0)")
    parts = ranked.withColumn("p1", part(1)).withColumn("p2", part(2))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("conv_id", "block").agg(F.sum("p1").alias("s1"), F.sum("p2").alias("s2"))
    carry = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).cast("decimal(38,0)").alias(f"c{k}") for k in (1, 2)))
    rolled = parts.withColumn("r1", F.sum("p1").over(upto)).withColumn("r2", F.sum("p2").over(upto))
    return rolled.join(carry, same).select(*ORDER, "at", (F.col("c1") + F.col("r1")).cast("decimal(38,0)").alias("h1"), (F.col("c2") + F.col("r2")).cast("decimal(38,0)").alias("h2"))


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of the maximal conversations of (conv_id, turn, role, text).

    Repeated rows count once. Turns with a null conv_id make one conversation of their own; null turn numbers come first, equal
    ones are ordered by role and text. Null roles and texts differ from empty ones when compared and are rendered as empty.
    Conversations are compared by length and 128 bits of hashes of their turns; of equal ones the smallest conv_id stays.
    Very long conversations are ranked and hashed in blocks; only a conversation that stays is gathered, to be rendered as one
    text. Extra columns aren't read; an empty table gives no rows.
    """
    scratch = Scratch(conversations.sparkSession, "chats")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").dropDuplicates()
    turns = scratch.keep(turns, "turns")  # the ranges are sampled from it before it is sorted
    hashed = scratch.keep(prefix_hashes(turns, scratch), "hashes")
    ends = scratch.keep(hashed.groupBy("conv_id").agg(F.max(F.struct("at", "h1", "h2")).alias("end")), "ends")
    distinct = ends.groupBy("end.at", "end.h1", "end.h2").agg(F.min("conv_id").alias("kept_id"), F.count(F.col("conv_id")).alias("named"))
    lengths = ends.select(F.col("conv_id").alias("c"), F.col("end.at").alias("last"))
    inner = hashed.select("conv_id", "at", "h1", "h2").join(lengths, F.col("conv_id").eqNullSafe(F.col("c"))).where("at < last").select("at", "h1", "h2").distinct()
    kept = distinct.join(inner, ["at", "h1", "h2"], "left_anti").select("kept_id", F.col("at").alias("n_turns"))
    rows = hashed.select("conv_id", "at", "role", "text").join(scratch.keep(kept, "kept"), F.col("conv_id").eqNullSafe(F.col("kept_id")))
    rendered = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    listed = rows.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("at", rendered.alias("out")))).alias("turns"))
    return listed.select("conv_id", "n_turns", F.array_join(F.transform("turns", lambda x: x["out"]), "").alias("rendered"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(read_table(spark, sf_dir, "conversations"))


OP5_SQL = """
with t as (select distinct conv_id, turn, role, text from conversations),
o as (select *, row_number() over w as k from t window w as (partition by conv_id order by turn, role, text)),
c as (select conv_id, count(*) as n_turns, list(struct_pack(a := role, b := text) order by k) as turns,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' order by k) as rendered from o group by conv_id),
own as (select turns, min(conv_id) as conv_id from c group by turns),
pre as (select distinct list_slice(turns, 1, i) as p from (select turns, unnest(range(1, n_turns)) as i from c))
select c.conv_id, c.n_turns, c.rendered from c join own using (conv_id) where not exists (select 1 from pre where p = c.turns)
"""
