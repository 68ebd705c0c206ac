"""The chained profile: what is said is de-identified once, then admitted, placed on topic and scored alone and in its context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import deidentify
from tidewright.functions import lexicons as L
from tidewright.functions import text as X
from tidewright.operators import cues
from tidewright.plans.catalog import query
from tidewright.session import cut
from tidewright.sources.readers import table


def chained_profile(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, verdict, relevance, alone, in_context) of each row of turns(conv_id, turn, text).

    Texts are de-identified in one pass, written, and all else reads that: the admission verdict, the relevance, and for admitted texts
    the fused index of the text and of the text behind the turn before it. A text without any cue has the index 0.5. Null texts
    are empty and aren't admitted.
    """
    placed = turns.select(F.concat_ws("|", "conv_id", "turn", F.monotonically_increasing_id()).alias("id"), "conv_id", "turn", "text")
    said = deidentify.deidentified(placed, "id").select("id", "text")
    kept = cut(said.withColumn("p", F.split("id", r"\|")).select("id", F.col("p")[0].cast("long").alias("conv_id"), F.col("p")[1].cast("long").alias("turn"), "text"))
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "id")), F.lit(""))
    judged = cut(kept.withColumn("context", before).select("*", X.admission(F.col("text")).alias("verdict"), F.round(X.relevance(F.col("text")), 6).alias("relevance")))
    both = judged.where("verdict = 'ok'").select("id", F.explode(F.array(F.struct(F.lit("a").alias("mode"), F.col("text")), F.struct(F.lit("c").alias("mode"), F.concat_ws(" ", "context", "text").alias("text")))).alias("s"))
    hits = cues.cue_hits(both.select(F.concat_ws("|", "id", "s.mode").alias("id"), F.lower("s.text").alias("low")), "id", F.col("low"), [(k, c) for k, c, _, _ in L.CUES])
    weights = {k: d * float(m) for k, _, d, m in L.CUES}
    weight = F.coalesce(*(F.when(F.col("name") == k, F.lit(w)) for k, w in weights.items()))
    scores = hits.groupBy("id").agg(F.sum(F.least(F.lit(1.0), 0.4 * F.col("hits")) * weight).alias("s"))
    by_id = scores.select(F.regexp_replace("id", r"\|[ac]$", "").alias("id"), F.substring("id", -1, 1).alias("mode"), (1 / (1 + F.exp(-F.col("s")))).alias("index"))
    wide = by_id.groupBy("id").agg(F.max(F.when(F.col("mode") == "a", F.col("index"))).alias("alone"), F.max(F.when(F.col("mode") == "c", F.col("index"))).alias("in_context"))
    index = lambda c: F.when(F.col("verdict") == "ok", F.round(F.coalesce(c, F.lit(0.5)), 6)).alias(c)
    return judged.join(wide, "id", "left").select("conv_id", "turn", "verdict", "relevance", index("alone"), index("in_context"))


@query("c1_chained_profile")
def c1(spark, sf):
    return chained_profile(table(spark, sf, "conversations"))
