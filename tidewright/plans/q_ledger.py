"""The capped ledger as a stream over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.plans.catalog import query
from tidewright.session import scratch_folder
from tidewright.streaming import ledger, streams

_CAP = 300.0
_A27 = f"""with e as (select strftime(ts, '%Y-%m') as month, user_id, list({{'s': value, 'r': 0}} order by ts, event_id) as rows, count(*) as n from events where event_type = 'purchase' group by all),
x as (select month, user_id, n, list_reduce(list_prepend({{'s': 0.0::double, 'r': 0}}, rows), lambda a, v: case when a.s + v.s > {_CAP} then {{'s': a.s, 'r': a.r + 1}} else {{'s': a.s + v.s, 'r': a.r}} end) as last from e)
select month, user_id, n, last.r::bigint as refused, round(last.s, 4) as spent from x"""


@query("a27_stream_capped_ledger", _A27)
def a27s(spark, sf):
    """What each user may spend a month, judged row by row as a stateful stream."""
    root = scratch_folder(spark, "stream")
    bought = streams.event_stream(spark, f"{sf}/events.parquet*").where("event_type = 'purchase'")
    rows = streams.drain(ledger.capped_spend(bought, _CAP), f"{root}/rows", f"{root}/checkpoint")
    return rows.groupBy("month", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("verdict") == "refuse").cast("long")).alias("refused"), F.round(F.max("spent"), 4).alias("spent"))
