"""The spending ledger as a stateful stream: each row is admitted, warned of or refused as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.session import share_package

VERDICTS = "month string, user_id long, event_id long, value double, spent double, verdict string"


def judged(values: list[float], spent: float, cap: float, warn: float) -> list[tuple[float, str]]:
    """(spent so far, verdict) of each value in turn: what would pass the cap is refused and not spent; what passes the share `warn`
    of it is warned of."""
    out = []
    for v in values:
        if spent + v > cap:
            out.append((spent, "refuse"))
            continue
        spent += v
        out.append((spent, "warn" if spent > warn * cap else "ok"))
    return out


def capped_spend(events: DataFrame, cap: float, warn: float = 0.8, late: str = "1 hour") -> DataFrame:
    """VERDICTS of each event of a stream with event_id, t, user_id and value, by calendar month and user.

    An event that comes again within the watermark counts once; one that comes later than that is dropped. Rows of a batch are
    taken by time, then id. A month's state, one number a user, goes when the watermark has passed its end.
    """
    share_package(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        found = judged(rows["value"].tolist(), state.get[0] if state.exists else 0.0, cap, warn)
        state.update((found[-1][0],))
        end = pd.Timestamp(f"{key[0]}-01") + pd.offsets.MonthBegin(1)
        state.setTimeoutTimestamp(int(end.timestamp() * 1000))
        yield pd.DataFrame({"month": key[0], "user_id": key[1], "event_id": rows["event_id"].to_numpy(), "value": rows["value"].to_numpy(), "spent": [s for s, _ in found], "verdict": [v for _, v in found]})

    once = events.withWatermark("t", late).dropDuplicatesWithinWatermark(["event_id"])
    keyed = once.select(F.date_format("t", "yyyy-MM").alias("month"), "user_id", "event_id", "t", F.coalesce("value", F.lit(0.0)).alias("value"))
    return keyed.groupBy("month", "user_id").applyInPandasWithState(run, VERDICTS, "spent double", "append", GroupStateTimeout.EventTimeTimeout)
