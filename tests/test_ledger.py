"""The capped ledger: rows one by one, over several batches, with repeats, late rows and a replay."""

from __future__ import annotations

import datetime
import random

from tidewright.streaming import ledger, streams


def test_rows_in_turn():
    assert ledger.judged([50, 40, 20, 10, 1], 0.0, 100, 0.8) == [(50, "ok"), (90, "warn"), (90, "refuse"), (100, "warn"), (100, "refuse")]


def test_batches_repeats_and_late_rows(spark, tmp_path):
    rng, day = random.Random(4), datetime.datetime(2024, 1, 30)
    rows = [(k, day + datetime.timedelta(hours=k), rng.randint(1, 3), "purchase", float(rng.randint(1, 40)), None) for k in range(90)]
    folder, batches = tmp_path / "in", [rows[:30], rows[30:60] + rows[57:60], rows[60:] + [(900, day, 1, "purchase", 5.0, None)]]  # repeats, and one long past
    out, mark = str(tmp_path / "rows"), str(tmp_path / "mark")
    for batch in batches:
        spark.createDataFrame(batch, streams.EVENT_SCHEMA.replace("timestamp_ntz", "timestamp")).selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(folder))
        found = streams.drain(ledger.capped_spend(streams.event_stream(spark, str(folder), 1), 200.0, late="3 hours"), out, mark)
        found.count()  # a second start from the same place adds nothing
        streams.drain(ledger.capped_spend(streams.event_stream(spark, str(folder), 1), 200.0, late="3 hours"), out, mark)
    got = {r["event_id"]: (r["month"], r["spent"], r["verdict"]) for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 90 and 900 not in got
    spent: dict = {}
    for k, t, user, _, v, _ in rows:
        key = (t.strftime("%Y-%m"), user)
        told = ledger.judged([v], spent.get(key, 0.0), 200.0, 0.8)[0]
        spent[key] = told[0]
        assert got[k] == (key[0], *told)
