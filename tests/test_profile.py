"""The chained profile against its parts."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from tidewright.functions import deidentify, lexicons
from tidewright.functions import text as X
from tidewright.plans.q_profile import chained_profile


def plain_index(text):
    hits: dict = {}
    for k, c, d, m in lexicons.CUES:
        found = c in text if " " in c else re.search("(^|[^0-9a-z_])" + c, text)
        if found:
            hits[k] = hits.get(k, 0) + 1
    w = {k: d * m for k, _, d, m in lexicons.CUES}
    return round(1 / (1 + math.exp(-sum(min(1.0, 0.4 * n) * w[k] for k, n in hits.items()))), 6)


def test_chain(spark):
    rows = [
        (1, 1, "I feel nervous about the race and the coach of the team said so."), (1, 2, "We met Coach Petrov with the others, and I slept."), (1, 3, None), (1, 4, "ok"), (1, 4, "ok"),
        (2, 1, "My knee was torn. I am calm and ready for the final with my team."), (2, 2, "No cue here, honestly nothing big happens today."),
    ]
    found = chained_profile(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert len(found) == len(rows)
    clean = {(c, t): deidentify.deidentify(x).text for c, t, x in rows}
    verdicts = {(r["c"], r["t"]): r["v"] for r in spark.createDataFrame([(c, t, x) for (c, t), x in clean.items()], "c long, t long, x string").select("c", "t", X.admission(F.col("x")).alias("v")).collect()}
    assert "ok" in verdicts.values() and len(set(verdicts.values())) > 1
    for r in found:
        key = r["conv_id"], r["turn"]
        assert r["verdict"] == verdicts[key]
        if r["verdict"] != "ok":
            assert r["alone"] is None and r["in_context"] is None
            continue
        text, before = clean[key].lower(), clean.get((key[0], key[1] - 1), "").lower()
        assert (r["alone"], r["in_context"]) == (plain_index(text), plain_index(f"{before} {text}"))
