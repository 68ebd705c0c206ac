"""Erasure curves against a plain version."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import functions as F

from tidewright.operators import faithfulness


def plain(key, weights, fractions, seed):
    n, odds = len(weights), lambda s: 1 / (1 + math.exp(-s))
    u = [int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:8], 16) for i in range(n)]
    top, any_ = sorted(range(n), key=lambda i: (-weights[i], i)), sorted(range(n), key=lambda i: (u[i], i))
    rows = []
    for f in fractions:
        k = max(1, round(n * f))
        if k < n:
            s, t, r = sum(weights), sum(weights[i] for i in top[:k]), sum(weights[i] for i in any_[:k])
            rows.append([odds(s) - odds(x) for x in (s - t, t, s - r, r)])
    return [sum(c) / len(rows) for c in zip(*rows)] if n > 1 and rows else None


def test_curves(spark):
    rng = random.Random(3)
    texts = {k: [rng.choice([0.0, 0.0, 1.5, -1.0, 1.0]) for _ in range(rng.choice([1, 2, 3, 10, 40]))] for k in range(60)}
    words = spark.createDataFrame([(k, i, w) for k, ws in texts.items() for i, w in enumerate(ws)], "key long, i int, weight double").repartition(4)
    found = {r["key"]: r for r in faithfulness.erasure_curves(words, ["key"], "i", "weight", [F.col("key")], seed=7).collect()}
    for k, ws in texts.items():
        want = plain(k, ws, faithfulness.FRACTIONS, 7)
        if want is None:
            assert k not in found
            continue
        got = [found[k][c] for c in ("comprehensiveness", "sufficiency", "random_comprehensiveness", "random_sufficiency")]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)) and found[k]["words"] == len(ws)
    assert faithfulness.erasure_curves(words.limit(0), ["key"], "i", "weight", [F.col("key")]).collect() == []


def test_an_explanation_beats_random_words(spark):
    words = spark.range(400).select((F.col("id") / 20).cast("int").alias("key"), (F.col("id") % 20).alias("i"), F.when(F.col("id") % 20 < 2, 3.0).otherwise(0.0).alias("weight"))
    r = faithfulness.margins(faithfulness.erasure_curves(words, ["key"], "i", "weight", [F.col("key")]).withColumn("all", F.lit(1)), "all").first()
    assert r["comprehensiveness_margin"] > 0.2 and r["sufficiency_margin"] > 0.2 and r["n"] == 20


def test_texts_are_ranked_where_their_rows_lie(spark):
    texts = spark.createDataFrame([(k, list(range(6)), [(1, 1.5), (4, -1.0)][: k % 3]) for k in range(9)], "key long, ats array<int>, points array<struct<at: int, w: double>>")
    curves = faithfulness.curves_of_texts(texts, ["key"], "ats", "points", [F.col("key")], seed=7)
    plan = curves._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    for r in curves.collect():
        weights = [0.0, 1.5 if r["key"] % 3 else 0.0, 0.0, 0.0, -1.0 if r["key"] % 3 == 2 else 0.0, 0.0]
        got = [r[c] for c in ("comprehensiveness", "sufficiency", "random_comprehensiveness", "random_sufficiency")]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, plain(r["key"], weights, faithfulness.FRACTIONS, 7)))


def test_the_query_shuffles_no_words(spark, tmp_path):
    import duckdb

    from tidewright.plans import catalog

    catalog.load_all()
    said = "The cat and the dog, que der with THE\tend of the day"
    rows = [(1, said), (1, said), (2, None), (3, ""), (4, "the"), (5, "no cue in it"), (6, "and with and"), (7, "der der der que"), (8, " the\n" * 300 + "x " * 90)]  # one doc_id twice: one text, as in the SQL
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars").selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as long) as n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["b5_erasure_curves"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(catalog.ORACLES["b5_erasure_curves"]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == want.keys() and all(a == b if isinstance(a, int) else abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_draws_are_md5(monkeypatch):
    import numpy as np

    monkeypatch.setattr(faithfulness, "AT_ONCE", 50)
    names = ["42:1:worry", "", "x" * 43, "y" * 44, "é" * 30, "none", "42:7:calm"]
    places = [np.array(x, np.int32) for x in ([0, 9, 10, 10, 99, 100, 2**31 - 1], range(120), [5, 10**9], [7], [1, 22], [], range(990, 1010))]
    want = [[int(hashlib.md5(f"{n}:{i}".encode()).hexdigest()[:8], 16) for i in p.tolist()] for n, p in zip(names, places)]
    assert [x.tolist() for x in faithfulness._draws(names, places)] == want
