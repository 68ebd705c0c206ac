"""The stream's type ratio, first-kept pools and decays against plain versions, and at sizes that a driver loop or pairs would not stand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import panel


def plain_ratio(tokens, width):
    if len(tokens) <= width:
        return len(set(tokens)) / len(tokens) if tokens else 0.0
    return sum(len(set(tokens[i : i + width])) for i in range(len(tokens) - width + 1)) / ((len(tokens) - width + 1) * width)


@pytest.mark.parametrize("width", [2, 5, 50])
@pytest.mark.parametrize("size", [0, 1, 4, 49, 50, 51, 97, 98, 99, 100, 130, 3000])
def test_stream_ratio(spark, width, size):
    rng = random.Random(size + width)
    tokens, rows, at = [rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(size)], [], 0
    while at < size:
        step = rng.choice([0, 1, 3, 40])
        rows.append((len(rows), tokens[at : at + step]))
        at += step
    rows.append((len(rows), None))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k long, t array<string>").repartition(3)
    r = panel.stream_type_ratio(table, [F.col("k")], F.col("t"), width).first()
    assert r["tokens"] == size and abs(r["mattr"] - plain_ratio(tokens, width)) < 1e-12
    assert r["windows"] == (max(1, size - width + 1) if size else 0)


def plain_kept(pairs):
    smaller = {}
    for a, b in pairs:
        smaller.setdefault(a, set())
        smaller.setdefault(b, set()).add(a)
    kept = {}
    for i in sorted(smaller):
        kept[i] = not any(kept[s] for s in smaller[i])
    return kept


@pytest.mark.parametrize("most", [200_000, 6])
def test_first_kept(spark, most):
    from tidewright.operators import graph

    rng = random.Random(most)
    pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(90)} | {(200, 200 + k) for k in range(1, 12)} | {(300 + a, 300 + b) for b in range(6) for a in range(b)}
    table = spark.createDataFrame([*pairs, *list(pairs)[:5]], "a long, b long")
    assert {r["id"]: r["kept"] for r in graph.first_kept(table, most).collect()} == plain_kept(pairs)
    assert graph.first_kept(table.limit(0)).collect() == []


def test_first_kept_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from tidewright.operators import graph

    rounds, plain_cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (rounds.append(1), plain_cut(df))[1])
    found = graph.first_kept(spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert found.where(F.col("kept") != (F.col("id") % 2 == 0)).count() == 0 and found.count() == 10_001
    assert len(rounds) < 40


def test_decayed_sums(spark):
    import math

    rng = random.Random(2)
    rows = [(k, rng.choice(["u", "u", "v", None]), rng.choice([0.0, 5.0, 10.0, rng.random() * 60, rng.random() * 60 - 30]), rng.random() < 0.5) for k in range(300)]
    table = spark.createDataFrame(rows, "id long, key string, at double, ask boolean").repartition(5)
    found = {r["id"]: (r["n"], r["decayed"]) for r in panel.decayed_sums(table, "key", "id", "at", F.col("ask"), ~F.col("ask"), 3.0, 10.0).collect()}
    for i, key, t, ask in rows:
        near = [u for _, k, u, a in rows if not a and key and k == key and t - 10.0 <= u <= t]  # null keys equal none
        if ask and near:
            assert found[i][0] == len(near) and abs(found[i][1] - sum(math.exp(-(t - u) / 3.0) for u in near)) < 1e-9
        else:
            assert i not in found


def test_decays_of_a_busy_key_pair_nothing(spark):
    # a third of the rows are one key's; pairs would be a billion
    rows = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), (F.col("id") / 300.0).alias("t"), (F.col("id") % 2 == 0).alias("ask"))
    found = panel.decayed_sums(rows, "key", "id", "t", F.col("ask"), ~F.col("ask"), 50.0, 400.0)
    r = found.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    assert r["n"] > 49_000 and r["most"] > 19_000
