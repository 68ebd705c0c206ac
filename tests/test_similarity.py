"""The similarity join: its candidates are few and none of the similar pairs is lost."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewright.operators import duplicates


def near_copies(seed, n):
    rng = random.Random(seed)
    rows, last = [], []
    for k in range(n):
        if k % 4 == 0 or not last:  # frequent and middling words, as in prose
            last = [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.choice((3, 20, 60, 200)))]
        else:
            last = [w if rng.random() > 0.04 else f"x{rng.randrange(300)}" for w in last]
        rows.append((k, " ".join(last) if k % 37 else ""))
    return rows


def brute(rows, threshold):
    least = {}
    for k, text in rows:
        if text:
            least.setdefault(frozenset(text.split()), k)
    sets = sorted((k, s) for s, k in least.items())
    return {(a, b): len(s & t) / len(s | t) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :] if len(s & t) / len(s | t) >= threshold - 1e-12}


@pytest.mark.parametrize("threshold", [1.0, 0.9, 0.8, 0.5])
@pytest.mark.parametrize("most", [1_000_000, 50])
def test_all_similar_pairs_of_few_candidates(spark, monkeypatch, threshold, most):
    monkeypatch.setattr(duplicates, "MOST_TOKENS", most)
    rows = near_copies(3, 240)
    docs = spark.createDataFrame(rows, "id long, text string")
    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    want = brute(rows, threshold)
    found = {(r["a"], r["b"]): r["jaccard"] for r in duplicates.similar_pairs(docs, "id", tokens, threshold).collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-9 for p in want)
    # the join alone gives hardly more pairs than are similar
    classes = duplicates._classes(duplicates._sets(docs, "id", tokens))
    assert duplicates._candidates(classes, threshold).count() <= 2 * len(want) + 40
    keys, pairs = duplicates.similar_classes(docs, "id", tokens, threshold)
    assert {r["id"] for r in keys.collect()} == {min(k for k, t in rows if frozenset(t.split()) == s) for s in {frozenset(t.split()) for _, t in rows if t}} and pairs.count() == len(want)


def kept_by_plain_rounds(rows, threshold):
    like = {}
    for a, b in brute(rows, threshold):
        like.setdefault(b, []).append(a)
    kept = {}
    for k in sorted({min(k for k, t in rows if frozenset(t.split()) == s) for s in {frozenset(t.split()) for _, t in rows if t}}):
        kept[k] = not any(kept[a] for a in like.get(k, ()))
    return {k for k, v in kept.items() if v}


@pytest.mark.parametrize(("threshold", "first", "most"), [(1.0, 20, 2_000_000), (0.8, 1 << 14, 2_000_000), (0.8, 20, 2_000_000), (0.5, 128, 300)])
def test_first_of_similar_sets_by_blocks(spark, monkeypatch, threshold, first, most):
    monkeypatch.setattr(duplicates, "FIRST_BLOCK", first)
    monkeypatch.setattr(duplicates, "MOST_PAIRS", most)
    rows = near_copies(7, 150)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    found = duplicates.first_of_similar(docs, "id", F.filter(F.split("text", " "), lambda t: t != ""), threshold)
    assert {r["id"] for r in found.collect()} == kept_by_plain_rounds(rows, threshold)


def test_a_group_of_near_copies_gives_as_many_pairs_as_rows(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "FIRST_BLOCK", 40)
    rows = [(k, " ".join(f"w{j}" for j in range(60) if j != k % 59) + f" own{k // 2}") for k in range(600)]
    counted, plain = [], duplicates._like
    monkeypatch.setattr(duplicates, "_like", lambda classes, pairs, threshold: (counted.append(pairs.count()), plain(classes, pairs, threshold))[1])
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    found = duplicates.first_of_similar(docs, "id", F.split("text", " "), 0.8)
    assert {r["id"] for r in found.collect()} == kept_by_plain_rounds(rows, 0.8) and sum(counted) < 4 * len(rows)


def test_shuffle_files_of_a_written_table_go(spark):
    from tidewright import session

    rows = spark.range(100_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = spark.conf.get(session.FILES_GO)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString("\n")))
    held = files()
    session.cut(rows)
    until = time.time() + 10
    while files() - held and time.time() < until:  # they are removed beside other work
        time.sleep(0.1)
    assert not files() - held and spark.conf.get(session.FILES_GO) == before
