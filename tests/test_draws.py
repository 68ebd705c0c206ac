"""Sequential draws against the plain rules, and that they fetch few rows of a large pool."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.operators import draws


def plain_balance(rows, n, before=(), in_order=True):
    """rows: (key, *strata)"""
    width, chosen = len(rows[0]) - 1, []
    filled = [Counter(b[1 + f] for b in before) for f in range(width)]
    left = [r for r in rows if r[0] not in {b[0] for b in before}]
    while left and len(chosen) < n:
        best = min(left, key=lambda r: ([filled[f][r[1 + f]] for f in range(width)] if in_order else sum(filled[f][r[1 + f]] for f in range(width)), r[0]))
        left.remove(best)
        chosen.append(best[0])
        for f in range(width):
            filled[f][best[1 + f]] += 1
    return chosen


def plain_quota(rows, quota, n):
    """rows: (order, key, groups)"""
    supply = {}
    for o, k, groups in sorted(rows):
        for g in set(groups):
            supply.setdefault(g, []).append((k, groups))
    counts, at, chosen, going = Counter(), Counter(), {}, True
    while going and len(chosen) < n:
        going = False
        for g in sorted(supply):
            if counts[g] >= quota or len(chosen) >= n:
                continue
            while at[g] < len(supply[g]):
                k, groups = supply[g][at[g]]
                at[g] += 1
                if k not in chosen:
                    chosen[k] = None
                    counts.update(set(groups))
                    going = True
                    break
    return list(chosen)


@pytest.mark.parametrize("seed", range(5))
def test_balanced_draw(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "b", "b", "b", None]), rng.choice("xyz"), rng.randint(0, 2)) for k in rng.sample(range(1000), 90)]
    pool = spark.createDataFrame(rows, "k long, s string, t string, u int")
    n = rng.choice([1, 30, 200])
    taken = spark.createDataFrame(rows[:17], pool.schema)
    for in_order in (True, False):
        assert draws.balanced_draw(pool, "k", ["s", "t", "u"], n, None, in_order) == plain_balance(rows, n, (), in_order)
        assert draws.balanced_draw(pool, "k", ["s", "t", "u"], n, taken, in_order) == plain_balance(rows, n, rows[:17], in_order)


@pytest.mark.parametrize("seed", range(4))
def test_quota_draw(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 20), k, rng.sample(["a", "b", "c", "d"], rng.randint(0, 3))) for k in range(80)]
    pool = spark.createDataFrame(rows, "o int, k long, g array<string>")
    for quota, n in ((5, 100), (9, 12), (100, 100)):
        assert draws.quota_draw(pool, "k", "g", [F.col("o")], quota, n) == plain_quota(rows, quota, n)


def test_gold_draw_and_its_coverage(spark):
    rng = random.Random(1)
    rows = [(k, rng.sample(["a", "b"], rng.randint(0, 2)), rng.choice("xyz"), k % 7) for k in range(120)]
    pool = spark.createDataFrame(rows, "k long, g array<string>, s string, o int")
    drawn = draws.gold_draw(pool, "k", "g", ["s"], [F.col("o")], 6, 40)
    found = {r["k"]: r["stage"] for r in drawn.orderBy("place").collect()}
    first = plain_quota([(r[3], r[0], r[1]) for r in rows], 6, 40)
    strata = [(r[0], r[2]) for r in rows]
    assert list(found) == first + plain_balance(strata, 40 - len(first), [s for k in first for s in strata if s[0] == k])
    told = {(r["what"], r["value"]): (r["available"], r["drawn"]) for r in draws.coverage(drawn, pool, "k", "g", ["s"]).collect()}
    for g in "ab":
        assert told["g", g] == (sum(g in r[1] for r in rows), sum(g in r[1] for r in rows if r[0] in found))
    assert sum(d for (what, _), (_, d) in told.items() if what == "s") == 40


def test_no_pool_is_gathered(spark, monkeypatch):
    fetched = []
    more = draws._Heads.more
    monkeypatch.setattr(draws._Heads, "more", lambda self, upto: (more(self, upto), fetched.append(self.fetched))[0])
    # one cell holds a third of the rows
    pool = spark.range(1_500_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(40)).cast("string"))).alias("s"), (F.col("id") % 5).alias("t"))
    chosen = draws.balanced_draw(pool, "id", ["s", "t"], 400)
    assert len(set(chosen)) == 400 and fetched[-1] < 4000
    assert draws.balanced_draw(pool.limit(0), "id", ["s"], 5) == []
