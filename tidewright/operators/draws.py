"""Draws that depend on what was drawn before, without gathering the pool.

What a step chooses depends on the counts so far and on the next key of each cell (a combination of strata), so the driver keeps
a heap over cells and fetches the first keys of each cell alone, twice as many whenever a cell runs out: about as many rows as are drawn
and as there are cells, whatever the pool's size.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.sampling import row_numbers

#: Cells whose counts the driver may hold.
MOST_CELLS = 200_000


class _Heads:
    """The keys of each cell in order, fetched by rank."""

    def __init__(self, numbered: DataFrame, cell: str, key: str, first: int) -> None:
        self.numbered, self.cell, self.key, self.upto = numbered, cell, key, 0
        self.keys: dict[object, list] = {}
        self.fetched = 0
        self.more(first)

    def more(self, upto: int) -> None:
        rows = self.numbered.where((F.col("rn") > self.upto) & (F.col("rn") <= upto)).select(self.cell, self.key, "rn").collect()
        for r in sorted(rows, key=lambda r: r["rn"]):
            self.keys.setdefault(r[self.cell], []).append(r[self.key])
        self.fetched += len(rows)
        self.upto = upto

    def at(self, cell, k: int, size: int):
        """The k-th key of a cell of `size` keys, from zero; None behind the last."""
        while k < size and k >= len(self.keys.get(cell, ())):
            self.more(2 * self.upto)
        return self.keys[cell][k] if k < size else None


def _in_cells(pool: DataFrame, key: str, cell: Column, order: list[Column]) -> tuple[DataFrame, dict]:
    """The pool's keys numbered in each cell, and each cell's size."""
    numbered = row_numbers(pool.select(F.col(key), cell.alias("__cell"), *(c.alias(f"__o{i}") for i, c in enumerate(order))), "__cell", [F.col(f"__o{i}") for i in range(len(order))])
    sizes = numbered.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS + 1).collect()
    if len(sizes) > MOST_CELLS:
        raise ValueError(f"over {MOST_CELLS} cells")
    return numbered, {r["__cell"]: r["n"] for r in sizes}


def balanced_draw(pool: DataFrame, key: str, strata: list[str], n: int, taken: DataFrame | None = None, in_order: bool = False) -> list:
    """n keys of a pool of different keys, one after the other: always the row whose strata's values were drawn the fewest times
    together or, with in_order, compared stratum by stratum; then the smallest key. Null is a value like others. taken: rows
    drawn before, which count but are not drawn again.

    A cell's place in the order only ever grows, so a heap entry that is too small is put back with its present place.
    """
    if taken is not None:
        pool = pool.join(taken.select(key), key, "left_anti")
    numbered, sizes = _in_cells(pool, key, F.struct(*strata), [F.col(key)])
    filled: list[Counter] = [Counter() for _ in strata]
    if taken is not None:
        for f, s in enumerate(strata):
            filled[f].update({r[s]: r["n"] for r in taken.groupBy(s).agg(F.count(F.lit(1)).alias("n")).collect()})  # values of a stratum
    heads = _Heads(numbered, "__cell", key, max(4, 2 * n // max(1, len(sizes))))
    drawn: Counter = Counter()

    def place(c: tuple) -> tuple:
        counts = [filled[f][v] for f, v in enumerate(c)]
        return (*(counts if in_order else [sum(counts)]), heads.at(c, drawn[c], sizes[c]))

    heap = [(place(c), i, c) for i, c in enumerate(sizes)]
    heapq.heapify(heap)
    chosen: list = []
    while heap and len(chosen) < n:
        said, i, cell = heapq.heappop(heap)
        now = place(cell)
        if now == said:
            chosen.append(now[-1])
            drawn[cell] += 1
            for f, v in enumerate(cell):
                filled[f][v] += 1
            if drawn[cell] == sizes[cell]:
                continue
            now = place(cell)
        heapq.heappush(heap, (now, i, cell))
    return chosen


def quota_draw(pool: DataFrame, key: str, groups: str, order: list[Column], quota: int, n: int) -> list:
    """At most n keys in turns: each group, in order of name, takes its next key by `order` that no group took, until it has
    `quota` of them (a key counts for all its groups) or no more keys. groups: an array column; rows without groups aren't drawn."""
    each = pool.select(F.col(key), F.explode(F.array_distinct(groups)).alias("__group"), *(c.alias(f"__by{i}") for i, c in enumerate(order)))
    numbered, sizes = _in_cells(each, key, F.col("__group"), [F.col(f"__by{i}") for i in range(len(order))] + [F.col(key)])
    heads = _Heads(numbered, "__cell", key, 2 * quota)
    member: dict = {}

    def groups_of(keys: list) -> Callable[[object], list]:
        new = [k for k in keys if k not in member]
        if new:  # the groups of keys at hand, a bounded list
            for r in pool.where(F.col(key).isin(new)).select(F.col(key), F.array_distinct(groups).alias("g")).collect():
                member[r[key]] = r["g"]
        return member.__getitem__

    names, counts, cursor, chosen = sorted(sizes), Counter(), Counter(), {}
    going = True
    while going and len(chosen) < n:
        going = False
        for g in names:
            if counts[g] >= quota or len(chosen) >= n:
                continue
            while (k := heads.at(g, cursor[g], sizes[g])) is not None:
                cursor[g] += 1
                if k not in chosen:
                    if k not in member:
                        groups_of([x for own in heads.keys.values() for x in own])
                    chosen[k] = None
                    counts.update(member[k])
                    going = True
                    break
    return list(chosen)


def gold_draw(pool: DataFrame, key: str, groups: str, strata: list[str], order: list[Column], quota: int, n: int) -> DataFrame:
    """(key, place, stage) of a draw of n keys: first each group's quota in turns, then the least filled strata."""
    spark = pool.sparkSession
    kind = pool.schema[key].dataType.simpleString()
    first = quota_draw(pool, key, groups, order, quota, n)
    taken = pool.join(F.broadcast(spark.createDataFrame([(k,) for k in first], f"{key} {kind}")), key).select(key, *strata)  # at most n keys
    rest = balanced_draw(pool, key, strata, n - len(first), taken, in_order=True) if len(first) < n else []
    rows = [(k, i, "quota") for i, k in enumerate(first)] + [(k, len(first) + i, "balance") for i, k in enumerate(rest)]
    return spark.createDataFrame(rows, f"{key} {kind}, place int, stage string")


def coverage(drawn: DataFrame, pool: DataFrame, key: str, groups: str, strata: list[str]) -> DataFrame:
    """(what, value, available, drawn): rows of the pool and of the draw by group and by each stratum's values."""
    hit = pool.join(F.broadcast(drawn.select(key).withColumn("hit", F.lit(1))), key, "left")
    pairs = F.concat(
        F.transform(F.coalesce(F.array_distinct(groups), F.array().cast("array<string>")), lambda g: F.struct(F.lit(groups).alias("what"), g.cast("string").alias("value"))),
        F.array(*(F.struct(F.lit(s).alias("what"), F.col(s).cast("string").alias("value")) for s in strata)),
    )
    each = hit.select(F.explode(pairs).alias("p"), "hit")
    return each.groupBy("p.what", "p.value").agg(F.count(F.lit(1)).alias("available"), F.count("hit").alias("drawn"))
