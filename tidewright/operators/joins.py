"""Joins that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut, share_package


def interval_overlap(left: DataFrame, right: DataFrame, on: str, width: float) -> DataFrame:
    """For each row of left(on, id, start, end) the row of right(on, rid, rstart, rend) with the largest overlap; of equal ones
    the one that starts first; none if nothing overlaps. Intervals are dealt into buckets of the given width, so that the
    join is on equal keys; each pair counts once, in the bucket where the later of the two begins."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    l, r = left.withColumn("cell", cells("start", "end")), right.withColumn("cell", cells("rstart", "rend"))
    both = l.join(r, [on, "cell"]).where((F.col("start") < F.col("rend")) & (F.col("rstart") < F.col("end")) & (F.col("cell") == F.floor(F.greatest("start", "rstart") / width)))
    overlap = F.least("end", "rend") - F.greatest("start", "rstart")
    best = F.max_by(F.struct("rid", overlap.alias("overlap")), F.struct(overlap, -F.col("rstart"), -F.col("rid")))
    return both.groupBy(on, "id").agg(best.alias("b")).select(on, "id", "b.rid", "b.overlap")


def band_lookup(value: Column, bounds: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The name of the first upper bound that is at least the value; rest beyond all of them."""
    out = None
    for bound, name in bounds:
        out = F.when(value <= bound, name) if out is None else out.when(value <= bound, name)
    return out.otherwise(rest)


def strict_inner(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """An inner join that refuses to lose rows of left."""
    if not left.join(right, on, "left_anti").isEmpty():
        raise ValueError(f"rows without a partner on {on}")
    return left.join(right, on)


#: Copies of each key of the smaller side of a dealt join.
SALTS = 16


def join_dealt(rows: DataFrame, book: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with book(key, ...), which holds each key once, where a key may be hot among the rows: every key of the book
    stands `salts` times, and a key's rows are dealt over them by a hash of the whole row."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = book.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


#: Grams of the test side that may be sent to all tasks (some 40 MB).
MOST_GRAMS = 500_000


def ngram_leakage(test: DataFrame, train: DataFrame, key: str, grams: Column, *by: Column, most: int = MOST_GRAMS) -> DataFrame:
    """(key, *by, n, seen): how many distinct n-grams each test row has and how many of them occur in train, by what `by` says of g.

    If the test side has at most `most` different grams, they are sent to all tasks and the train side's grams are met with them where
    they are made. Else the train side's grams are made distinct first, each task its own, so that a frequent gram is one row a task.
    """
    own = test.select(key, F.explode(F.array_distinct(grams)).alias("g"))
    wanted = cut(own.select("g").distinct())
    every = train.select(F.explode(grams).alias("g"))
    met = every.join(F.broadcast(wanted), "g", "left_semi").distinct() if wanted.count() <= most else every.distinct().join(wanted, "g", "left_semi")
    return join_dealt(own, met.withColumn("hit", F.lit(1)), "g", "left").groupBy(key, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("seen"))


def _in_blocks(queries: DataFrame, rows: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame], most: int) -> DataFrame:
    """search(queries, rows) over blocks of at most about `most` queries, a stated set, each gathered and sent to the tasks."""
    parts = max(1, -(-queries.count() // most))
    found = [search(queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k) if parts > 1 else queries, rows) for k in range(parts)]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every


def nearest_by_tokens(queries: DataFrame, rows: DataFrame, most: int = 20_000) -> DataFrame:
    """For each of queries(qid, qset), a stated set, the row of rows(rid, rset) with the greatest Jaccard similarity; of equal ones
    the smallest rid. A query that shares no token gets the smallest rid and zero.

    The rows stay where they are: each batch counts the tokens that its rows share with every query of the block by an
    inverted index and gives the best row for each query, so a frequent token joins nothing.
    """
    share_package(rows.sparkSession)

    def search(block: DataFrame, rows: DataFrame) -> DataFrame:
        held = [(r["qid"], r["qset"]) for r in block.collect()]  # of a bounded size
        index: dict[str, list[int]] = {}
        for k, (_, tokens) in enumerate(held):
            for t in tokens or []:
                index.setdefault(t, []).append(k)
        sent = rows.sparkSession.sparkContext.broadcast(({t: np.array(v, np.int32) for t, v in index.items()}, np.array([len(t or []) for _, t in held], np.int64), [q for q, _ in held]))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            postings, sizes, names = sent.value
            score, row = np.full(len(names), -1.0), np.zeros(len(names), np.int64)
            for batch in batches:
                for rid, tokens in zip(batch.column("rid").to_pylist(), batch.column("rset").to_pylist()):
                    hits = [postings[t] for t in tokens or [] if t in postings]
                    both = np.bincount(np.concatenate(hits), minlength=len(names)) if hits else np.zeros(len(names), np.int64)
                    own = both / np.maximum(sizes + len(tokens or []) - both, 1)
                    better = (own > score) | ((own == score) & (rid < row))
                    score[better], row[better] = own[better], rid
            some = score >= 0
            yield pa.RecordBatch.from_arrays([pa.array([n for n, s in zip(names, some) if s], pa.int64()), pa.array(row[some]), pa.array(score[some])], names=["qid", "rid", "score"])

        return rows.select("rid", "rset").mapInArrow(best, "qid long, rid long, score double")

    found = _in_blocks(queries, rows, search, most)
    return found.groupBy("qid").agg(F.max_by(F.struct("rid", "score"), F.struct("score", -F.col("rid"))).alias("b")).select("qid", "b.rid", "b.score")


def cosine_nearest(queries: DataFrame, rows: DataFrame, most: int = 20_000) -> DataFrame:
    """(qid, rid, cosine): the nearest other row of rows(rid, v) for each of queries(qid, q), a stated set; of equal cosines (to nine
    places) the smallest rid. Each batch of rows is multiplied with the block of queries as a matrix and gives its best rows."""
    share_package(rows.sparkSession)

    def search(block: DataFrame, rows: DataFrame) -> DataFrame:
        held = block.collect()  # of a bounded size
        q = np.array([r["q"] for r in held], float)
        sent = rows.sparkSession.sparkContext.broadcast((q / np.linalg.norm(q, axis=1, keepdims=True) if held else q, np.array([r["qid"] for r in held], np.int64)))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, names = sent.value
            score, row = np.full(len(names), -2.0), np.zeros(len(names), np.int64)
            for batch in batches:
                ids = np.array(batch.column("rid").to_pylist(), np.int64)
                order = np.argsort(ids, kind="stable")
                v = np.array(batch.column("v").to_pylist(), float)[order]
                for at in range(0, len(ids) if len(names) else 0, 1024):
                    part, mine = v[at : at + 1024], ids[order][at : at + 1024]
                    cosine = np.round(unit @ (part / np.linalg.norm(part, axis=1, keepdims=True)).T, 9)
                    cosine[names[:, None] == mine[None, :]] = -3.0
                    k = cosine.argmax(axis=1)
                    own, rid = cosine[np.arange(len(names)), k], mine[k]
                    better = (own > score) | ((own == score) & (rid < row))
                    score[better], row[better] = own[better], rid[better]
            some = score >= -1.5
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(row[some]), pa.array(score[some])], names=["qid", "rid", "cosine"])

        return rows.select("rid", "v").mapInArrow(best, "qid long, rid long, cosine double")

    found = _in_blocks(queries, rows, search, most)
    return found.groupBy("qid").agg(F.max_by(F.struct("rid", "cosine"), F.struct("cosine", -F.col("rid"))).alias("b")).select("qid", "b.rid", "b.cosine")
