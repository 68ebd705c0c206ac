"""Exact duplicates and near-duplicates by set similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.graph import first_kept
from tidewright.operators.joins import join_dealt
from tidewright.session import cut, share_package


def exact_profile(rows: DataFrame, text: str) -> DataFrame:
    """Rows, distinct texts, rows in groups of two or more, and the largest group."""
    c = rows.groupBy(F.xxhash64(text), text).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_groups"), F.max("n").alias("largest"))


def collapse(rows: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """(kept, ambiguous, n) for each text: the smallest key, and whether the rows' labels differ."""
    return rows.groupBy(text).agg(F.min(key).alias("kept"), (F.min(label) != F.max(label)).alias("ambiguous"), F.count(F.lit(1)).alias("n")).drop(text)


def payload_plan(rows: DataFrame, payload: Column) -> DataFrame:
    """How many calls a run over distinct payloads takes, and what it saves."""
    g = rows.groupBy(payload.alias("payload")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("calls"), (F.sum("n") - F.count(F.lit(1))).alias("copied"), F.round((F.sum("n") - F.count(F.lit(1))) / F.sum("n"), 9).alias("saving"), F.max("n").alias("fan_out"))


#: Tokens that the tasks know the frequency of, ids of linked classes that may be broadcast, bits of a set's sketch, sets worked on at once.
MOST_TOKENS, MOST_IDS, BITS, AT_ONCE = 1_000_000, 500_000, 256, 256
#: Similar sets share one token of their prefixes, and another for each so many tokens.
ONE_IN = 64
#: Classes of the first block of first_of_similar(), how much the next ones grow, candidate pairs of a block, and keys that blocks may end at.
FIRST_BLOCK, BLOCKS_GROW, MOST_PAIRS, MOST_BOUNDS = 1 << 14, 4, 2_000_000, 20_000
_SKETCH = [f"b{k}" for k in range(BITS // 64)]


def _sets(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(id, set, digest) of every row; digest, 128 bits of hashes of the sorted set, is null for empty sets."""
    sets = rows.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("set"))
    digest = F.struct(F.xxhash64("set").alias("h1"), F.xxhash64(F.lit("second"), "set").alias("h2"))
    return sets.withColumn("digest", F.when(F.size("set") > 0, digest))


def _classes(sets: DataFrame) -> DataFrame:
    """(digest, id, n, set, copies) of each class of equal sets, named by its smallest key; written, since it is read several times.
    Copies meet in each task before they are shuffled."""
    grouped = sets.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("set").alias("set"), F.count(F.lit(1)).alias("copies"))
    return cut(grouped.select("digest", "id", F.size("set").alias("n"), "set", "copies"))


def _frequencies(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The hashes of the most frequent tokens, at most MOST_TOKENS, ascending, how many sets hold each, and whether these are all that
    two sets hold."""
    words = cut(hashed.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    known, least = 0, 2
    for r in words.groupBy(F.least("df", F.lit(100_000)).alias("df")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).collect():
        known += r["n"]
        if known > MOST_TOKENS:
            least = r["df"] + 1
            break
    found = words.where(F.col("df") >= least).select("token", F.least("df", F.lit(1 << 30)).cast("int").alias("df")).toArrow()
    token, df = found.column("token").to_numpy(), found.column("df").to_numpy()
    order = np.argsort(token)
    return token[order], df[order], least == 2


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, n, at, token, b0, ...) of the tokens, by hash, that two similar sets share _least() of: the first n - ceil(threshold n) + _least()
    of each in one order of all tokens, rarest first, with their places in it; any order is right. Tokens that no other set holds are left out
    where that is known. b0, ... are the set's sketch: for each of BITS parts of the hashes whether it holds an odd number of them."""
    hashed = classes.select("id", F.transform("set", lambda t: F.xxhash64(t)).alias("hashes"))
    spark = classes.sparkSession
    share_package(spark)
    sent = spark.sparkContext.broadcast(_frequencies(hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, whole = sent.value
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            token = batch.column(1).flatten().to_numpy()
            size = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            place = np.minimum(np.searchsorted(known, token), max(0, len(known) - 1))
            frequency = np.where(known[place] == token, df[place], 0) if len(known) else np.zeros(len(token), np.int32)
            odd = (np.bincount(row * BITS + (token & (BITS - 1)), minlength=len(size) * BITS) & 1).astype(np.uint8)
            sketch = np.packbits(odd.reshape(len(size), BITS), axis=1).view(np.int64)
            order = np.lexsort((token, frequency, row))
            at = np.arange(len(token)) - (np.cumsum(size) - size)[row]
            kept = at < (size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1 + size // ONE_IN)[row]
            if whole:
                kept &= frequency[order] > 0
            at, token, row = at[kept], token[order][kept], row[kept]
            columns = [batch.column(0).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(token), *(pa.array(c[row]) for c in sketch.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "at", "token", *_SKETCH])

    kind = classes.schema["id"].dataType.simpleString()
    return cut(hashed.mapInArrow(run, f"id {kind}, n int, at int, token long, " + ", ".join(f"{c} long" for c in _SKETCH)))


def _least(n: Column) -> Column:
    """How many tokens of their prefixes two similar sets share at least, of which the smaller one has n."""
    return F.floor(n / ONE_IN) + 1


def _near(x: DataFrame, y: DataFrame, threshold: float, bands: Callable[[Column, Column], Column], smaller: bool) -> DataFrame:
    """(a, b), a < b, of the sets of prefixes x and y that may be similar. Sizes are dealt into bands that similar ones are at most one apart in;
    bands(own, first) gives those that a row of x is met in, first being whether its place is one that a smaller set needs. `smaller`: only pairs
    with the smaller set (of equal ones that of the smaller id) in x. Sets that are similar share at least t / (1 + t) (na + nb) tokens. From the
    k-th one shared on, both sets need that many but k - 1: so the first k shared ones stand in the prefixes, k being _least(), and pairs that share
    fewer there are left out; large sets share few by chance. Each other token changes at most one bit of the sketches' difference. All
    bounds are exact: no similar pair is lost."""
    share, width = threshold / (1.0 + threshold), max(-math.log(threshold) * (1.0 + 1e-6), 1e-6)
    own = F.floor(F.log("n") / width)
    side = lambda rows, s, band: rows.select(*(F.col(c).alias(c if c == "token" else f"{s}_{c}") for c in rows.columns), band.alias("band"))
    met = side(x, "x", F.explode(bands(own, F.col("n") - F.col("at") >= F.col("n") * 2.0 * share - _least(F.col("n")) + 1 - 1e-6))).join(side(y, "y", own), ["token", "band"])
    total, least = F.col("x_n") + F.col("y_n"), _least(F.least("x_n", "y_n"))
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    differ = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col(f"x_{_SKETCH[0]}").bitwiseXOR(F.col(f"y_{_SKETCH[0]}"))))
    sizes = (F.col("x_n") >= F.col("y_n") * threshold - 1e-9) & (F.col("y_n") >= F.col("x_n") * threshold - 1e-9) & (F.col("x_id") != F.col("y_id"))
    if smaller:
        sizes &= (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") < F.col("y_id")))
    met = met.where(sizes & (left >= total * share - least + 1 - 1e-6) & (differ <= total * (1.0 - 2.0 * share) + 1e-6))
    met = met.groupBy(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), least.alias("least")).agg(F.count(F.lit(1)).alias("shared"))
    return met.where("shared >= least").select("a", "b")


def _near_own(prefix: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of all sets of a prefix table that may be similar."""
    return _near(prefix, prefix, threshold, lambda own, first: F.when(first, F.array(own, own + 1)), True)


def _near_other(prefix: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of the sets of two prefix tables that may be similar; those of `other`, the greater table, are moved once."""
    return _near(prefix, other, threshold, lambda own, first: F.when(first, F.array(own - 1, own, own + 1)).otherwise(F.array(own - 1, own)), False)


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of all classes that may be similar."""
    return _near_own(_prefixes(classes, threshold), threshold)


def _like(classes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the written candidate pairs that are similar."""
    # only the sets of classes that met another are moved
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    met = cut(classes.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "id", "left_semi").select("id", "set"))
    sa, sb = met.select(F.col("id").alias("a"), F.col("set").alias("sa")), met.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def _pairs(classes: DataFrame, threshold: float) -> DataFrame:
    return _like(classes, cut(_candidates(classes, threshold)), threshold)


def similar_pairs(rows: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b, of all pairs of classes of equal token sets whose Jaccard similarity is at least threshold.

    rows with equal sets are one class, named by its smallest key: copies don't multiply pairs. Tokens are ordered with the
    frequent ones last; two sets this similar share a token among the first n - ceil(t n) + 1 of each, so
    only those are joined, with a length bound; the sets are then compared. Empty sets match nothing.
    """
    return _pairs(_classes(_sets(rows, key, tokens)), threshold)


def similar_classes(rows: DataFrame, key: str, tokens: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The smallest key of each class of equal token sets, as (key), and similar_pairs() of these classes. Empty sets are in neither."""
    classes = _classes(_sets(rows, key, tokens))
    return classes.select(F.col("id").alias(key)), _pairs(classes, threshold)


def _without(rows: DataFrame, lost: DataFrame | None) -> DataFrame:
    """rows whose id is not in the written table lost(id)."""
    if lost is None:
        return rows
    return rows.join(F.broadcast(lost) if lost.count() <= MOST_IDS else lost, "id", "left_anti")


def first_of_similar(rows: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """(key), the smallest of each class of equal token sets, unless a class that stays and has a smaller one is at least threshold similar.
    Empty sets are left out.

    Classes are decided by blocks of ascending keys, each BLOCKS_GROW times as large as the last: a block's own pairs are decided, and
    what stays of it is met with all later classes, of which the similar ones are out. So near copies are met with the few of them that
    stay and not with one another: a large group gives as many pairs as rows, not their square. A block of over MOST_PAIRS candidates
    is decided by smaller ones.
    """
    classes = _classes(_sets(rows, key, tokens))
    prefix = _prefixes(classes, threshold)
    every = max(1, classes.count() // MOST_BOUNDS)
    bounds = sorted(r["id"] for r in classes.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).select("id").collect())  # where blocks may end
    lost, at, size = None, 0, max(1, FIRST_BLOCK // every)
    while True:
        left = cut(_without(prefix.where(F.col("id") > F.lit(bounds[at - 1])) if at else prefix, lost)) if lost is not None else prefix
        while True:
            end = bounds[at + size - 1] if at + size < len(bounds) else None
            block = left if end is None else left.where(F.col("id") <= F.lit(end))
            near = cut(_near_own(block, threshold))
            if size == 1 or near.count() <= MOST_PAIRS:
                break
            size = max(1, min(size, len(bounds) - at) // BLOCKS_GROW)
        out = cut(first_kept(_like(classes, near, threshold).select("a", "b")).where("not kept").select("id"))
        lost = out if lost is None else cut(lost.unionByName(out))
        if end is None:
            return _without(classes.select("id"), lost).select(F.col("id").alias(key))
        met = cut(_near_other(_without(block, out), left.where(F.col("id") > F.lit(end)), threshold))
        lost = cut(lost.unionByName(_like(classes, met, threshold).select(F.col("b").alias("id")).distinct()))
        at, size = at + size, size * BLOCKS_GROW


def similar_items(rows: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """(key, class_id, copies, links) of every row: its class of equal token sets, the rows of that class, and how many other rows,
    copies included, have a set at least threshold similar. Empty sets match nothing: null, 0, 0.
    """
    sets = _sets(rows, key, tokens)
    members = cut(sets.select(F.col("id").alias(key), "digest"))
    classes = _classes(sets)
    named = classes.select("digest", F.col("id").alias("class_id"), "copies")
    pairs = cut(_pairs(classes, threshold).select("a", "b"))
    others = named.select(F.col("class_id").alias("b"), F.col("copies").alias("others"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(others, "b").groupBy("a").agg(F.sum("others").alias("others")).withColumnRenamed("a", "class_id")
    links = named.join(linked, "class_id", "left").select("digest", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    whole = join_dealt(members, links, "digest", "left")
    return whole.select(key, "class_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
