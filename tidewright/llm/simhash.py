"""SimHash near-duplicates by anchor points.

A 64-bit fingerprint is cut into two halves of 32 bits. Two fingerprints that differ in at most three bits differ in at
most one bit of some half, so within a half the threshold is one. The anchors of a half are the words of a covering
code: the perfect Hamming code of length 31 (covering radius one) next to one free bit. A fingerprint's home is the
anchor within the covering radius; the fingerprint is replicated to every anchor within radius plus threshold (at most
17 a half). If x and y differ in at most one bit of the half, y is replicated to x's home, so comparing the homes with the
replicas of each anchor finds every link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, join_dealt, map_batches, raw_bytes, read_table
from tidewright.llm.graph import connected_components

SEED, SHINGLE, THRESHOLD = 42, 3, 3
#: Homes at one anchor that are compared by a plain join; anchors with more are compared in blocks of this side.
BLOCK = 256


def fingerprint(raw: bytes) -> int:
    """Majority bits of the XXH64 of the 3-word shingles, repeats included; zero without words."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    norm = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(norm[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints():
    def each(batch: pa.RecordBatch):
        fps = np.array([fingerprint(x) for x in raw_bytes(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps)], names=["doc_id", "th", "fp"])

    return each


def _error_patterns() -> np.ndarray:
    """Row s: the error patterns of weight at most two with syndrome s; the pattern of least weight first, 0-padded rows repeat it."""
    table = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        table[s] = [1 << (s - 1), *((1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s)]
    return table


def _anchors():
    patterns = _error_patterns()
    checks = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1)) for b in range(5)]

    def each(batch: pa.RecordBatch):
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for half in range(2):
            v = (fps.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            s = sum((np.bitwise_count(v & c).astype(np.int64) & 1) << b for b, c in enumerate(checks))
            near = v[:, None] ^ patterns[s]
            keys = np.concatenate((near, near[:, :1] ^ np.uint64(1 << 31)), axis=1) | np.uint64(half << 32)
            real = np.ones(keys.shape, bool)
            real[s == 0, 1:16] = False  # a code word has no other anchor within two bits
            home = np.zeros(keys.shape, bool)
            home[:, 0] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys[real].view(np.int64)), pa.array(np.repeat(fps, real.sum(axis=1))), pa.array(home[real])], names=["anchor", "fp", "home"])

    return each


def _block_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the homes and the replicas of one block, reduced to a spanning forest of the same components."""
    a, b = pdf.fp[pdf.home].to_numpy().view(np.uint64), pdf.fp[~pdf.home].to_numpy().view(np.uint64)
    links = np.bitwise_count(a[:, None] ^ b[None, :]) <= THRESHOLD
    low = np.arange(len(a))
    cols = np.where(links.any(axis=0))[0]
    while True:
        of_b = np.where(links[:, cols], low[:, None], len(a)).min(axis=0) if len(cols) else np.empty(0, int)
        back = np.full(len(b), len(a))
        back[cols] = of_b
        new = np.minimum(low, np.where(links, back[None, :], len(a)).min(axis=1, initial=len(a)))
        if (new == low).all():
            break
        low = new
    u = np.concatenate((a, b[cols]))
    v = np.concatenate((a[low], a[of_b]))
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})[u != v]


def links(fps: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints fps(fp): all of them at ordinary anchors, a spanning forest of each block at
    anchors with over `block` homes, where the number of pairs would grow with the square. Components are the same. The
    replicas are written once; joins on anchors that may be crowded deal their rows."""
    at = scratch.keep(map_batches(fps.select("fp"), _anchors, "anchor long, fp long, home boolean"), "anchors")
    homes, all_at = at.where("home").select("anchor", "fp"), at.select("anchor", F.col("fp").alias("fp2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= THRESHOLD
    as_links = (F.col("fp").alias("u"), F.col("fp2").alias("v"))
    crowds = at.groupBy("anchor").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("all")).where(F.col("homes") > block)
    crowds = scratch.keep(crowds.select("anchor", F.ceil(F.col("homes") / block).cast("int").alias("kh"), F.ceil(F.col("all") / block).cast("int").alias("kv")), "crowds")
    if crowds.isEmpty():
        return homes.join(all_at, "anchor").where(near & (F.col("fp") < F.col("fp2"))).select(*as_links)
    marked = scratch.keep(join_dealt(at, crowds, "anchor", "left"), "marked")
    calm = marked.where("kh is null")
    few = calm.where("home").select("anchor", "fp").join(calm.select("anchor", F.col("fp").alias("fp2")), "anchor")
    dealt = marked.where("kh is not null").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("kh"))).withColumn("j", F.pmod(F.xxhash64("fp"), F.col("kv")))
    sides = dealt.where("home").select("anchor", "fp", F.lit(True).alias("home"), "i", F.explode(F.sequence(F.lit(0), F.col("kv") - 1)).alias("j")).unionByName(
        dealt.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("kh") - 1)).alias("i"), "j")
    )
    many = sides.groupBy("anchor", "i", "j").applyInPandas(_block_forest, "u long, v long")
    return few.where(near & (F.col("fp") < F.col("fp2"))).select(*as_links).unionByName(many)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, th (hash of the text), fp, component_id, root.

    root is the least fingerprint of the component and names it whatever the ids are. component_id is the smallest doc_id
    reachable over links of at most three differing bits. Null or empty texts and texts without words have fingerprint zero
    and link as any other; a component whose ids are all null has a null component_id. Exact copies share a fingerprint and
    meet as one node. Very long texts are read whole. Extra columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.keep(map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")), _fingerprints, "doc_id long, th long, fp long"), "own")
    fps = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = scratch.keep(connected_components(links(fps, scratch, block), scratch), "roots")
    named = scratch.keep(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "root"), "named")
    linked = named.where("root is not null")  # a fingerprint without links is a component of its own
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = named.where("root is null").select("fp", F.col("least").alias("component_id"), F.col("fp").alias("root"))
    of_fp = scratch.keep(join_dealt(linked.select("fp", "root"), best, "root").select("fp", "component_id", "root").unionByName(alone), "components")
    # both sides are written tables: they come straight from a shuffle, so the rows of a frequent fingerprint can be split
    return own.join(of_fp, "fp").select("doc_id", "th", "fp", "component_id", "root")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component, one each: the smallest doc_id (null only where all are null), then the
    smallest hash of the text, once. Ids may be null or repeated; of wholly equal rows one stays; an empty table gives none.
    All columns of docs, whatever their names, stay as they are."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "th")).alias("first")
    chosen = near_duplicates(docs).groupBy("root").agg(first).select(F.struct(F.col("first.doc_id").alias("id"), F.col("first.th").alias("th")).alias("key"))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # a null id equals a null id: the hash of the key stands in for it in the join, the key itself is compared
    kept = rows.alias("d").join(chosen.alias("c"), (F.xxhash64("d.key") == F.xxhash64("c.key")) & F.col("d.key").eqNullSafe(F.col("c.key")), "left_semi")
    return kept.groupBy("key").agg(F.first("row").alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
