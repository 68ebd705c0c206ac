"""URL rules by a blocked Bloom filter and an exact hash join.

Every rule is listed by its canonical form, host then path. A url has one candidate form for each suffix of its host that
begins at a label and each path length that occurs in the list. The Bloom filter (blocks of 512 bits, one block a form)
passes the possible hits; the join with the list removes false positives; the longest rule wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches, read_table

#: The rules of the query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BLOCK_BITS, PROBES = 512, 6


class BlockedBloom:
    """A Bloom filter whose probes for one key stay within one block of 512 bits. Its size is fixed by max_bytes."""

    def __init__(self, keys: int, max_bytes: int = 16 << 20) -> None:
        self.blocks = max(1, min(max_bytes * 8, keys * 16) // BLOCK_BITS)
        self.bits = np.zeros((self.blocks, BLOCK_BITS // 64), np.uint64)

    def _places(self, key: bytes) -> tuple[int, list[int]]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.blocks, [h >> (9 * k) & (BLOCK_BITS - 1) for k in range(PROBES)]

    def add(self, key: bytes) -> None:
        block, bits = self._places(key)
        for b in bits:
            self.bits[block, b >> 6] |= np.uint64(1 << (b & 63))

    def __contains__(self, key: bytes) -> bool:
        block, bits = self._places(key)
        row = self.bits[block]
        return all(int(row[b >> 6]) >> (b & 63) & 1 for b in bits)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): from the first :// to / ? # or the end, A-Z lower-cased, then to ? # or the end; both empty without ://."""
    rest = (url or "").partition("://")[2]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:cut].translate(LOWER), path[:end]


LOWER = {c: c + 32 for c in range(65, 91)}


def candidate_forms(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """Suffixes of the host at label starts, as long as some listed host, times the prefixes of the path of the listed lengths.
    `longest` is the length of the longest listed host: a host of many labels has no more suffixes than that."""
    if not host:
        return []
    labels = [i for i in range(max(0, len(host) - longest), len(host) + 1) if not i or host[i - 1] == "."]
    return [host[a:] + path[:n] for a in labels for n in lengths if n <= len(path)]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", list_bytes: int = 8 << 20, bloom_bytes: int = 16 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url) under rules(host, path, verdict).

    A rule fits its host and all subdomains if the path starts with the rule's. rule is the longest fitting one (of equal
    ones the greatest form), null if none fits; then the verdict is `default`. Null urls and urls without :// have empty
    host and path and no rule. Rules with a null or empty host, null path or null verdict are left out; equal rules count
    once, block before allow. Lists up to list_bytes are gathered to build the filter on the driver and broadcast for the
    join; of longer ones the filter's blocks are built on the executors and the join is shuffled. Extra columns aren't
    read; an empty list gives every page the default.
    """
    spark = pages.sparkSession
    listed = rules.where("host is not null and host <> '' and path is not null and verdict is not null").select(F.concat("host", "path").alias("form"), F.length("path").alias("n"), F.length("host").alias("nh"), "verdict")
    listed = listed.groupBy("form", "nh", "n").agg(F.max("verdict").alias("verdict"))
    total = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("form") + 40), F.lit(0)).alias("b"), F.collect_set("n").alias("lengths"), F.coalesce(F.max("nh"), F.lit(0)).alias("longest")).first()
    small = total["b"] <= list_bytes
    longest, lengths = total["longest"], sorted(total["lengths"])  # one number for each path length, few however long the list
    bloom = BlockedBloom(total["n"], bloom_bytes)
    if small:
        for row in listed.select("form").collect():
            bloom.add(row["form"].encode())
    else:
        for row in _bloom_blocks(listed, bloom).toLocalIterator():
            bloom.bits[row["block"]] = np.frombuffer(row["bits"], np.uint64)
    shared = spark.sparkContext.broadcast(bloom)

    def make():
        held = shared.value

        def each(batch: pa.RecordBatch):
            both = [split_url(u) for u in batch.column("url").to_pylist()]
            hits = [[f for f in candidate_forms(h, p, lengths, longest) if f.encode("utf-8", "surrogatepass") in held] for h, p in both]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([h for h, _ in both], pa.string()), pa.array([p for _, p in both], pa.string()), pa.array(hits, pa.list_(pa.string()))], names=["page_id", "host", "path", "forms"])

        return each

    seen = map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), make, "page_id long, host string, path string, forms array<string>")
    if small and len(lengths) * 40 < 1 << 20:
        book = listed.withColumn("fit", F.struct((F.col("nh") + F.col("n")).alias("len"), "form", "verdict", "nh", "n")).select("form", "fit")
        book = F.broadcast(book)
    else:
        book = listed.withColumn("fit", F.struct((F.col("nh") + F.col("n")).alias("len"), "form", "verdict", "nh", "n")).select("form", "fit")
    own = seen.withColumn("rid", F.monotonically_increasing_id())
    none = own.where(F.size("forms") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = own.where(F.size("forms") > 0).select("rid", "page_id", "host", "path", F.explode("forms").alias("form"))
    fits = asked.join(book, "form", "left").withColumn("fit", F.when(_fits(), F.col("fit")))
    best = fits.groupBy("rid", "page_id", "host", "path").agg(F.max("fit").alias("fit"))
    return none.unionByName(best.select("page_id", "host", "path", F.col("fit.form").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict")))


def _fits() -> Column:
    """The joined form is cut between host and path just where the rule is: equal strings may be cut elsewhere."""
    at = F.length("host") - F.col("fit.nh")
    suffix = (at == 0) | ((at > 0) & (F.expr("substring(host, length(host) - fit.nh, 1)") == "."))
    return suffix & F.expr("endswith(host, left(form, fit.nh))") & F.expr("startswith(path, substring(form, fit.nh + 1))")


def _bloom_blocks(listed: DataFrame, bloom: BlockedBloom) -> DataFrame:
    """The filter's blocks that hold a bit, built where the list's rows are and merged by block: bounded by the filter's size."""
    empty = BlockedBloom(1)
    empty.blocks = bloom.blocks

    def make():
        def each(batch: pa.RecordBatch):
            places = [empty._places(x.encode()) for x in batch.column("form").to_pylist()]
            rows = [(block, b >> 6, np.int64(np.uint64(1 << (b & 63)).view(np.int64))) for block, bits in places for b in bits]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["block", "word", "mask"])

        return each

    words = map_batches(listed.select("form"), make, "block long, word long, mask long").groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))

    def pack(pdf):
        import pandas as pd

        bits = np.zeros(BLOCK_BITS // 64, np.int64)
        bits[pdf.word] = pdf["mask"]
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "bits": [bits.tobytes()]})

    return words.groupBy("block").applyInPandas(pack, "block long, bits binary")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(read_table(spark, sf_dir, "pages"), rules)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

OP10_SQL = rf"""
with r(rh, rp, v) as (values {_VALUES}),
u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select row_number() over () as rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from u),
f as (select p.*, rh || rp as rule, v, row_number() over (partition by rid order by length(rh || rp) desc nulls last) as k
    from p left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from f where k = 1
"""
