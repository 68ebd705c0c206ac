"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (the whole item if it has fewer). It is held as its set of word
shingles, ordered by rarity in the documents. Full containment is asked for, so the necessary prefix is one token, the
rarest shingle: a document is a candidate where it has that shingle. The position bound (the window must lie inside the
document) and the length bound (it must have enough words) come next; then the words are compared.

A benchmark of a checked size is gathered and broadcast, and the join runs beside the scan. A larger one is joined by a
shuffle of the documents' shingles.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import Scratch, alnum_words, join_dealt, map_batches, raw_bytes, read_table, slices

WINDOW, SHINGLE = 10, 5
#: Windows of the benchmark up to which they are gathered and broadcast: about 120 bytes of text and 1 KB of index each, in every worker.
BROADCAST_WINDOWS = 50_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RESULT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def windows_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """The windows of an item; none without words."""
    return [tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))] if words else []


def shingles_of(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    """The shingles of a window in order; a window of few words is one shingle."""
    size = min(SHINGLE, len(window))
    return [window[i : i + size] for i in range(len(window) - size + 1)]


class Shingles:
    """Finds the listed shingles in texts: words are numbered, and only runs of known words are looked up."""

    def __init__(self, shingles: list[tuple[bytes, ...]]) -> None:
        self.number = {w: k for k, w in enumerate(sorted({w for s in shingles for w in s}), 1)}
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, s in enumerate(shingles):
            by_size[len(s)].append((int(self._keys(np.array([self.number[w] for w in s], np.uint64), len(s))[0]), k))
        self.by_size = {size: (np.array([a for a, _ in sorted(x)], np.uint64), np.array([b for _, b in sorted(x)])) for size, x in by_size.items()}

    @staticmethod
    def _keys(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = (out ^ ids[i : i + n]) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(position, shingle) of possible hits; two shingles of one key (a clash) are both given."""
        n = len(words)
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, n)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        hits: list[tuple[int, int]] = []
        for size, (keys, which) in self.by_size.items():
            if n < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            own = np.zeros(len(at), np.uint64)
            for i in range(size):
                own = (own ^ ids[at + i]) * MULTIPLIER
                own ^= own >> np.uint64(29)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for k in np.flatnonzero(high > low):
                hits += [(int(at[k]), int(which[j])) for j in range(low[k], high[k])]
        return hits


class Index:
    """The broadcast side: windows by their rarest shingle."""

    def __init__(self, items: dict[tuple[bytes, ...], set[str]], frequency: dict[tuple[bytes, ...], int]) -> None:
        by_prefix: dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...]]]] = defaultdict(list)
        for window in items:
            _, token, offset = min((frequency.get(s, 0), s, i) for i, s in enumerate(shingles_of(window)))
            by_prefix[token].append((offset, window))
        self.items, prefixes = items, sorted(by_prefix)
        self.shingles, self.windows = Shingles(prefixes), [by_prefix[p] for p in prefixes]

    def occurrences(self, words: list[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        n, found = len(words), []
        for at, k in self.shingles.find(words):
            for offset, window in self.windows[k]:
                start = at - offset
                if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                    found.append((start, window))
        return found


def summary(n_words: int, found: list[tuple[int, int]], items: set[str]) -> tuple[int, int, int, str, bool]:
    """The result columns of a document with n_words words, the found (start, length) and their items."""
    hit = 0
    if found:
        edges = np.zeros(n_words + 1, np.int64)
        for start, length in found:
            edges[start] += 1
            edges[start + length] -= 1
        hit = int((np.cumsum(edges) > 0).sum())
    return n_words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0


def _add(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(5))], names=["row", *(n for n, _ in RESULT)])


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("row", docs.schema["row"].dataType), *(T.StructField(n, t) for n, t in RESULT)])


def _beside_scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    items: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for row in benchmark.collect():  # of a checked size
        for window in windows_of(alnum_words(row["text"].encode("utf-8", "surrogatepass"))):
            items[window] |= {str(row["item_id"])} if row["item_id"] is not None else set()
    listed = sorted({s for w in items for s in shingles_of(w)})
    all_shingles = spark.sparkContext.broadcast(Shingles(listed))

    def make_counts():
        shingles = all_shingles.value

        def each(batch: pa.RecordBatch):
            seen: dict[int, int] = defaultdict(int)
            for raw in raw_bytes(batch.column("text")):
                for k in {k for _, k in shingles.find(alnum_words(raw))}:
                    seen[k] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

        return each

    counts = map_batches(docs.select("text"), make_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # one row for each listed shingle at most
    shared = spark.sparkContext.broadcast(Index(dict(items), {listed[r["k"]]: r["n"] for r in counts}))

    def make():
        index = shared.value

        def each(batch: pa.RecordBatch):
            rows = []
            for raw in raw_bytes(batch.column("text")):
                words = alnum_words(raw)
                found = index.occurrences(words)
                rows.append(summary(len(words), [(s, len(w)) for s, w in found], {i for _, w in found for i in index.items[w]}))
            yield _add(batch, rows)

        return each

    return map_batches(docs, make, _schema(docs))


def _key(size: int, words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words), size) - (1 << 63)


def _text_key(raw: bytes) -> bytes:
    return hashlib.md5(raw).digest()


def _shuffled(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same join for a benchmark of any size: shingles of both sides meet by a shuffle."""
    scratch = Scratch(docs.sparkSession, "decontaminate")

    def make_windows():
        def each(batch: pa.RecordBatch):
            rows = []
            for item, raw in zip(batch.column("item_id").to_pylist(), raw_bytes(batch.column("text"))):
                for w in windows_of(alnum_words(raw)):
                    rows += [(b" ".join(w), len(w), item, i, len(s), _key(len(s), s)) for i, s in enumerate(shingles_of(w))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["words", "n", "item", "offset", "size", "key"])

        return each

    parts = scratch.keep(map_batches(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), make_windows, "words binary, n int, item string, offset int, size int, key long"), "windows")

    def make_shingles():
        def each(batch: pa.RecordBatch):
            for part in slices(batch, "text", 64, 1 << 20):
                rows: list[tuple[bytes, int, int, int]] = []
                for raw in raw_bytes(part.column("text")):
                    words, own = alnum_words(raw), _text_key(raw)
                    for size in sizes:
                        rows += [(own, len(words), i, _key(size, words[i : i + size])) for i in range(len(words) - size + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.int64()))], names=["text_key", "total", "at", "key"])

        return each

    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # SHINGLE of them at most
    wanted = parts.select("key").distinct()
    # a shingle of one frequent word may be wanted: its rows are dealt over copies of the wanted key
    shingles = map_batches(docs.select("text"), make_shingles, "text_key binary, total int, at int, key long")
    hits = scratch.keep(join_dealt(shingles, wanted, "key", "left_semi").distinct(), "hits")
    frequency = hits.groupBy("key", "text_key").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    ranked = parts.join(frequency, "key", "left").groupBy("words", "n").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "key", "offset")).alias("prefix"))
    prefix = ranked.select("words", "n", F.col("prefix.key").alias("key"), F.col("prefix.offset").alias("offset"))
    at = join_dealt(hits, prefix, "key").withColumn("start", F.col("at") - F.col("offset")).where("start >= 0 and start + n <= total")
    candidates = at.groupBy("text_key").agg(F.collect_set(F.struct("start", "words")).alias("candidates"))

    def make_verify():
        def each(batch: pa.RecordBatch):
            found = []
            for raw, listed in zip(raw_bytes(batch.column("text")), batch.column("candidates").to_pylist()):
                words = alnum_words(raw)
                for c in listed:
                    window = c["words"].split(b" ")
                    if words[c["start"] : c["start"] + len(window)] == window:
                        found.append((_text_key(raw), c["start"], len(window), c["words"]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=["text_key", "start", "n", "words"])

        return each

    keyed = docs.withColumn("text_key", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    one_text = keyed.select("text_key", "text").join(candidates, "text_key")
    true = scratch.keep(map_batches(one_text.select("text", "candidates"), make_verify, "text_key binary, start int, n int, words binary").distinct(), "true")
    named = true.join(parts.where("item is not null").select("words", "item").distinct(), "words").groupBy("text_key").agg(F.collect_set("item").alias("items"))
    spans = true.groupBy("text_key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    every = keyed.join(spans, "text_key", "left").join(named, "text_key", "left")

    def make():
        def each(batch: pa.RecordBatch):
            columns = (raw_bytes(batch.column("text")), batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            yield _add(batch, [summary(len(alnum_words(raw)), [(s["start"], s["n"]) for s in spans or []], set(items or [])) for raw, spans, items in zip(*columns)])

        return each

    return map_batches(every.select("row", "text", "spans", "items"), make, _schema(docs))


def contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str], broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """row (a struct of the named columns of docs) and n_words, n_hit, n_items, items_sha256, contaminated of each row of docs.

    benchmark(item_id, text) may repeat ids and texts. Null texts have no words on either side; an item with a null id hits
    words but isn't counted or named. Very long texts are read whole. Names of other columns can't clash with the result's;
    empty tables give no rows or no hits. A benchmark of at most broadcast_windows windows is gathered and broadcast.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "text")
    held = benchmark.select("item_id", "text").where("text is not null")
    # a window begins at a word: blanks and signs part words, so half the characters bound their number
    windows = held.agg(F.coalesce(F.sum(F.floor(F.octet_length("text") / 2) + F.lit(1)), F.lit(0)).alias("n")).first()["n"]
    if windows > broadcast_windows >= 0:  # the bound is wide: count the words
        windows = held.agg(F.sum(F.size(F.split(F.regexp_replace("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "), " "))).alias("n")).first()["n"]
    return (_beside_scan if windows <= broadcast_windows else _shuffled)(own, held)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *(n for n, _ in RESULT))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a benchmark window, as they are."""
    return contamination(docs, benchmark, docs.columns).where("not contaminated").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


OP6_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + 9), ' ') as win
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
    from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select rid, i, dw.n, item_id from dw join iw on dw.n = iw.n and dw.win = iw.win),
cov as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from hit)) group by rid),
its as (select rid, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct rid, item_id from hit where item_id is not null) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (rid) left join its using (rid)
"""
