"""Removal of repeated word windows with a log-structured fingerprint index.

Every window of 35 words is represented by its minimizer, the least hash among its 5-word grams (the leftmost of equal
ones): equal windows have equal minimizers at equal places, and neighbouring windows share one, so the index holds about
one hash for sixteen words. The index is a folder of immutable runs, each bucketed and sorted by hash and pre-aggregated, so
that a hot hash is one row. A new batch is written as a run and merge-joined with every older run bucket by bucket, without
an exchange (hashes found there or twice in the batch are repeated); two runs of one level are compacted into one of the next.
The folder's manifest names the runs, so a later session opens the index and takes in the next batch.

Work is done once for each different text: rows of one text are counted first, and all windows of a text with copies repeat.
A repeated hash is verified on 128 bits of hashes of the words. A minimizer's context is all words of the windows it stands
for. Equal contexts (a 64-bit hash of the context beside the minimizer's 64-bit hash) repeat as a whole. Where one minimizer
has several contexts, the edges of copies, its single windows are compared by a 128-bit hash of their words. Comparing the
words themselves would shuffle each word about thirty times.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import SALTS, Scratch, map_batches, raw_bytes, read_table, slices

WINDOW, GRAM, BATCHES = 35, 5, 3
SPAN = WINDOW - GRAM + 1
#: Words handled at once; longer texts are cut into pieces that overlap by a window.
PIECE = 1 << 22
PLACE = np.uint64((1 << 23) - 1)
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(GRAM)]


def gram_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the 5-word grams."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(own) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k, f in enumerate(FACTORS):
        out += own[k : k + n] * f
        out ^= out >> np.uint64(31)
    return out * FACTORS[0]


def minimizer_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(first window, last window, hash as a signed long) of each minimizer of the text, in order. Windows are numbered by their
    first word; every window is in one run."""
    runs: list[tuple[int, int, int]] = []
    for at in range(0, max(0, len(words) - WINDOW + 1), PIECE):
        g = gram_hashes(words[at : at + PIECE + WINDOW - 1])
        keyed = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
        rows = -(-len(keyed) // SPAN)
        padded = np.full(rows * SPAN, ~np.uint64(0))
        padded[: len(keyed)] = keyed
        padded = padded.reshape(rows, SPAN)
        upto = np.minimum.accumulate(padded, axis=1).ravel()
        since = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(keyed) - SPAN + 1
        place = (np.minimum(since[:n], upto[SPAN - 1 : SPAN - 1 + n]) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        runs += zip((first + at).tolist(), (last + at).tolist(), g[place[first]].view(np.int64).tolist())
    return runs


class Text:
    """The words of a text and their places in the words joined by blanks."""

    def __init__(self, raw: bytes) -> None:
        self.words = raw.split()
        self.norm = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if self.words else self.ends

    def cut(self, first: int, last: int) -> bytes:
        """The words first..last."""
        return self.norm[self.starts[first] : self.ends[last]]

    def result(self, covered: np.ndarray) -> tuple[int, int, str]:
        """Numbers of words and of removed words, and the hash of the kept words joined by blanks."""
        kept = self.norm if not covered.any() else b" ".join(w for w, c in zip(self.words, covered.tolist()) if not c)
        return len(self.words), int(covered.sum()), hashlib.sha256(kept).hexdigest()


def _cover(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    return np.cumsum(edges)[:n] > 0


MARKS = "array<struct<a: int, b: int, h: long, ctx: long>>"


def _fingerprints():
    def each(batch: pa.RecordBatch):
        for part in slices(batch, "text", 1024, 8 << 20):
            texts = [Text(raw) for raw in raw_bytes(part.column("text"))]
            runs = [minimizer_runs(t.words) for t in texts]
            sizes = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            rows = [(a, b, h, xxhash.xxh3_64_intdigest(t.cut(a, b + WINDOW - 1)) - (1 << 63)) for t, r in zip(texts, runs) for a, b, h in r]
            fields = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            marks = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(fields, names=["a", "b", "h", "ctx"]))
            whole = [hashlib.sha256(t.norm).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "rid", "who", "t1", "t2")), pa.array([len(t.words) for t in texts], pa.int64()), pa.array(whole, pa.string()), marks],
                names=["doc_id", "rid", "who", "t1", "t2", "n_words", "whole", "marks"],
            )

    return each


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within it, scans of runs with one file a bucket are known to be sorted, so a merge join needn't sort them again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class FingerprintIndex:
    """Immutable runs (h, n) of levels 0, 1, ..., bucketed and sorted by hash, in one folder that can be opened again.

    commit() writes a manifest (level, run) under the next number and removes the runs that were compacted; what was broken
    off before it leaves the index as it was. The number of buckets is set when the folder is made.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.version = max((v for v in self._versions() if self._there(f"manifest-{v:06d}/_SUCCESS")), default=0)
        self.buckets, self.runs, self.compacted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), [], []
        if self.version:
            rows = spark.read.schema("position int, level int, run string, buckets int").json(f"{self.root}/manifest-{self.version:06d}").orderBy("position").collect()
            self.buckets, self.runs = rows[0]["buckets"], [(r["level"], r["run"]) for r in rows]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _there(self, name: str) -> bool:
        return self.files.exists(self._path(name))

    def _versions(self) -> list[int]:
        if not self._there(""):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self._path(""))]
        return [int(n.split("-")[1]) for n in names if n.startswith("manifest-")]

    def _run(self, name: str) -> DataFrame:
        """The run as a bucketed table; the catalog's entry is needed only while the plan is made."""
        table = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {table} (h bigint, n bigint) using parquet clustered by (h) sorted by (h) into {self.buckets} buckets location '{self.root}/{name}'")
        run = self.spark.table(table)
        self.spark.sql(f"drop table {table}")
        return run

    def _write(self, rows: DataFrame) -> str:
        """Counts by hash as a new run. The rows lie in the run's buckets already where they come from other runs."""
        name, table = f"run-{uuid.uuid4().hex}", f"fingerprints_{uuid.uuid4().hex}"
        counted = rows.groupBy("h").agg(F.sum("n").alias("n"))
        counted.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(table)
        self.spark.sql(f"drop table {table}")
        return name

    def ingest(self, hashes: DataFrame, scratch: Scratch) -> DataFrame:
        """Adds a batch of hashes(h) as a run; the hashes of it that are in an older run, or twice in the batch, as a table."""
        new = self._write(hashes.withColumn("n", F.lit(1).cast("long")))
        with _sorted_buckets(self.spark):
            run = self._run(new)
            found = run.where("n > 1").select("h")
            for _, old in self.runs:
                found = found.unionByName(run.select("h").join(self._run(old).select("h").hint("merge"), "h", "left_semi"))
            found = scratch.keep(found.distinct(), f"found-{new}")
            self.runs.append((0, new))
            while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
                (level, one), (_, two) = self.runs.pop(), self.runs.pop()
                self.runs.append((level + 1, self._write(self._run(one).unionByName(self._run(two)))))
                self.compacted += [one, two]
        return found

    def commit(self) -> None:
        self.version += 1
        rows = [(k, level, run, self.buckets) for k, (level, run) in enumerate(self.runs)]
        self.spark.createDataFrame(rows, "position int, level int, run string, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest-{self.version:06d}")
        for name in self.compacted:
            self.files.delete(self._path(name), True)
        self.compacted = []

    def past(self, kind: str, schema: str) -> DataFrame | None:
        """The rows of one kind (marks or texts) that earlier batches left for verification; None before the first."""
        names = [f.getPath().getName() for f in self.files.listStatus(self._path(""))] if self._there("") else []
        paths = [f"{self.root}/{n}" for n in sorted(names) if n.startswith(f"{kind}-") and int(n.split("-")[1]) <= self.version]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None


def _first_pass():
    """Covers whole contexts; hashes the windows at the edges; a text whose edges are open goes on with its words. Of a text
    with copies only the windows at the edges are asked for."""

    def each(batch: pa.RecordBatch):
        for piece in slices(batch, "text", 1024, 8 << 20):
            rows = []
            for raw, parts, copied in zip(raw_bytes(piece.column("text")), piece.column("parts").to_pylist(), piece.column("copied").to_pylist()):
                text = Text(raw)
                spans = [(p["a"], p["b"] + WINDOW) for p in parts if p["whole"]]
                open_ = not copied and any(not p["whole"] for p in parts)
                starts = sorted({s for p in parts if p["emit"] for s in range(p["a"], p["b"] + 1)})
                digests = [xxhash.xxh3_128_intdigest(text.cut(s, s + WINDOW - 1)) for s in starts]
                done = (None, None) if open_ or copied else text.result(_cover(len(text.words), spans))[1:]
                rows.append((*done, open_, text.norm if open_ else None, [x for s in spans for x in s] if open_ else None,
                             starts, [(d >> 64) - (1 << 63) for d in digests], [(d & ((1 << 64) - 1)) - (1 << 63) for d in digests]))
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["n_removed", "kept", "open", "norm", "spans", "s", "w1", "w2"]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("t1", "t2", "copied")), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["t1", "t2", "copied", *names])

    return each


def _last_pass():
    def each(batch: pa.RecordBatch):
        rows = []
        for raw, spans, hits in zip(batch.column("norm").to_pylist(), batch.column("spans").to_pylist(), batch.column("hits").to_pylist()):
            text = Text(raw)
            every = [*zip(spans[::2], spans[1::2]), *((s, s + WINDOW) for s in hits or [])]
            rows.append(text.result(_cover(len(text.words), every))[1:])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t1", "t2")), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string())))], names=["t1", "t2", "n_removed", "kept"])

    return each


def remove_repeats(docs: DataFrame, batches: int = BATCHES, index_path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs(doc_id, text).

    Each word covered by a window of 35 words whose sequence starts anywhere else too is removed, every occurrence alike.
    Rows of one text, whatever their ids, repeat each other and lose all windows. Null, empty and short texts have no windows
    and lose nothing; very long texts are cut into pieces that overlap by a window. Extra columns aren't read; an empty table
    gives no rows. The texts are dealt into `batches` parts by hash and taken into the index one after another.

    With index_path the index in that folder is opened (made, where there is none) and docs are its next batch: windows that
    also start in an earlier batch count as repeated. Earlier batches' results stay as they were given. The folder then also
    keeps each batch's different texts, which verification reads where a hash is met again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    index = FingerprintIndex(spark, index_path or scratch.path("index"))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("who"), F.monotonically_increasing_id().alias("rid"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"), F.xxhash64(F.lit("second"), F.coalesce("text", F.lit(""))).alias("t2"),
    )
    seen = scratch.keep(map_batches(own, _fingerprints, f"doc_id long, rid long, who long, t1 long, t2 long, n_words long, whole string, marks {MARKS}"), "seen")
    past_marks = index.past("marks", f"t1 long, t2 long, who long, marks {MARKS}")
    past_texts = index.past("texts", "t1 long, t2 long, who long, text string")
    counted = seen.groupBy("t1", "t2").agg((F.count(F.lit(1)) > 1).alias("copied"), F.min(F.struct("rid", "who")).alias("lead"))
    if past_marks is not None:
        known = past_marks.select("t1", "t2", F.lit(True).alias("past"))
        counted = counted.join(known, ["t1", "t2"], "left").select("t1", "t2", (F.col("copied") | F.col("past").isNotNull()).alias("copied"), F.when(F.col("past").isNull(), F.col("lead")).alias("lead"))
    texts = scratch.keep(counted.select("t1", "t2", "copied", F.col("lead.rid").alias("lead"), F.col("lead.who").alias("who")), "texts")
    # one row of a text speaks for all of its copies; those of an earlier batch have spoken already (lead is null)
    copies = texts.where("copied").select("t1", "t2", "lead", "copied")
    leads = seen.join(copies, ["t1", "t2"], "left").where("copied is null or rid = lead").select("t1", "t2", "who", "marks")
    marks = leads.select("t1", "t2", F.explode("marks").alias("m")).select("t1", "t2", "m.a", "m.b", "m.h", "m.ctx")
    found = [index.ingest(marks.where(F.pmod("t2", F.lit(batches)) == k).select("h"), scratch) for k in range(batches)]
    repeated = found[0]
    for more in found[1:]:
        repeated = repeated.unionByName(more)
    every, keys = marks, texts.select("t1", "t2", "copied", "who")
    if past_marks is not None:
        every = marks.unionByName(past_marks.select("t1", "t2", F.explode("marks").alias("m")).select("t1", "t2", "m.a", "m.b", "m.h", "m.ctx"))
        keys = texts.where("lead is not null").select("t1", "t2", "copied", "who").unionByName(past_marks.select("t1", "t2", F.lit(True).alias("copied"), "who"))
    # written first, so that both sides of the join come straight from a shuffle and a hot hash can be split
    met = scratch.keep(every.join(scratch.keep(repeated.distinct(), "repeated"), "h"), "met")
    contexts = scratch.keep(met.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min("t1").alias("rep")), "contexts")
    # a context met once stands beside others of its hash; only for the others it must be asked, and a hot hash is dealt
    several = contexts.groupBy("h").agg(F.min("ctx").alias("low"), F.max("ctx").alias("high")).where("low <> high").select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("several"))
    asked = contexts.where("n > 1").withColumn("salt", F.pmod("ctx", F.lit(SALTS)).cast("int")).join(several, ["h", "salt"], "left").select("h", "ctx", "rep", F.coalesce("several", F.lit(False)).alias("several"))
    verified = scratch.keep(asked.select("h", "ctx", "rep", "several"), "verified")
    whole = F.col("rep").isNotNull()
    emit = ~whole | (F.col("several") & (F.col("t1") == F.col("rep")))
    parts = met.join(verified, ["h", "ctx"], "left").select("t1", "t2", F.struct("a", "b", whole.alias("whole"), emit.alias("emit")).alias("part"))
    of_text = parts.groupBy("t1", "t2").agg(F.collect_set("part").alias("parts"))
    touched = scratch.keep(of_text.join(keys, ["t1", "t2"]).where("not copied or exists(parts, p -> p.emit)").select("t1", "t2", "who", "copied", "parts"), "touched")
    bodies = own.select("t1", "t2", "who", "text")
    if past_texts is not None:
        bodies = bodies.unionByName(past_texts)
    first = scratch.keep(
        map_batches(bodies.join(touched, ["t1", "t2", "who"]).select("t1", "t2", "copied", "text", "parts"), _first_pass,
                    "t1 long, t2 long, copied boolean, n_removed long, kept string, open boolean, norm binary, spans array<int>, s array<int>, w1 array<long>, w2 array<long>"),
        "first",
    )
    windows = first.select("t1", "t2", "open", F.explode(F.arrays_zip("s", "w1", "w2")).alias("w")).select("t1", "t2", "open", "w.s", "w.w1", "w.w2")
    twice = scratch.keep(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "twice")
    hits = windows.where("open").join(twice, ["w1", "w2"]).groupBy("t1", "t2").agg(F.collect_set("s").alias("hits"))
    rest = first.where("open").select("t1", "t2", "norm", "spans").join(hits, ["t1", "t2"], "left")
    done = first.where("not open and not copied").select("t1", "t2", "n_removed", "kept").unionByName(map_batches(rest, _last_pass, "t1 long, t2 long, n_removed long, kept string"))
    if index_path:
        mark_rows = scratch.keep(leads.where("size(marks) > 0"), "new-marks")
        mark_rows.write.option("compression", "zstd").mode("overwrite").parquet(f"{index.root}/marks-{index.version + 1:06d}")
        held = own.join(mark_rows.select("t1", "t2", "who"), ["t1", "t2", "who"], "left_semi").dropDuplicates(["t1", "t2"]).select("t1", "t2", "who", "text")
        held.write.option("compression", "zstd").mode("overwrite").parquet(f"{index.root}/texts-{index.version + 1:06d}")
    index.commit()
    results = scratch.keep(texts.select("t1", "t2", "copied").join(done, ["t1", "t2"], "left"), "results")
    gone = F.when(F.col("copied"), F.when(F.col("n_words") >= WINDOW, F.col("n_words")).otherwise(F.lit(0))).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("copied") & (F.col("n_words") >= WINDOW), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole"))
    return seen.select("doc_id", "t1", "t2", "n_words", "whole").join(results, ["t1", "t2"]).select("doc_id", "n_words", gone.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h from (select rid, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
r as (select rid, i from (select rid, i, count(*) over (partition by h) as c from g) where c > 1),
cov as (select distinct rid, p from (select rid, unnest(range(i, i + 35)) as p from r)),
x as (select rid, unnest(w) as word, generate_subscripts(w, 1) as p from d),
k as (select x.rid, count(*) as n_removed from cov join x on x.rid = cov.rid and x.p = cov.p group by x.rid),
s as (select x.rid, string_agg(word, ' ' order by x.p) as kept from x left join cov on x.rid = cov.rid and x.p = cov.p where cov.p is null group by x.rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (rid) left join s using (rid)
"""
