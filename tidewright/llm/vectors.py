"""Product codes of vectors: integer codebooks by part, fitted in rounds of assignment and integer means.

Codebooks are broadcast (entries x dimension integers, a fixed size). Arrow batches compute all distances by norm expansion,
|c|^2 - 2 x.c, as integer matrix products; the first least one wins. Each task adds up its own sums by entry; a grouped shuffle
merges them, and the driver gets one row for each entry and position.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, map_batches, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that one matrix product takes, and bits of one digit of a sum.
BLOCK, DIGIT = 2048, 40


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (array<double>) of the rows whose vector is not null and holds neither null, NaN nor infinities."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    # array_contains gives null where a null might be the value, and such rows go too
    return found.where(~F.array_contains("embedding", float("nan")) & ~F.array_contains("embedding", float("inf")) & ~F.array_contains("embedding", float("-inf")))


def scaled(lists: pa.Array, width: int, wide: bool) -> np.ndarray:
    """(rows, PARTS, width) of floor(SCALE x), shorter vectors filled with zeros; Python integers where wide, else 64 bits."""
    ends = np.asarray(lists.offsets, np.int64)
    sizes, flat = np.diff(ends), np.asarray(lists.values, float)[ends[0] : ends[-1]]
    if wide:
        flat = np.array([math.floor(x) * SCALE + math.floor((x - math.floor(x)) * SCALE) for x in flat.tolist()], object)
    else:
        flat = np.floor(flat * SCALE).astype(np.int64)
    out = np.zeros((len(sizes), PARTS * width), object if wide else np.int64)
    out[np.arange(PARTS * width) < sizes[:, None]] = flat
    return out.reshape(len(sizes), PARTS, width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row and part; of equal ones the first. All in integers."""
    by_part = x.transpose(1, 0, 2)
    score = (books * books).sum(axis=2)[:, None, :] - 2 * np.matmul(by_part, books.transpose(0, 2, 1))
    best = score.argmin(axis=2)
    least = np.take_along_axis(score, best[:, :, None], axis=2)[:, :, 0] + (by_part * by_part).sum(axis=2)
    return best.T, least.T


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer to the base 2^DIGIT; the last digit has the sign. Sums of digits of many rows fit 64 bits."""
    place = 0
    while True:
        if -(1 << DIGIT) < value < 1 << DIGIT:
            yield place, value
            return
        yield place, value & ((1 << DIGIT) - 1)
        value, place = value >> DIGIT, place + 1


def _sums(kept: DataFrame, books, width: int, wide: bool, entries: int) -> dict[tuple[int, int, int], int]:
    """Sums by (part, entry, position); position -1 has the count. Each task gives its own sums once, then they are grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = books.value
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = scaled(batch.column(0).slice(at, BLOCK), width, wide)
                best, _ = nearest(x, held)
                for p in range(PARTS):
                    count[p] += np.bincount(best[:, p], minlength=entries)
                    own = np.zeros((entries, width), x.dtype)
                    np.add.at(own, best[:, p], x[:, p])
                    total[p] += own
        rows = [(p, e, -1, 0, int(count[p, e])) for p in range(PARTS) for e in range(entries) if count[p, e]]
        rows += [(p, e, i, d, v) for p, e, _, _, _ in list(rows) for i in range(width) for d, v in _digits(int(total[p, e, i]))]
        names = ["part", "entry", "position", "digit", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 4 else pa.int32()) for k in range(5)], names=names)

    each = kept.select("embedding").mapInArrow(run, "part int, entry int, position int, digit int, value long")
    found: dict[tuple[int, int, int], int] = {}
    for r in each.groupBy("part", "entry", "position", "digit").agg(F.sum("value").alias("value")).collect():  # a codebook's size
        key = r["part"], r["entry"], r["position"]
        found[key] = found.get(key, 0) + (r["value"] << (DIGIT * r["digit"]))
    return found


def fit(kept: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[np.ndarray, bool]:
    """(PARTS, entries, width) codebooks of usable() rows, and whether integers need more than 64 bits."""
    size, most = kept.agg(F.max(F.size("embedding")), F.max(F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding"))))).first()
    width = max(1, -(-(size or 0) // PARTS))
    wide = 4 * PARTS * width * ((most or 0.0) * SCALE + 1) ** 2 >= 2.0**62
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    books = scaled(first.column(0).combine_chunks().cast(pa.list_(pa.float64())), width, wide).transpose(1, 0, 2)
    context = kept.sparkSession.sparkContext
    for _ in range(rounds if books.shape[1] else 0):
        sums = _sums(kept, context.broadcast(np.ascontiguousarray(books)), width, wide, books.shape[1])
        books = books.copy()
        for p in range(PARTS):
            for e in range(books.shape[1]):
                if n := sums.get((p, e, -1)):
                    books[p, e] = [sums[p, e, i] // n for i in range(width)]
    return np.ascontiguousarray(books), wide


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every usable row of vectors(vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds null, NaN or infinities are dropped; an empty vector counts as zeros. A vector's parts are as
    wide as the longest vector needs; shorter ones are filled with zeros. The codebooks start as the `entries` smallest
    vec_ids, of equal ones the smaller vectors, null ids last; with fewer rows they have fewer entries. Components of any
    size are exact (Python integers beyond 64 bits); an error beyond 64 bits is null. Repeated rows count as often as they
    occur; an empty table gives no rows and no entries; extra columns aren't read.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    kept = usable(vectors)
    books, wide = fit(kept, rounds, entries)
    sent, width = vectors.sparkSession.sparkContext.broadcast(books), books.shape[2]

    def make():
        def each(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                best, least = nearest(scaled(part.column("embedding"), width, wide), sent.value)
                text, errors = best.astype(np.uint8).tobytes().hex(), least.sum(axis=1).tolist()
                codes = pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string())
                error = pa.array([x if x < 1 << 63 else None for x in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), codes, error], names=["vec_id", "label", "code", "error"])

        return each

    coded = map_batches(kept, make, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long")
    return scratch.keep(coded, "coded"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: error summed over the rows of equal label, nulls together; null where it passes 64 bits. The sums
    are a written table, so that the rows of a frequent label can be split where it isn't small enough to be broadcast."""
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))).alias("of")
    sums = Scratch(coded.sparkSession, "label-errors").keep(coded.groupBy(key).agg(F.try_sum("error").alias("label_error")), "sums")
    return coded.select("*", key).join(sums, "of").drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one assignment to the entries of book{k} and the means that make book{k + 1}."""
    return f"""
a{k} as (select rid, part, arg_min(entry, (d, entry)) as entry, min(d) as d from
    (select rid, x.part, entry, sum((x - c) * (x - c)) as d from x join book{k} using (part, pos) group by rid, x.part, entry) group by rid, part),
m{k} as (select part, entry, pos, sum(x) as s, count(*) as n from x join a{k} using (rid, part) group by part, entry, pos),
book{k + 1} as (select b.part, b.entry, b.pos, case when n is null then c else (s - ((s % n + n) % n)) // n end as c from book{k} b left join m{k} using (part, entry, pos)),"""


OP13_SQL = f"""
with kept as (select row_number() over (order by vec_id) as rid, vec_id, label, embedding, len(embedding) // {PARTS} as width from embeddings
    where embedding is not null and len([v for v in embedding if v is null or not isfinite(v)]) = 0),
flat as (select rid, width, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from kept),
x as (select rid, i // width as part, i % width as pos, floor({SCALE} * v::double)::bigint as x from flat),
book0 as (select part, rid - 1 as entry, pos, x as c from x where rid <= {ENTRIES}),
{_round(0)}{_round(1)}{_round(2)}
codes as (select rid, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(d)::bigint as error from a2 group by rid),
sha as (select sha256(string_agg(c::bigint::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join codes using (rid), sha
"""
