"""Erasure curves: how far a score falls without the words that an explanation names, and how far it holds with them alone."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tidewright.session import in_slices, share_package

FRACTIONS = (0.1, 0.2, 0.3, 0.5)


#: Draws that are hashed together.
AT_ONCE = 1 << 13
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _md5_heads(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of messages of one padded block each: blocks is (messages, 64) bytes."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f, turn = f + a + _SINES[i] + words[g], _TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return (a + np.uint32(0x67452301)).byteswap()


def _blocks(base: bytes, ats: np.ndarray) -> np.ndarray:
    """The padded blocks of base and each of the ascending places, in digits."""
    held = np.zeros((len(ats), 64), np.uint8)
    held[:, : len(base)] = np.frombuffer(base, np.uint8)
    for digits in range(1, len(str(int(ats[-1]))) + 1):
        low, high = np.searchsorted(ats, [10 ** (digits - 1) if digits > 1 else 0, 10**digits])
        for j in range(digits):
            held[low:high, len(base) + j] = 48 + ats[low:high] // 10 ** (digits - 1 - j) % 10
        held[low:high, len(base) + digits] = 0x80
        held[low:high, 56:58] = divmod((len(base) + digits) * 8, 256)[::-1]
    return held


def _draws(names: list[str], places: list[np.ndarray]) -> list[np.ndarray]:
    """For each name and its ascending places, the first eight hex digits of the MD5 of name:place, as numbers. Short messages of many
    texts are hashed together."""
    found, waiting, many = [np.zeros(0, np.uint32) for _ in names], [], 0

    def hash_waiting() -> None:
        heads = _md5_heads(np.concatenate([x for _, x in waiting]))
        for (r, x), end in zip(waiting, np.cumsum([len(x) for _, x in waiting])):
            found[r] = np.append(found[r], heads[end - len(x) : end])
        waiting.clear()

    for r, (name, ats) in enumerate(zip(names, places)):
        base, ats = name.encode() + b":", ats.astype(np.int64)
        if len(ats) and (len(base) > 44 or ats[0] < 0):  # more than a block
            found[r] = np.frombuffer(b"".join([hashlib.md5(base + b"%d" % i).digest() for i in ats.tolist()]), ">u4")[::4].astype(np.uint32)
            continue
        for at in range(0, len(ats), AT_ONCE):
            waiting.append((r, _blocks(base, ats[at : at + AT_ONCE])))
            many += len(waiting[-1][1])
            if many >= AT_ONCE:
                hash_waiting()
                many = 0
    if waiting:
        hash_waiting()
    return found


def _sums(draws: np.ndarray, n: int, ats: np.ndarray, at: np.ndarray, w: np.ndarray, fractions: tuple[float, ...]) -> tuple[float, list[int], list[float], list[float]]:
    """All weights' sum; k for each fraction; the sums of the k greatest weights, and of those at the k smallest draws (of equal ones the
    first place). The places are ascending, with a draw each."""
    k = [max(1, round(n * f)) for f in fractions]
    if not len(w):
        return 0.0, k, [0.0] * len(k), [0.0] * len(k)
    order = np.argsort(at, kind="stable")
    at, every = at[order], np.zeros(n)
    every[np.searchsorted(ats, at) + np.arange(len(at)) - np.searchsorted(at, at)] = w[order]  # a place may occur again
    top, drawn = np.cumsum(np.sort(every)[::-1]), np.cumsum(every[np.argsort(draws, kind="stable")])
    return float(w.sum()), k, [float(top[min(i, n) - 1]) for i in k], [float(drawn[min(i, n) - 1]) for i in k]


def erasure_curves(words: DataFrame, key: list[str], at: str, weight: str, identity: list[Column], fractions: tuple[float, ...] = FRACTIONS, seed: int = 42) -> DataFrame:
    """curves_of_texts() of words(key, at, weight): one row a word, with its place and what it adds (null: nothing). identity is made of key."""
    w = F.col(weight).cast("double")
    texts = words.groupBy(*key).agg(F.collect_list(F.col(at).cast("int")).alias("ats"), F.collect_list(F.when(w != 0, F.struct(F.col(at).cast("int").alias("at"), w.alias("w")))).alias("points"))
    return curves_of_texts(texts, key, "ats", "points", identity, fractions, seed)


def curves_of_texts(texts: DataFrame, key: list[str], ats: str, points: str, identity: list[Column], fractions: tuple[float, ...] = FRACTIONS, seed: int = 42) -> DataFrame:
    """(key, baseline, comprehensiveness, sufficiency, random_comprehensiveness, random_sufficiency, words) of each of texts(key, ats, points),
    a row each: the places of its words, as array<int>, and the (at, w) of those that add something to the text's log-odds, which is also
    what the explanation gives them.

    For each fraction the k = max(1, round(fraction n)) words of the greatest weight (of equal ones the first) are taken out, and kept
    alone, as are k words drawn by hashes of seed, identity and place; k of n words or more measures nothing and is left out. The
    curves' means are the areas over them. Texts of one word, or without any point, give no row. Words never become rows of a shuffle: a
    text is ranked where its row lies, and one in which no word weighs anything needs no draws.
    """
    share_package(texts.sparkSession)
    own = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n = batch.column(own + 1).to_numpy()
            lists = [batch.column(own + j) for j in (2, 3, 4)]
            ends, held = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in lists], [x.flatten().to_numpy() for x in lists]
            ats, at, w = ([x[e[r] : e[r + 1]] for r in range(batch.num_rows)] for x, e in zip(held, ends))
            ats = [np.sort(x) for x in ats]
            found = [_sums(*row, fractions) for row in zip(_draws(batch.column(own).to_pylist(), ats), n.tolist(), ats, at, w)]
            parts = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], batch.column(own + 1), *parts], names=[*key, "n", "s", "k", "t", "r"])

    held = texts.select(
        *key, F.concat_ws(":", F.lit(seed).cast("string"), *(c.cast("string") for c in identity)).alias("__id"), F.size(ats).cast("long").alias("n"),
        F.when(F.size(points) > 0, F.col(ats)).otherwise(F.array().cast("array<int>")).alias("__ats"), F.col(f"{points}.at").alias("__at"), F.col(f"{points}.w").alias("__w"),
    )
    fields = [StructField("n", LongType()), StructField("s", DoubleType()), StructField("k", ArrayType(IntegerType())), StructField("t", ArrayType(DoubleType())), StructField("r", ArrayType(DoubleType()))]
    each = held.where("n > 1").mapInArrow(run, StructType([*(texts.schema[c] for c in key), *fields]))
    each = each.select(*key, "n", "s", *(F.col(c)[i].alias(f"{c}{i}") for c in "ktr" for i in range(len(fractions))))
    odds = lambda s: 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), s))))
    base = odds(F.col("s"))
    point = lambda s, i: F.when(F.col(f"k{i}") < F.col("n"), base - odds(s))

    def mean(of) -> Column:
        found = F.array_compact(F.array(*(point(of(i), i) for i in range(len(fractions)))))
        return F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(found), F.lit(0))

    curves = each.select(
        *key, base.alias("baseline"), mean(lambda i: F.col("s") - F.col(f"t{i}")).alias("comprehensiveness"), mean(lambda i: F.col(f"t{i}")).alias("sufficiency"),
        mean(lambda i: F.col("s") - F.col(f"r{i}")).alias("random_comprehensiveness"), mean(lambda i: F.col(f"r{i}")).alias("random_sufficiency"), F.col("n").alias("words"),
    )
    return curves.where(F.col("comprehensiveness").isNotNull())


def margins(curves: DataFrame, by: str) -> DataFrame:
    """(by, n, comprehensiveness, sufficiency, and their margins over the random words): both margins are better when greater."""
    return curves.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("comprehensiveness").alias("comprehensiveness"), F.avg("sufficiency").alias("sufficiency"),
        F.avg(F.col("comprehensiveness") - F.col("random_comprehensiveness")).alias("comprehensiveness_margin"), F.avg(F.col("random_sufficiency") - F.col("sufficiency")).alias("sufficiency_margin"),
    )
