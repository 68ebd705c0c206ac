"""Phrases of two to five words whose words stand together more often than chance, by language.

All 1..longest-grams become DataFrame rows and are aggregated by (language, phrase). A phrase occurs no more often than any of its
parts, so before a level is exploded its grams are met with a Bloom filter of the parts that reach the count: words before
pairs, pairs before longer grams. The filter has a bounded size and no false negatives; what it lets through in vain the
aggregation drops, so results are exact however full it gets.

Texts are read as bytes, many at a time: words are found by tables of byte classes, grams are hashed to 128 bits by numpy and
those of one slice of texts are counted before they become rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, map_batches, read_table, slices

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text that are worked on at once, and bits of the filter at most (8 MB).
SLICE, MOST_BITS = 1 << 20, 1 << 26
SALTS = 16
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.array([BREAK if chr(c) in ".,;:!?\n\x0b\x0c\r" else BLANK if chr(c) in " \t" else WORD for c in range(256)], np.uint8)
WORD_END = re.compile(rb"[.,;:!?\x0a-\x0d\x20\x09]")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SCHEMA = "lang string, phrase string, c long"


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < size."""
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (base, inverse))


class Words:
    """The words of some texts, one after the other and blank-separated, with what their grams need.

    texts: (bytes, how many of them are the text's own, language); words that begin beyond are only read as followers.
    """

    def __init__(self, texts: list[tuple[bytes, int, str]]) -> None:
        raw = LOWER[np.frombuffer(b"\n".join(t for t, _, _ in texts), np.uint8)]
        kind = KIND[raw]
        of_word = kind == WORD
        edge = np.diff(np.concatenate(([False], of_word, [False])).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = ends - starts
        self.piece = np.cumsum(kind == BREAK, dtype=np.int64)[starts] if len(starts) else starts
        first = np.cumsum([0, *(len(t) + 1 for t, _, _ in texts)])
        text = np.searchsorted(first, starts, side="right") - 1
        self.own = None
        if any(own < len(t) for t, own, _ in texts):
            self.own = starts < (first[:-1] + [own for _, own, _ in texts])[text]
        self.langs = sorted({lang for _, _, lang in texts})
        place = {lang: k for k, lang in enumerate(self.langs)}
        self.lang = np.array([place[lang] for _, _, lang in texts], np.int32)[text]
        # words blank-separated, so that every gram is a slice
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64) if len(starts) else starts
        self.end = self.begin + sizes
        self.bytes = np.full(int(self.end[-1]) + 1 if len(starts) else 0, 32, np.uint8)
        self.bytes[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = raw[of_word]
        size = -(-max(1, len(self.bytes)) // SLICE) * SLICE
        self.hashes = []
        for base in BASES:
            power, back = _powers(base, size)
            upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[: len(self.bytes)], dtype=np.uint64)))
            seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
            own = (upto[self.end] - upto[self.begin]) * back[self.begin] if len(starts) else np.zeros(0, np.uint64)
            self.hashes.append(_mixed(_mixed(own + sizes.astype(np.uint64)) ^ (seeds[self.lang] if len(starts) else own)))

    def __len__(self) -> int:
        return len(self.begin)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the k words from each word on, and whether they stand in one piece and begin in the text's own part."""
        n = max(0, len(self) - k + 1)
        out = []
        for h, base in zip(self.hashes, BASES):
            g = h[:n]
            for i in range(1, k):
                g = _mixed(g * np.uint64(base) + h[i : n + i])
            out.append(g)
        whole = self.piece[:n] == self.piece[k - 1 : n + k - 1]
        return out[0], out[1], whole if self.own is None else whole & self.own[:n]

    def counted(self, k: int, where: np.ndarray, g: np.ndarray, g2: np.ndarray) -> pa.RecordBatch:
        """Rows (lang, phrase, c) of the k-grams that begin at the words named by `where`, equal ones counted."""
        at = np.flatnonzero(where)
        order = at[np.argsort(g[at], kind="stable")]
        a, b = g[order], g2[order]
        if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):  # 64 bits are equal by chance
            order = at[np.lexsort((g2[at], g[at]))]
            a, b = g[order], g2[order]
        head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(order) else order
        counts = np.diff(np.concatenate((head, [len(order)])))
        one = order[head] if len(order) else order
        begin, size = self.begin[one], self.end[one + k - 1] - self.begin[one]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.arange(int(ends[-1])) + np.repeat(begin - ends[:-1], size)]
        phrase = pa.Array.from_buffers(pa.string(), len(one), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[one]))
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(counts, pa.int64())], names=["lang", "phrase", "c"])


def parts_of(text: bytes, most: int = SLICE, longest: int = LONGEST) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about `most` bytes that begin and end between words, each with the words that follow it and how many bytes
    are its own."""
    at = 0
    follow = re.compile(rb"(?:[\x20\x09]*[^.,;:!?\x0a-\x0d\x20\x09]+){0,%d}" % (longest - 1))
    while len(text) - at > most:
        found = WORD_END.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at : follow.match(text, end).end()], end - at
        at = end
    yield text[at:], len(text) - at


def _read(batch: pa.RecordBatch) -> Iterator[Words]:
    for part in slices(batch, "text", 8192, SLICE):
        texts = zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("lang").to_pylist())
        every = [(piece, own, lang) for text, lang in texts for piece, own in (parts_of(text) if len(text) > SLICE else [(text, len(text))])]
        while every:
            size, n = 0, 0
            while n < len(every) and (not n or size + len(every[n][0]) <= SLICE):
                size += len(every[n][0])
                n += 1
            yield Words(every[:n])
            every = every[n:]


def _positions(g: np.ndarray, g2: np.ndarray, bits: int) -> list[np.ndarray]:
    """The four bits of a filter of `bits` bits (a power of two) that belong to a gram."""
    return [(g + np.uint64(i) * (g2 | np.uint64(1))) & np.uint64(bits - 1) for i in range(4)]


def filter_of(frequent: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of the phrases of frequent(lang, phrase): built on the executors, gathered by word. Sixteen
    bits a phrase, at most `most_bits`: the driver gets most_bits / 64 rows and tasks most_bits / 8 bytes, whatever the input."""
    bits = 1 << min(most_bits.bit_length() - 1, max(12, (frequent.count() * 16).bit_length()))

    def make():
        def each(batch: pa.RecordBatch):
            # a phrase is one piece of single blanks: its own gram is the one from its first word to its last
            words = Words([(t.encode("utf-8", "surrogatepass"), len(t.encode("utf-8", "surrogatepass")), lang) for t, lang in zip(batch.column("phrase").to_pylist(), batch.column("lang").to_pylist())])
            starts = np.flatnonzero(np.concatenate(([True], words.piece[1:] != words.piece[:-1]))) if len(words) else words.begin
            sizes = np.diff(np.concatenate((starts, [len(words)])))
            found = []
            for k in np.unique(sizes):
                g, g2, _ = words.grams(int(k))
                found += [p for p in _positions(g[starts[sizes == k]], g2[starts[sizes == k]], bits)]
            at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            held = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["word", "bits"])

        return each

    found = map_batches(frequent.select("lang", "phrase"), make, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(found.column("word"), np.int64)] = np.asarray(found.column("bits"), np.int64).view(np.uint64)
    return out


def _held(book: np.ndarray, g: np.ndarray, g2: np.ndarray) -> np.ndarray:
    out = np.ones(len(g), bool)
    for p in _positions(g, g2, 64 * len(book)):
        out &= (book[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def explode(docs: DataFrame, sizes: range, book: np.ndarray | None = None, book_size: int = 0) -> DataFrame:
    """(lang, phrase, c) rows of the grams of `sizes` words, counted within slices of texts. With a filter of book_size-grams, only
    those whose parts of that size are all in it."""
    sent = None if book is None else docs.sparkSession.sparkContext.broadcast(book)

    def make():
        def each(batch: pa.RecordBatch):
            for words in _read(batch):
                if sent is not None:
                    g, g2, _ = words.grams(book_size)
                    held = _held(sent.value, g, g2)
                for k in sizes:
                    g, g2, where = words.grams(k)
                    if sent is not None:
                        for i in range(k - book_size + 1):
                            where = where & held[i : len(where) + i]
                    yield words.counted(k, where, g, g2)

        return each

    return map_batches(docs, make, SCHEMA)


def _part(first: Column | int, size: Column | int) -> Column:
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of docs(text, lang).

    Null texts have no words; a null lang is `und`, as is that word itself. Pieces end at . , ; : ! ? and at line ends, words at
    blanks and tabs. A phrase of two to `longest` words that occurs `least` times or more is scored by its lowest-scoring cut,
    of equal ones the first; one whose every occurrence lies in the same longer candidate goes. Equal scores and counts are
    ordered by the phrase's bytes. Counts are exact (decimals of 38 digits for products). Very long texts are read whole, in parts
    that overlap by a phrase. Repeated rows count as often as they occur; no rows give no rows; extra columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))

    def frequent(sizes: range, book: np.ndarray | None, book_size: int, name: str) -> DataFrame:
        summed = explode(texts, sizes, book, book_size).groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        return scratch.keep(summed.where(F.col("f") >= least), name) if book_size else scratch.keep(summed, name)

    every = frequent(range(1, 2), None, 0, "words")
    total = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = every.where(F.col("f") >= least)
    pairs = frequent(range(2, 3), filter_of(words, most_bits), 1, "pairs")
    longer = frequent(range(3, longest + 1), filter_of(pairs, most_bits), 2, "longer") if longest > 2 else pairs.limit(0)
    phrases = pairs.unionByName(longer)
    counts = scratch.keep(words.unionByName(phrases), "counts")
    k = F.size(F.split("phrase", " "))
    cuts = phrases.withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, k - F.col("k")).alias("right"))
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    found = scratch.keep(cuts.join(side("left", "l"), ["lang", "left"]).drop("left"), "left").join(side("right", "r"), ["lang", "right"]).join(F.broadcast(total) if total.count() <= 10_000 else total, "lang")
    found = found.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = found.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    within = longer.select("lang", F.explode(F.array(_part(1, k - 1), _part(2, k - 1))).alias("phrase"), F.col("f").alias("a"))
    kept = best.join(within, ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # each part of a language gives its first ones
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = "\nunion all ".join(f"select lang, {k} as k, {" || ' ' || ".join(['w1', *(f'w{i}' for i in range(2, k + 1))])} as phrase from g where w{k} is not null" for k in range(1, LONGEST + 1))
    return rf"""
with d as (select row_number() over () as rid, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select rid, lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) as piece, generate_subscripts(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+'), 1) as pid from d),
w as (select rid, lang, pid, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) as w1, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) as i from p),
g as (select lang, w1, {", ".join(f"lead(w1, {k - 1}) over o as w{k}" for k in range(2, LONGEST + 1))} from w window o as (partition by rid, pid order by i)),
f as (select lang, k, phrase, count(*) as f from ({grams}) group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= {LEAST}),
cut as (select *, unnest(range(1, k)) as j from c),
s as (select cut.lang, cut.phrase, cut.k, j, a, l.f as l, r.f as r, n.n, (1000::hugeint * a::hugeint * n.n::hugeint) // (l.f::hugeint * r.f::hugeint) as score from cut
    join f l on l.lang = cut.lang and l.phrase = array_to_string(ws[1:j], ' ') join f r on r.lang = cut.lang and r.phrase = array_to_string(ws[j + 1:], ' ') join n on n.lang = cut.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
gone as (select lang, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:], ' ')]) as phrase, a from c where k >= 3),
kept as (select * from b where not exists (select 1 from gone where gone.lang = b.lang and gone.phrase = b.phrase and 100 * gone.a >= 100 * b.a))
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from
    (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= {TOP}
"""


OP12_SQL = _sql()
