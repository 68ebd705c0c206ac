"""Packing, phrases and vector codes against plain versions, and the SQL of all operators on the small tables."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidewright.llm import packing, phrases, queries, vectors

DOCS = "doc_id long, text string, lang string, ids string, length long, part string, phrase string, f long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_path())


def table(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "x", 7, None, "y", 3) for r in rows], DOCS)


def test_encoder_equals_the_library(library):
    encoder, rng = packing.Encoder(packing.tokenizer_text(packing.default_path())), random.Random(3)
    assert encoder.fast is not None
    signs = [chr(c) for c in [*range(0x24F), *range(0x370, 0x590), *range(0x4E00, 0x4E80), *range(0x1F600, 0x1F640)]] + list(" \t\n\r'st0") * 60
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a<|endoftext|>b", "<|endoftext|>", "it's 12 'S", " " * 1_000_000 + "x", "ab" * 200_000, "ı̇ é"]
    for t in texts:
        assert encoder.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def checked_packing(found, texts, library, size):
    """Every id in one piece, pieces gapless in their sequence; the number of sequences and of padding tokens."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            own = struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]])
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and bytes(r["ids"]) == own
            at += r["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padding = 0
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return len(by_sequence), padding


def test_packing(spark, library):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(["word", "Zug", "x1", "été", "\n"], k=rng.choice([0, 3, 30, 200, 700, 5000]))) for i in range(300)}
    texts |= {1000 + i: "the same text of eight tokens or so" for i in range(200)} | {2000: None, 2001: "", 2002: "a" * 30_000, 2003: "<|endoftext|> x"}
    docs = table(spark, [(d, t, None) for d, t in texts.items()]).repartition(7)
    found = packing.pack(docs).collect()
    n, padding = checked_packing(found, texts, library, 1024)
    tokens = sum(r["length"] for r in found)
    assert padding <= 0.01 * tokens + 1024
    # short sequences, and offsets of ranks by a shuffle
    most, packing.MOST_OFFSETS = packing.MOST_OFFSETS, 0
    try:
        n, padding = checked_packing(packing.pack(docs, size=128).collect(), texts, library, 128)
    finally:
        packing.MOST_OFFSETS = most
    assert padding <= 0.03 * tokens + 128


def test_packing_of_repeated_and_null_ids_and_no_rows(spark):
    docs = table(spark, [(None, "a b", None), (1, "a b", None), (1, "a b", None), (None, None, None)])
    found = packing.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in found) == [(0, 1), (0, 3), (1, 3), (1, 3)]
    whole = packing.sequences(packing.pack(docs)).collect()
    assert [(r["n_tokens"], len(r["ids"])) for r in whole] == [(10, 4096)]
    assert packing.pack(docs.limit(0)).collect() == []


def test_sequences_hold_the_ids_in_order(spark, library):
    docs = table(spark, [(i, f"number {i} " * (i % 400), None) for i in range(500)])
    packed = packing.pack(docs)
    want = defaultdict(list)
    for r in packed.collect():
        want[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    for r in packing.sequences(packed, pad=50256).collect():
        ids = b"".join(b for _, b in sorted(want[r["sequence_id"]]))
        full = len(ids) & (len(ids) - 1) == 0
        assert bytes(r["ids"]) == (ids if full else ids + struct.pack("<I", 50256) * (1024 - len(ids) // 4))


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 1024): rng.randint(1, rng.choice([3, 30, 300])) for _ in range(rng.randint(1, 400))}
    patterns = packing.plan(histogram)
    places, held = packing.Places(patterns), defaultdict(list)
    for n, c in histogram.items():
        for rank in range(c):
            parts = sorted(places.place(n, rank))
            assert [a for a, *_ in parts] == [sum(b for _, b, *_ in parts[:i]) for i in range(len(parts))] and sum(b for _, b, *_ in parts) == n
            for _, b, sequence, offset in parts:
                held[sequence].append((offset, b))
    assert sorted(held) == list(range(places.sequences))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(b for _, b in own[:i]) for i in range(len(own))] and sum(b for _, b in own) <= 1024
    tokens = sum(n * c for n, c in histogram.items())
    assert places.sequences <= tokens / 1024 * 1.02 + 2


def test_plan_of_very_many_pieces_has_few_patterns():
    for histogram in ({100: 10**10}, {1: 10**11}, {i: 10**10 // i for i in range(1, 1025)} | {57: 10**12}, {700: 10**9}, {1023: 10**9, 1: 5}):
        patterns = packing.plan(histogram)
        assert len(patterns) < 3000 and sum(p.count for p in patterns) <= sum(n * c for n, c in histogram.items()) / 1024 * 1.01 + 2


def brute_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = defaultdict(list)
    candidates = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
    by_word = defaultdict(set)
    for lang, p in candidates:
        for w in p:
            by_word[lang, w].add(p)
    for (lang, p), a in candidates.items():
        if any(len(q) > len(p) and candidates[lang, q] >= a and inside(p, q) for q in by_word[lang, p[0]]):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, own in found.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def phrase_rows(seed, count):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "é", "Ü", "w-1", "\x00", "\x1f", "und", "x" * 90, "日本"]
    text = lambda: "".join(rng.choice(words[: rng.randint(1, 13)]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " : "]) for _ in range(rng.choice([0, 1, 5, 60, 300])))
    rows = [(i, text(), rng.choice(["en", "de", "und", None, ""])) for i in range(count)]
    return rows + [(count, None, "en"), (count + 1, "", None)] + rows[:7]


@pytest.mark.parametrize("least,longest,top,bits", [(3, 5, 2000, 1 << 26), (2, 3, 5, 1 << 6), (1, 5, 40, 1 << 12), (4, 2, 10, 1 << 26)])
def test_phrases(spark, monkeypatch, least, longest, top, bits):
    rows = phrase_rows(least, 60)
    monkeypatch.setattr(phrases, "SALTS", 3)
    found = phrases.collocations(table(spark, rows), least, longest, top, bits)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, longest, top)


def test_phrases_of_no_rows_and_of_equal_rows(spark):
    assert phrases.collocations(table(spark, [(1, "a b", "en")]).limit(0)).collect() == []
    found = phrases.collocations(table(spark, [(1, "Same words here", None)] * 120)).collect()
    assert [tuple(r) for r in found] == [("und", 1, "same words here", 120, 120, 120, 360, 3000)]


def test_grams_of_a_text_in_parts_are_those_of_the_whole():
    rng = random.Random(1)
    for text in ("".join(rng.choice(["ab", "c", "d.", "e\n", "f ", " ", "  \t"]) + rng.choice(["", " "]) for _ in range(4000)), "x" * 5000, "a b", ""):
        def grams(parts):
            held = Counter()
            for part, own in parts:
                words = phrases.Words([(part, own, "en")])
                for k in range(1, 6):
                    g, g2, where = words.grams(k)
                    rows = words.counted(k, where, g, g2)
                    for p, c in zip(rows.column("phrase").to_pylist(), rows.column("c").to_pylist()):
                        held[p] += c
            return held

        raw = text.encode()
        parts = list(phrases.parts_of(raw, 100))
        assert len(parts) > 3 or len(raw) < 10 or " " not in text
        assert grams(parts) == grams([(raw, len(raw))])


def brute_codes(rows, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 16))
    cell = lambda x: math.floor(x) * 256 + math.floor((x - math.floor(x)) * 256)
    cut = [[[([*map(cell, v)] + [0] * (16 * width - len(v)))[p * width + i] for i in range(width)] for p in range(16)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        codes = [[pick(x[p], books[p]) for p in range(16)] for x in cut]
        for p in range(16):
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, codes) if c[p] == e]
                if own:
                    books[p] = [*books[p][:e], [sum(col) // len(own) for col in zip(*own)], *books[p][e + 1 :]]
    out, totals = [], Counter()
    for (i, _, label), x in zip(kept, cut):
        code = [pick(x[p], books[p]) for p in range(16)]
        error = sum(far(x[p], books[p][code[p]]) for p in range(16))
        totals[label] += error
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
    import hashlib

    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, code, error, totals[label], sha) for i, code, error, label in out]


def coded(spark, rows, kind="double"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x", 5) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error long").repartition(3)
    found, books = vectors.compress(df)
    return [tuple(r) for r in vectors.with_label_error(found).select("vec_id", "code", "error", "label_error", F.lit(vectors.digest(books))).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("kind,dimension,count", [("float", 64, 200), ("double", 16, 90), ("double", 21, 70), ("float", 64, 5)])
def test_vector_codes(spark, kind, dimension, count):
    rng = np.random.default_rng(count)
    rows = [(int(i), rng.normal(0, 0.3, dimension).astype(np.float32).tolist(), [None, 1, 2, 2][i % 4]) for i in rng.permutation(count)]
    nan, inf = float("nan"), float("inf")
    rows += [(900 + k, v, k) for k, v in enumerate([None, [None] * dimension, [nan] * dimension, [inf] + [0.0] * (dimension - 1), [-inf] + [1.0] * (dimension - 1), rows[0][1][:-1] + [None]])]
    rows += [rows[3], rows[3], (None, rows[1][1], 7), (-5, rows[2][1], None), (777, [0.5], 3), (778, [], 3)]  # repeats, a null id, short vectors
    assert sorted(coded(spark, rows, kind), key=key) == sorted(brute_codes(rows), key=key)


def test_vector_codes_beyond_64_bits_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e12, -3e11, 0.25, 1e5]) * rng.random() for _ in range(32)], i % 2) for i in range(80)]
    found, want = coded(spark, rows), brute_codes(rows)
    fits = lambda x: x if x < 1 << 63 else None
    assert {r[4] for r in found} == {want[0][4]}
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted((r[0], r[1], fits(r[2])) for r in want)


def test_vector_codes_without_rows(spark):
    assert coded(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    from tests.test_queries import TABLES, plain

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    told = con.execute(queries.oracle_sql()[name])
    names, found = [d[0] for d in told.description], queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(found.columns)
    assert Counter(tuple(plain(r[c]) for c in names) for r in found.collect()) == Counter(tuple(map(plain, r)) for r in told.fetchall())


def test_crc_of_pieces(spark, sf):
    found = packing.op11_packing(spark, sf)
    docs = packing.pack(packing.read_table(spark, sf, "documents")).select("doc_id", "start", "ids").collect()
    want = {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in docs}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in found.collect()} == want
