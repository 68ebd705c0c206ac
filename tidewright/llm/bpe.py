"""Byte-level BPE with word ends: a segment tree over the ranks of adjacent pairs picks each merge.

The leaves hold rank and position of every adjacent pair, so the root is the leftmost pair of the lowest rank. A merge
updates three leaves on logarithmic paths; the tree's root is empty when no pair can be merged any more.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches, read_table, slices

#: Words whose encoding is kept by a worker; the store is emptied when full.
CACHE_WORDS = 300_000
#: From this character on the Unicode tables of libraries differ; such texts are normalised and split by the tokenizers library.
SAFE_BELOW = "\u0530"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where it is printable Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Bpe:
    """A tokenizer read from the JSON text of a vocabulary file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, self.specials = spec["model"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = model["vocab"]
        self.token = {i: t for t, i in (vocab | self.specials).items()}
        end = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner, self.last = [vocab.get(c) for c in alphabet], [vocab.get(c + end) for c in alphabet]
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.whole = None not in self.inner and None not in self.last
        self.inner_ids, self.last_ids = (np.array([-1 if i is None else i for i in x], np.int64) for x in (self.inner, self.last))
        pairs_sorted = sorted(((a << 32) | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks, self.pair_merged = (np.array([x[i] for x in pairs_sorted], t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        self.special_head = commonprefix(list(self.specials))  # every special token begins with it; it may be empty
        self.split_special = regex.compile("|".join(sorted(map(regex.escape, self.specials), key=len, reverse=True))) if self.specials else None
        self.known: dict[str, tuple[bytes, str]] = {}
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.normalise = Tokenizer.from_str(text).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(WORD.pattern), "removed", invert=True).pre_tokenize_str

    def merge(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length()
        none = (len(merges) + 1) * n  # above every key rank * n + position
        get, low = merges.get, (len(merges), 0)
        tree = [none] * size + [get(p, low)[0] * n + i for i, p in enumerate(zip(ids, ids[1:]))]
        tree += [none] * (2 * size - len(tree))
        top = len(merges) * n
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, key: int) -> None:
            k = size + i
            tree[k] = key
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < key:
                    key = other
                if tree[k] == key:
                    break
                tree[k] = key

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) < top:
            i = root % n
            j = after[i]
            ids[i] = get((ids[i], ids[j]))[1]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
                put(i, get((ids[i], ids[k]), low)[0] * n + i)
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                put(h, get((ids[h], ids[i]), low)[0] * n + h)
        return [x for x in ids if x >= 0]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (the number of merges where there is none) and merged id of pairs."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], len(self.merges)), self.pair_merged[at]

    def merge_many(self, ids: np.ndarray) -> np.ndarray:
        """merge() of many short words at once: rows of ids, -1 behind the last and, in the result, where a symbol went into the
        one before it. One segment tree a row; every round takes each row's root and updates three of its leaves."""
        words, p = ids.shape  # p is a power of two
        none, top = (len(self.merges) + 1) * p, len(self.merges)
        rows = np.arange(words)
        real = ids >= 0
        has_next = np.concatenate((real[:, 1:], np.zeros((words, 1), bool)), axis=1)
        after = np.where(has_next, np.arange(1, p + 1), p)
        before = np.concatenate((np.broadcast_to(np.arange(-1, p - 1), (words, p)), np.zeros((words, 1), int)), axis=1)
        safe = np.where(real, ids, 0)
        rank, merged = self._lookup(safe, np.concatenate((safe[:, 1:], safe[:, :1]), axis=1))
        tree = np.full((words, 2 * p), none, np.int64)
        tree[:, p:] = np.where(has_next & (rank < top), rank * p + np.arange(p), none)
        width = p
        while width > 1:
            width >>= 1
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
        act = rows
        while len(act := act[tree[act, 1] < none]):
            i = tree[act, 1] & (p - 1)
            j = after[act, i]
            own = merged[act, i]
            ids[act, i], ids[act, j] = own, -1
            k = after[act, j]
            after[act, i] = k
            before[act, k] = i
            tree[act, p + j] = none
            right, h = k < p, before[act, i]
            left = h >= 0
            h = np.where(left, h, i)
            rank, new = self._lookup(np.concatenate((own, np.maximum(ids[act, h], 0))), np.concatenate((np.maximum(ids[act, np.where(right, k, i)], 0), own)))
            n = len(act)
            tree[act, p + i] = np.where(right & (rank[:n] < top), rank[:n] * p + i, none)
            merged[act, i] = new[:n]
            rl, hl, kl = act[left], h[left], rank[n:][left]
            tree[rl, p + hl] = np.where(kl < top, kl * p + hl, none)
            merged[rl, hl] = new[n:][left]
            at, node = np.concatenate((act, act, act)), np.concatenate((j, i, h)) + p
            while node[0] > 1:
                node >>= 1
                tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
        return ids

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet, short ones many at once."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            by_size.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for p, group in by_size.items():
            if p > 32 or not self.whole:
                for w, raw in group:
                    ids = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
                    self._know(w, self.merge([x for x in ids if x is not None]))
                continue
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                size = np.fromiter((len(raw) for _, raw in part), np.int64, len(part))
                raw = np.frombuffer(b"".join(raw for _, raw in part), np.uint8)
                ids = np.full((len(part), p), -1, np.int64)
                ids[np.arange(p) < size[:, None]] = self.inner_ids[raw]
                ids[np.arange(len(part)), size - 1] = self.last_ids[raw[np.cumsum(size) - 1]]
                ids = self.merge_many(ids)
                kept = ids >= 0
                flat, ends = ids[kept], np.cumsum(kept.sum(axis=1)).tolist()
                packed, tokens, a = flat.astype("<u4").tobytes(), [*map(self.token.__getitem__, flat.tolist())], 0
                for (w, _), b in zip(part, ends):
                    self.known[w] = packed[4 * a : 4 * b], " ".join(tokens[a:b])
                    a = b

    def _know(self, word: str, ids: list[int]) -> None:
        self.known[word] = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.token.__getitem__, ids))

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return WORD.findall(text.lower())
        if max(text) < SAFE_BELOW:
            return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # each letter lower-cased by itself
        return [w for w, _ in self.split(self.normalise(text))]

    def words(self, text: str) -> list[str]:
        """The normalised words of a text. A special token's string stays whole: no word of plain text equals it."""
        if not self.split_special or self.special_head not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [*self._plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and their decoded text: the tokens, blank-separated."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for content, i in self.specials.items():
            self._know(content, [i])
        split = [self.words(t) for t in texts]
        new = {w for words in split for w in words}.difference(self.known)
        self.learn(list(new))
        known, out = self.known, []
        for words in split:
            found = [known[w] for w in words]
            out.append((b"".join([a for a, _ in found]), " ".join([b for _, b in found if b])))
        for w in new:
            if len(w) > 64:
                del known[w]
        return out


@lru_cache(maxsize=2)
def _loaded(text: str) -> Bpe:
    return Bpe(text)


def tokenizer_text(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def _mapped(docs: DataFrame, columns: list[str], schema: str, path: str | None, digest: bool) -> DataFrame:
    text = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))  # a vocabulary file, of fixed size

    def make():
        bpe = _loaded(text.value)

        def each(batch: pa.RecordBatch):
            for part in slices(batch, "text", 256):  # ids and decoded texts of few documents at a time
                found = bpe.encode_decode([x or "" for x in part.column("text").to_pylist()])
                n = pa.array([len(a) // 4 for a, _ in found], pa.int64())
                if digest:
                    own = [pa.array([hashlib.sha256(x).hexdigest() for x, _ in found]), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for _, x in found])]
                else:
                    own = [pa.array([list(struct.unpack(f"<{len(a) // 4}I", a)) for a, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), n, *own], names=[*columns, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])

        return each

    return map_batches(docs.select(*columns, *([] if "text" in columns else ["text"])), make, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (string) of every row of docs(doc_id, text).

    Null and empty texts have no ids and decode to the empty string. Strings of special tokens in a text become those
    tokens. Extra columns aren't read; an empty table gives no rows; rows repeat as they do in docs.
    """
    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "doc_id long, n_tokens long, ids array<int>, decoded string", path, False)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _mapped(docs, ["doc_id"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", None, True)
