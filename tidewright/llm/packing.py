"""Packing: documents' token ids in sequences of at most `size` tokens, shortest pack first over the histogram of lengths.

A document's ids are cut at every `size` ids; what is left of each makes a histogram of at most `size` lengths. The plan
works on counts alone: lengths are placed longest first, each into the shortest packs that hold it, and equal packs are one pattern
with a count. A new pack is opened only while the tokens still to place exceed the room of the open packs; from then on a length
that fits nowhere is cut to the room of the shortest pack, and its rest is placed later, so little is padded and few pieces are cut.

Patterns meet documents by rank: each piece has a rank among those of its length, and a pattern's slot holds a range of ranks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.bpe import byte_alphabet, tokenizer_text
from tidewright.llm.common import Scratch, map_batches, read_table, slices

SIZE, SEPARATOR = 1024, 0
#: No piece shorter than this is cut off, and rooms below twice as much are left to whole pieces. Rows of the ranks' offsets that may be broadcast.
LEAST_CUT, MOST_OFFSETS = 8, 500_000
#: The byte-level pattern of the vocabulary files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file. Where the file's merges are in the order of their ids
    and nothing else is set, tiktoken encodes with the same ranks, several times faster; texts that it gives up on go to
    the library, as do all texts of other files."""

    def __init__(self, text: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(text)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made = [model["vocab"].get(a + b) for a, b in pairs]
        specials = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"] and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"])}
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout")
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.fast = None
        if plain and None not in made and made == sorted(made) and len(specials) == len(spec["added_tokens"]) and made[0] > max(model["vocab"][c] for c in byte):
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except ValueError:  # its regular expressions have a bounded stack
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def _loaded(text: str) -> Encoder:
    return Encoder(text)


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, part, nth): each document's ids and the separator, cut at every `size`. ids are
    little-endian unsigned 32-bit; nth counts the pieces of a length within a task, whose number is part."""
    text = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path or default_path()))  # a vocabulary file, of fixed size

    def make():
        encoder, part, seen = _loaded(text.value), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)

        def each(batch: pa.RecordBatch):
            for some in slices(batch, "text", 1024):
                doc, start, length, total, ids, nth = [], [], [], [], [], []
                for d, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    own = np.append(encoder.ids(t or ""), np.uint32(SEPARATOR)).astype("<u4")
                    for at in range(0, len(own), size):
                        piece = own[at : at + size]
                        doc.append(d)
                        start.append(at)
                        length.append(len(piece))
                        total.append(len(own))
                        ids.append(piece.tobytes())
                        nth.append(int(seen[len(piece)]))
                        seen[len(piece)] += 1
                columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"])

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, start long, length int, doc_tokens long, ids binary, part int, nth long")


class Pattern:
    """`count` equal packs of `total` tokens. Each slot (length, first, copies, at, piece, offset) takes, of the pieces of that length, ranks
    first + i * copies .. + copies - 1 into pack i, from token `at` of the piece on `piece` tokens, from `offset` of the pack on."""

    __slots__ = ("total", "count", "slots")

    def __init__(self, total: int, count: int, slots: list[tuple[int, int, int, int, int, int]]) -> None:
        self.total, self.count, self.slots = total, count, slots

    def split(self, n: int) -> Pattern:
        """Takes the first n packs away and returns them."""
        head = Pattern(self.total, n, self.slots)
        self.slots = [(length, first + n * copies, copies, at, piece, offset) for length, first, copies, at, piece, offset in self.slots]
        self.count -= n
        return head

    def add(self, length: int, first: int, copies: int, at: int, piece: int) -> None:
        self.slots = [*self.slots, (length, first, copies, at, piece, self.total)]
        self.total += copies * piece


def plan(histogram: dict[int, int], size: int = SIZE, least_cut: int = LEAST_CUT) -> list[Pattern]:
    """Patterns that hold every piece once. Steps grow with the number of lengths and patterns, not with the pieces."""
    # what is still to place, by length: (length of the piece, first rank, count, from which of its tokens on)
    waiting: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, c, 0)] for n, c in histogram.items() if c and n < size}
    done = [Pattern(0, c, []) for n, c in histogram.items() if c and n == size]
    for p in done:
        p.add(size, 0, 1, 0, size)
    tokens = sum(n * c for n, c in histogram.items() if n < size)  # to place
    room = 0  # of open packs with room for a cut
    usable = lambda total: size - total if size - total >= 2 * least_cut else 0
    heap: list[tuple[int, int, Pattern]] = []
    made = 0

    def put_back(p: Pattern) -> None:
        nonlocal made, room
        made += 1
        room += usable(p.total) * p.count
        if p.total == size:
            done.append(p)
        else:
            heapq.heappush(heap, (p.total, made, p))

    def take() -> Pattern:
        nonlocal room
        p = heapq.heappop(heap)[2]
        room -= usable(p.total) * p.count
        return p

    def some(p: Pattern, n: int) -> Pattern:
        """At most n packs of p; the rest goes back."""
        if n >= p.count:
            return p
        head = p.split(n)
        put_back(p)
        return head

    for n in range(size - 1, 0, -1):
        line = waiting.pop(n, [])
        while line:
            length, first, count, at = line.pop()
            if heap and heap[0][0] + n <= size:  # the shortest packs hold it
                p = some(take(), count)
                ahead = -(-(heap[0][0] - p.total) // n) if heap else size
                copies = min((size - p.total) // n, max(1, ahead), count // p.count)
                p.add(length, first, copies, at, n)
                used = p.count * copies
                put_back(p)
            elif heap and room >= tokens and usable(heap[0][0]):  # no pack holds it, so it is longer than that room, and none is needed for it
                p = some(take(), count)
                cut = min(size - p.total, n - least_cut)
                p.add(length, first, 1, at, cut)
                used = p.count
                rest = waiting.setdefault(n - cut, [])
                rest.append((length, first, used, at + cut))
                tokens += used * (n - cut)  # it is still to place
                put_back(p)
            else:
                copies = min(size // n, count)
                packs = max(1, min(count // copies, -(-(tokens - room) // size)))
                p = Pattern(0, packs, [])
                p.add(length, first, copies, at, n)
                used = packs * copies
                put_back(p)
            tokens -= used * n
            if used < count:
                line.append((length, first + used, count - used, at))
    return done + [p for _, _, p in heap]


class Places:
    """Where the tokens of a piece go, by its length and rank."""

    def __init__(self, patterns: list[Pattern]) -> None:
        slots, self.sequences = [], 0
        for p in patterns:
            slots += [(*s, p.count, self.sequences) for s in p.slots]
            self.sequences += p.count
        by_length: dict[int, list] = {}
        for s in slots:
            by_length.setdefault(s[0], []).append(s[1:])
        self.of: dict[int, tuple[np.ndarray, list[list]]] = {}
        for length, own in by_length.items():
            own.sort()
            bounds = sorted({s[0] for s in own})
            # slots of one length that begin at another rank overlap only where pieces are cut: sweep over the ranks
            edges = sorted({*bounds, *(s[0] + s[1] * s[5] for s in own)})
            held, k, live = [], 0, []
            for e in edges:
                live = [s for s in live if s[0] + s[1] * s[5] > e]
                while k < len(own) and own[k][0] <= e:
                    live.append(own[k])
                    k += 1
                held.append(sorted(live, key=lambda s: s[2]))
            self.of[length] = np.array(edges, np.int64), held

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, tokens, sequence, offset) of each part of a piece."""
        edges, held = self.of[length]
        out = []
        for first, copies, at, piece, offset, _, base in held[int(np.searchsorted(edges, rank, side="right")) - 1]:
            i, j = divmod(rank - first, copies)
            out.append((at, piece, base + i, offset + j * piece))
        return out


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, least_cut: int = LEAST_CUT) -> DataFrame:
    """doc_id, start, length, ids (binary), doc_tokens, sequence_id and offset of every piece of docs(doc_id, text).

    Null and empty texts are the separator alone. Very long texts are encoded whole; every id lies in one piece, and pieces
    fill their sequence gapless from 0. Pieces of equal length are ranked by task and order within it, as written once. Rows repeat as
    they do in docs, with null ids too; an empty table gives no rows; extra columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, size, path), "pieces")
    counts = scratch.keep(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, size, least_cut)))
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    ranked = cut.join(F.broadcast(before) if counts.count() <= MOST_OFFSETS else before, ["length", "part"])

    def make():
        where = places.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            doc, start, total, ids = (batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
            row, at, length, sequence, offset = [], [], [], [], []
            for i, (n, rank) in enumerate(zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist())):
                for a, b, c, d in where.place(n, rank):
                    row.append(i)
                    at.append(a)
                    length.append(b)
                    sequence.append(c)
                    offset.append(d)
            columns = [
                pa.array([doc[i] for i in row], pa.int64()), pa.array([start[i] + a for i, a in zip(row, at)], pa.int64()), pa.array(length, pa.int64()),
                pa.array([ids[i][4 * a : 4 * (a + b)] for i, a, b in zip(row, at, length)], pa.binary()), pa.array([total[i] for i in row], pa.int64()),
                pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        return each

    wanted = ranked.select("doc_id", "start", "doc_tokens", "ids", "length", (F.col("before") + F.col("nth")).alias("rank"))
    return map_batches(wanted, make, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame, size: int = SIZE, pad: int = SEPARATOR) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence of pack() in order, padded to `size` except at a power of two. A group
    is one sequence, of at most `size` tokens."""
    held = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    padding = pad.to_bytes(4, "little").hex().upper()
    text = packed.groupBy("sequence_id").agg(F.array_join(F.transform(held, lambda x: x["ids"]), "").alias("text"))
    counted = text.withColumn("n_tokens", (F.length("text") / 8).cast("int"))
    filled = F.when(F.bit_count("n_tokens") == 1, F.col("text")).otherwise(F.rpad("text", 8 * size, padding))
    return counted.select("sequence_id", "n_tokens", F.unhex(filled).alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
