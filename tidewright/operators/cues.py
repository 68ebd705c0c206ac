"""Cues and phrases in texts: one automaton over all of them reads each text once, however many there are."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import in_slices, share_package

WORD_SIGNS = frozenset("0123456789abcdefghijklmnopqrstuvwxyz_")


@lru_cache(maxsize=8)
def automaton(cues: tuple[str, ...]) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton that gives the number of each cue at its ends; a cue that occurs twice keeps its first number."""
    found = ahocorasick.Automaton()
    for k, cue in enumerate(cues):
        if cue and cue not in found:
            found.add_word(cue, k)
    found.make_automaton()
    return found


def hits_in(text: str, cues: tuple[str, ...], starts: frozenset[int]) -> list[int]:
    """Numbers of the cues that occur in the text, in order. Those in `starts` count at word starts alone: behind no letter a-z, digit or
    underscore."""
    out: set[int] = set()
    for end, k in automaton(cues).iter(text):
        if k not in out:
            begin = end - len(cues[k]) + 1
            if k not in starts or begin == 0 or text[begin - 1] not in WORD_SIGNS:
                out.add(k)
    return sorted(out)


def cue_hits(rows: DataFrame, key: str, low: Column, cues: Iterable[tuple[str, str]], at_word_starts: bool = True) -> DataFrame:
    """(key, name, hits): how many different cues of each name a text has; texts without any give no row. cues: (name, cue), in lower
    case as the texts. With at_word_starts, cues without a blank match at word starts, others anywhere. Null texts have no cues, rows
    repeat as they do, and the work grows with texts and hits, not with the number of cues."""
    # one number for each different cue; what names it has
    of: dict[str, list[str]] = {}
    for n, c in dict.fromkeys(cues):
        of.setdefault(c, []).append(n)
    different = tuple(of)
    starts = frozenset(k for k, c in enumerate(different) if at_word_starts and " " not in c)
    share_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((different, [of[c] for c in different]))  # the cues, a list in hand

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues, named = sent.value
        for batch in in_slices(batches):
            keys, name, hits = [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                found = Counter(n for k in hits_in(text or "", cues, starts) for n in named[k])
                keys += [at] * len(found)
                name += found
                hits += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(name, pa.string()), pa.array(hits, pa.int64())], names=[key, "name", "hits"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, low.alias("__low")).mapInArrow(run, f"{key} {kind}, name string, hits long")


def phrase_hits(rows: DataFrame, key: str, sentences: Column, phrases: Iterable[str], other: str = "[^a-z0-9]+") -> DataFrame:
    """(key, phrase, n): in how many of a text's sentences each phrase stands as a run of whole words; zeros give no row. sentences: an
    array of strings. They are lower-cased, and whatever matches `other` parts words; phrases come in that form."""
    listed = tuple(dict.fromkeys(phrases))
    padded = F.transform(sentences, lambda s: F.concat(F.lit(" "), F.regexp_replace(F.lower(s), other, " "), F.lit(" ")))
    share_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(tuple(f" {p} " for p in listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, none = sent.value, frozenset()
        for batch in in_slices(batches):
            keys, phrase, n = [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                found = Counter(k for s in text or () if s for k in hits_in(s, spaced, none))
                keys += [at] * len(found)
                phrase += [listed[k] for k in found]
                n += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], names=[key, "phrase", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, padded.alias("__s")).mapInArrow(run, f"{key} {kind}, phrase string, n long")
