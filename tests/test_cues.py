"""Cues and phrases by one automaton against one search for each."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.operators import cues


def plain_hits(text, listed, at_word_starts):
    found = Counter()
    for name, cue in dict.fromkeys(listed):
        pattern = re.escape(cue) if " " in cue or not at_word_starts else "(^|[^0-9a-z_])" + re.escape(cue)
        if re.search(pattern, text or ""):
            found[name] += 1
    return found


@pytest.mark.parametrize("at_word_starts", [True, False])
def test_cues(spark, at_word_starts):
    rng = random.Random(3)
    listed = [(rng.choice("ABC"), c) for c in ["a", "ab", "abc", "b c", "c", "é", "the", "he", "he said", "a.b", "_x", "same", "same"]] + [("D", "ab")]
    texts = [None, "", "ab", "xab", "éab", "1ab _ab ab"] + ["".join(rng.choice(["a", "b", "c", " ", "the", "he said", "é", "_x", ".", "7", "same"]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(i % 250, t) for i, t in enumerate(texts)], "hits long, name string").withColumnRenamed("hits", "id")
    found = cues.cue_hits(rows, "id", F.col("name"), listed, at_word_starts)
    want = Counter((i % 250, n, c) for i, t in enumerate(texts) for n, c in plain_hits(t, listed, at_word_starts).items())
    assert Counter(map(tuple, found.collect())) == want


def test_phrases_are_runs_of_whole_words(spark):
    rows = spark.createDataFrame([(1, ["Of the sea", "off the sea", "of, THE", None]), (2, None), (3, []), (4, ["of the of the", "so of the"])], "id long, s array<string>")
    found = cues.phrase_hits(rows, "id", F.col("s"), ["of the", "sea", "the of"])
    assert sorted(map(tuple, found.collect())) == [(1, "of the", 2), (1, "sea", 2), (4, "of the", 2), (4, "the of", 1)]
    assert cues.phrase_hits(rows.limit(0), "id", F.col("s"), ["x"]).collect() == []


def test_thousands_of_cues_cost_little_more_than_a_few():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(6, 12)))
    texts, few, many = [" ".join(word() for _ in range(3000)) for _ in range(60)], tuple(word() for _ in range(8)), tuple({word() for _ in range(8000)})
    took = []
    for listed in (few, many):
        cues.automaton(listed)
        began = time.perf_counter()
        for t in texts:
            cues.hits_in(t, listed, frozenset(range(len(listed))))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]
