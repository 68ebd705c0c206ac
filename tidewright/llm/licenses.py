"""License scans by diagonal voting.

The rolling hashes of a text's word 4-grams are joined with the templates' positions. A match votes for its diagonal, the
offset of the text's position from the template's. Votes are counted by diagonal, diagonals that lie within a few words of each
other (a word put in or left out) are merged into bands. A band with enough votes is verified on the words: along each of its
diagonals the text's words are compared with the template's, and the score is the share of the template's 4-grams that are
found word for word. There is a template for each paragraph of a license, so that parts of one are found as well. Templates are
few and of fixed size, so their side of the join is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, alnum_words, map_batches, raw_bytes, read_table, slices

GRAM, DRIFT, LEAST = 4, 6, 0.6
#: Phrases that name a license, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Paragraphs of public license texts and notices, by label.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (
        "mit",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
        "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ),
    (
        "isc",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    (
        "cc-by",
        "You are free to share, copy and redistribute the material in any medium or format and adapt, remix, transform, and build upon the material for any purpose, even commercially, "
        "under the following terms: you must give appropriate credit",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose",
    ),
)


def gram_keys(words: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(b" ".join(words[i : i + GRAM])) - (1 << 63) for i in range(len(words) - GRAM + 1)]


def template_rows(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, int, str, int, int]]:
    """(template, position, label, number of grams, key)."""
    out = []
    for k, (label, text) in enumerate(templates):
        keys = gram_keys(alnum_words(text.encode()))
        out += [(k, i, label, len(keys), key) for i, key in enumerate(keys)]
    return out


def phrase_places(norm: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words begin; norm has a blank around every word."""
    out, at, words, done = [], norm.find(phrase), 0, 0
    while at >= 0:
        words += norm.count(b" ", done, at)
        done = at
        out.append(words)
        at = norm.find(phrase, at + 1)
    return out


def _base():
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]

    def each(batch: pa.RecordBatch):
        rows = []
        for raw in raw_bytes(batch.column("text")):
            words = alnum_words(raw)
            norm = b" " + b" ".join(words) + b" "
            found = [(place, label) for p, label in phrases for place in phrase_places(norm, p)]
            places = [p for p, _ in found]
            rows.append((len(words), len(found), min(places, default=None), max(places, default=None), sorted({x for _, x in found})))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        names = ["n_words", "n_base", "first_word", "last_word", "base"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "t1", "t2", *names])

    return each


def _grams():
    def each(batch: pa.RecordBatch):
        for part in slices(batch, "text", 64):
            keys = [gram_keys(alnum_words(raw)) for raw in raw_bytes(part.column("text"))]
            row = pa.array([k for k, x in enumerate(keys) for _ in x], pa.int32())
            places = pa.array([i for x in keys for i in range(len(x))], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("t1").take(row), part.column("t2").take(row), places, pa.array([k for x in keys for k in x], pa.int64())], names=["t1", "t2", "at", "key"])

    return each


def _verified(templates: tuple[tuple[str, str], ...]):
    """Compares the words of every band: (first, last, share) of the template's grams that stand in the text along the band's diagonals."""
    books = [alnum_words(text.encode()) for _, text in templates]

    def each(batch: pa.RecordBatch):
        for part in slices(batch, "text", 256):
            rows = []
            for raw, bands in zip(raw_bytes(part.column("text")), part.column("bands").to_pylist()):
                words = np.array(alnum_words(raw), object)
                found = []
                for band in bands:
                    book = np.array(books[band["template"]], object)
                    held, first, last = np.zeros(len(book) - GRAM + 1, bool), len(words), -1
                    for d in band["diagonals"]:
                        low, high = max(0, -d), min(len(book), len(words) - d)
                        if high - low < GRAM:
                            continue
                        same = (book[low:high] == words[low + d : high + d]).astype(np.int8)
                        grams = np.flatnonzero(np.convolve(same, np.ones(GRAM, np.int8), "valid") == GRAM) + low
                        if len(grams):
                            held[grams] = True
                            first, last = min(first, int(grams[0]) + d), max(last, int(grams[-1]) + d + GRAM - 1)
                    score = int(held.sum()) / len(held)
                    if score >= LEAST:
                        found.append({"label": templates[band["template"]][0], "first": first, "last": last, "score": score})
                rows.append(found)
            kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column("t1"), part.column("t2"), pa.array(rows, kind)], names=["t1", "t2", "spans"])

    return each


def spans(docs: DataFrame, scratch: Scratch, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """t1, t2, spans (label, first, last, score) of docs(t1, t2, text), one row for each text with a verified span, words first..last.
    Rows of one text are read once each and vote as one."""
    rows = template_rows(templates)
    book = F.broadcast(docs.sparkSession.createDataFrame(rows, "template int, place long, label string, grams int, key long"))
    matches = map_batches(docs.select("t1", "t2", "text"), _grams, "t1 long, t2 long, at long, key long").join(book, "key")
    votes = matches.groupBy("t1", "t2", "template", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count_distinct("place").alias("votes"))
    by = Window.partitionBy("t1", "t2", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT).cast("int"), F.lit(1))
    bands = votes.withColumn("apart", apart).withColumn("band", F.sum("apart").over(by)).groupBy("t1", "t2", "template", "grams", "band").agg(F.sum("votes").alias("votes"), F.collect_list("diagonal").alias("diagonals"))
    likely = bands.where(F.col("votes") >= F.col("grams") * LEAST).groupBy("t1", "t2").agg(F.collect_list(F.struct("template", "diagonals")).alias("bands"))
    # written first, so that both sides of the join come straight from a shuffle and the rows of a frequent text can be split
    one = docs.select("t1", "t2", "text").join(scratch.keep(likely, "likely"), ["t1", "t2"])
    kind = "t1 long, t2 long, spans array<struct<label: string, first: long, last: long, score: double>>"
    return map_batches(one, lambda: _verified(templates), kind).where(F.size("spans") > 0).dropDuplicates(["t1", "t2"])


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs(doc_id, text).

    score is the greatest verified share of a template, 0 without one; labels are those of phrases and templates. Null, empty
    and short texts have none (empty strings); very long texts are read whole. Bands with equal scores all count, their labels
    are sorted. Rows of one text get equal results; extra columns aren't read; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
    scratch = Scratch(docs.sparkSession, "licenses")
    verified = scratch.keep(spans(own, scratch).select("t1", "t2", F.array_distinct(F.transform("spans", lambda x: x["label"])).alias("more"), F.array_max(F.transform("spans", lambda x: x["score"])).alias("score")), "verified")
    base = map_batches(own, _base, "doc_id long, t1 long, t2 long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    none = F.array().cast("array<string>")
    return base.join(verified, ["t1", "t2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read_table(spark, sf_dir, "documents"))
