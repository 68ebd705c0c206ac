"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much of its words is rejected.

DataFrame functions only. Line rules, on lines that hold a word:
- punctuation: LONG_LINE words or more without a sentence mark; or as many exclamation marks as LOUD of its words; or as
  many symbols as SYMBOLIC of its words;
- navigation: three or more menu separators, at least one to every four words;
- boilerplate: one of the known phrases in a line of at most BOILERPLATE_WORDS words, or the repetition of an earlier line.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import read_table

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LONG_LINE, LOUD, SYMBOLIC, BOILERPLATE_WORDS, MOST_LOST = 25, 0.3, 0.34, 40, 0.5
#: Phrases of page furniture.
BOILERPLATE = ("all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "terms of use", "click here to", "sign up for our newsletter")


def _occurs(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included. Windows of one text are equal if the
    64-bit hashes of their words are. A text whose hashes all differ is done without sorting."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def placed(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def told(hashes: Column) -> Column:
        alike = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(alike, _let(F.sort_array(placed(hashes)), covered)).otherwise(F.lit(0).cast("long"))

    def covered(s: Column) -> Column:
        # windows beside one of the same hash in sorted order, by place again; each adds the words not yet covered
        twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    # words are bound before lambdas read single ones: the optimizer may put the expression that makes them in their place
    return _let(words, lambda w: F.when(F.size(w) >= 3, _let(windows(w), told)).otherwise(F.lit(0).cast("long")))


def first_of_equal(lines: Column) -> Column:
    """The lines (text, n, fails) in order, without those that hold a word and repeat an earlier line; sorted, not compared pairwise."""

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, j: (x["n"] == 0) | F.coalesce(F.get(s, j - 1)["text"] != x["text"], F.lit(True)))

    placed = F.transform(lines, lambda x, i: F.struct(x["text"].alias("text"), i.alias("i"), x["n"].alias("n"), x["fails"].alias("fails")))
    in_place = _let(F.sort_array(placed), lambda s: F.sort_array(F.transform(firsts(s), lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"), x["n"].alias("n"), x["fails"].alias("fails")))))
    return F.transform(in_place, lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), x["fails"].alias("fails")))


def _line_fails(line: Column) -> Column:
    """The verdict of the rules on one line with its number of words n_."""
    text, n = line["text"], line["n"]
    known = _let(F.lower(text), lambda low: reduce(or_, (low.contains(phrase) for phrase in BOILERPLATE)))
    # characters are counted only where one occurs: a test is cheaper than a count
    silent = (n >= LONG_LINE) & ~text.rlike("[.!?:;]")
    loud = (n >= 3) & text.contains("!") & (_occurs(text, "!") >= n * LOUD)
    symbolic = (n >= 3) & text.rlike(f"[{SYMBOLS}]") & (_occurs(text, SYMBOLS) >= n * SYMBOLIC)
    menu = text.rlike("[|>»•]") & _let(_occurs(text, "|>»•"), lambda k: (k >= 3) & (k * 4 >= n))
    return silent | loud | symbolic | menu | ((n <= BOILERPLATE_WORDS) & known)


def judged(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """row (all columns of docs), cleaned (text without failing lines and later copies of lines) and the measures and verdicts of each row of docs(text).

    Null counts as an empty text: no words, rejected. A document is kept if it passes the base rule (50 words or more, at
    most half of them in repeated windows) and its failing lines hold at most most_lost of its words. Blank lines stay with
    the text. Very long texts are read whole. Columns of docs, whatever their names, stay inside row; rows repeat as they do in
    docs; an empty table gives no rows.
    """
    t = F.coalesce(F.col("row.text"), F.lit(""))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("t", t)
    counted = F.transform(F.split("t", "\n"), lambda x: F.struct(x.alias("text"), F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("n")))
    lines = F.transform(counted, lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), ((x["n"] > 0) & _line_fails(x)).alias("fails")))
    parts = base.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("lines", lines)
    real = F.filter("lines", lambda x: x["n"] > 0)
    measured = parts.select(
        "row",
        "lines",
        F.monotonically_increasing_id().alias("once"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        _occurs(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        _let(F.transform(real, lambda x: x["text"]), lambda r: F.size(r) - F.size(F.array_distinct(r))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    # the first of equal lines stays: what a later copy holds is what all lines hold less what distinct lines hold. A line goes with
    # its number of words as one string, since distinct strings are found by hashing but structs are compared pairwise
    good = F.transform(F.filter("lines", lambda x: (x["n"] > 0) & ~x["fails"]), lambda x: F.concat_ws("\n", x["n"].cast("string"), x["text"]))
    kept_words = F.aggregate(F.array_distinct(good), F.lit(0), lambda acc, x: acc + F.substring_index(x, "\n", 1).cast("int"))
    verdict = measured.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("kept_words", kept_words.cast("long"))
    once_each = F.when(F.col("n_dup_lines") > 0, first_of_equal(F.col("lines"))).otherwise(F.col("lines"))
    cleaned = F.array_join(F.transform(F.filter(once_each, lambda x: ~x["fails"]), lambda x: x["text"]), "\n")
    return verdict.select(
        "row", cleaned.alias("cleaned"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "once",
        (~F.col("base_failed") & ((F.col("n_words") - F.col("kept_words")) <= F.col("n_words") * most_lost)).alias("kept"),
    )


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with failing lines taken out of text and n_chars, where it exists, counted anew."""
    # a row number that can't be pushed down keeps the filter above the measures, which would else be computed twice
    kept = judged(docs).where(F.col("kept") & (F.col("once") >= 0))
    columns = [F.col("cleaned").alias(c) if c == "text" else F.length("cleaned").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return kept.select(*columns)


_KNOWN = " or ".join(f"contains(low, '{p}')" for p in BOILERPLATE)

OP7_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
p as (select rid, unnest(words) as word, generate_subscripts(words, 1) as i from w),
g as (select rid, i, word, lead(word) over o as w2, lead(word, 2) over o as w3 from p window o as (partition by rid order by i)),
twice as (select rid, i from (select *, count(*) over (partition by rid, word, w2, w3) as c from g where w3 is not null) where c > 1),
rep as (select rid, count(distinct i + j) as n_repeat_words from twice, (values (0), (1), (2)) as v(j) group by rid),
l0 as (select rid, unnest(string_split(t, chr(10))) as line from d),
l1 as (select rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n, lower(line) as low from l0),
l2 as (select *,
    (n >= {LONG_LINE} and not regexp_matches(line, '[.!?:;]'))
    or (n >= 3 and length(line) - length(replace(line, '!', '')) >= n * {LOUD})
    or (n >= 3 and len(regexp_extract_all(line, '[#*$%&|<>]')) >= n * {SYMBOLIC})
    or (len(regexp_extract_all(line, '[|>»•]')) >= 3 and len(regexp_extract_all(line, '[|>»•]')) * 4 >= n)
    or (n <= {BOILERPLATE_WORDS} and ({_KNOWN})) as fails
    from l1 where n > 0),
dup as (select rid, count(*) - count(distinct line) as n_dup_lines from l2 group by rid),
good as (select rid, sum(n) as kept_words from (select distinct rid, line, n from l2 where not fails) group by rid),
m as (select doc_id, len(words) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(kept_words, 0) as kept_words
    from w left join dup using (rid) left join rep using (rid) left join good using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
    n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and (n_words - kept_words) <= n_words * {MOST_LOST} as kept
from b
"""
