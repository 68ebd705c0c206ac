"""Column functions on text. All run inside the JVM; a null text gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.lexicons import FIRST_PERSON, FUNCTION_WORDS, SPORT_WORDS, STATE_WORDS, STOPWORDS

PLACEHOLDER = r"\[[A-Z][A-Z_]*\]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def tokenise(text: Column) -> Column:
    """Words of letters and apostrophes, lower-cased, and placeholders like [NAME], as they are."""
    return F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER + "|[A-Za-z']+"), F.lit(0)), lambda t: F.when(t.startswith("["), t).otherwise(F.lower(t)))


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Blank-joined n-grams in order; none if there are fewer tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def among(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def listed(tokens: Column, words: tuple[str, ...]) -> Column:
    """How many tokens, repeats included, are among the words."""
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def language(text: Column) -> Column:
    """struct(language, score, margin, tokens): the stop-word profile with the greatest share of the words; und below five words or a share of 0.10. Ties go to the smaller code."""

    def verdict(ranked: Column, n: Column) -> Column:
        first, second = F.get(ranked, 0), F.get(ranked, 1)
        known = (n >= 5) & (-first["s"] >= 0.10)
        return F.struct(
            F.when(known, first["code"]).otherwise("und").alias("language"),
            F.when(n >= 5, F.round(-first["s"], 6)).otherwise(0.0).alias("score"),
            F.when(n >= 5, F.round(second["s"] - first["s"], 6)).otherwise(0.0).alias("margin"),
            n.cast("long").alias("tokens"),
        )

    def told(words: Column) -> Column:
        n = F.size(words)
        share = lambda w: (-F.round(listed(words, w) / F.greatest(n, F.lit(1)), 9)).alias("s")
        ranked = F.array_sort(F.array(*(F.struct(share(w), F.lit(code).alias("code")) for code, w in STOPWORDS.items())))
        return let(ranked, lambda r: verdict(r, n))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), told)


def admission(text: Column) -> Column:
    """The first reason for which a text isn't admitted, else ok. A null text is empty."""

    def judged(p: Column) -> Column:
        t, tokens, every = p["t"], p["tokens"], p["every"]
        letters = F.length(F.regexp_replace(t, r"[^\p{L}\s]", ""))
        shaped = F.size(F.filter(tokens, lambda w: (F.length(w) <= 20) & w.rlike("[aeiouy]") & ~w.rlike(r"(.)\1{3,}")))
        known = F.size(F.array_distinct(F.filter(tokens, lambda w: w.isin(*FUNCTION_WORDS))))
        return (
            F.when(F.length(t) == 0, "empty")
            .when(letters / F.length(t) < 0.55, "not_letters")
            .when((F.size(tokens) < 4) | (F.length(t) < 16), "too_short")
            .when(shaped / F.size(tokens) < 0.60, "not_words")
            .when((F.size(every) >= 8) & (F.size(F.array_distinct(every)) / F.size(every) < 0.30), "repetition")
            .when(known < 2, "not_language")
            .otherwise("ok")
        )

    def parted(t: Column) -> Column:
        split = lambda low: F.struct(t.alias("t"), F.regexp_extract_all(low, F.lit(r"[a-z']+"), F.lit(0)).alias("tokens"), F.regexp_extract_all(low, F.lit(r"[^ \t\n\r\f\x0b]+"), F.lit(0)).alias("every"))
        return let(let(F.lower(t), split), judged)

    return let(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), parted)


def relevance(text: Column) -> Column:
    """Weighted first-person, topic and state words less shouting and digits, from 0 to 1."""

    def scored(tokens: Column) -> Column:
        n = F.size(tokens)
        hits = lambda listed_words: F.least(F.size(F.array_distinct(F.filter(tokens, lambda t: t.isin(*listed_words)))), F.lit(3)) / 3
        shouts = let(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda words: F.size(F.filter(words, lambda w: w.rlike("^[A-Z]{2,}$"))) / F.greatest(F.size(words), F.lit(1)))
        digits = F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))
        score = 5.0 * listed(tokens, FIRST_PERSON) / F.greatest(n, F.lit(1)) + 0.25 * hits(SPORT_WORDS) + 0.30 * hits(STATE_WORDS) - shouts - 4.0 * digits
        return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z'\-]+"), F.lit(0)), scored)


JUNK = ("too_short", "no_alphabetic_content", "placeholder_only", "unbalanced_brackets", "truncated_ending", "repeated_token_run")


def junk_flags(text: Column, least_tokens: int = 3) -> Column:
    """The names of all junk checks that a text fails."""

    def checked(words: Column) -> Column:
        n = F.size(words)
        count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
        run = (n >= 3) & F.exists(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: (F.get(words, i) == F.get(words, i - 1)) & (F.get(words, i - 1) == F.get(words, i - 2)))
        checks = (
            n < least_tokens,
            ~F.regexp_replace(text, PLACEHOLDER, "").rlike("[A-Za-z]"),
            (n > 0) & F.forall(words, lambda w: w.startswith("[")),
            (count("[") != count("]")) | (count("(") != count(")")),
            let(F.regexp_replace(text, r"\s+$", ""), lambda stripped: (F.length(stripped) > 0) & ~stripped.rlike(r"[.!?\"']$")),
            run,
        )
        return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for c, name in zip(checks, JUNK))), lambda x: x.isNotNull())

    return let(tokenise(text), checked)


#: Characters folded by normalisation.
QUOTES, DASHES = "‘’‚‛′“”„″«»", "‐‑‒–−"


#: Horizontal white space, and characters without width.
BLANK, ZERO_WIDTH = r" \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}", r"\x{200B}-\x{200F}\x{2060}\x{FEFF}"


def normalise(text: Column) -> Column:
    """Control and zero-width characters out, quotes and dashes folded, ellipses and blanks collapsed, lines stripped. Compatibility folding (NFKC) is applied before, where it is wanted."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}" + ZERO_WIDTH + "]", "")
    t = F.translate(t, QUOTES + DASHES, "'" * 5 + '"' * 6 + "-" * 5)
    t = F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), r"\.{4,}", "...")
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, f"[{BLANK}]+", " "), r"\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \n]+([,.;:!?%])", "$1"), r"[ \n]*—[ \n]*", " — ")
    return F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"^[ \n]+|[ \n]+$", "")


def silhouette(text: Column) -> Column:
    """Digits as 9, capitals as A, small letters as a, of the first 40 characters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(text, 1, 40), "[0-9]", "9"), "[A-Z]", "A"), r"[a-z]", "a")


def days_until(text: Column) -> Column:
    """Days to an event where the text states them plainly."""
    low = F.lower(text)
    said = F.regexp_extract(low, r"(?:^|[^0-9a-z])([0-9]{1,2})\s+days?\s+(?:out|to go|until|before)", 1)
    return (
        F.when(low.contains("tomorrow") | low.contains("night before") | low.contains("day before"), 1)
        .when(low.contains("this weekend") | low.contains("in a few days"), 3)
        .when(low.contains("next week") | low.contains("week out"), 7)
        .when((said != "") & (said.try_cast("int") <= 60), said.try_cast("int"))
    )


def type_token_ratio(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def draw(*parts: Column) -> Column:
    """A deterministic draw below 2^32 from the parts: the first eight hex digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")
