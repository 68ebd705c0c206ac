"""De-identification in six steps: health clauses go, then contacts, dates, names and quasi-identifiers become typed placeholders,
and what still looks like an identifier is flagged.

A placeholder is one lone surrogate while the steps run. No text of a table can hold one, and no pattern of a later step matches
it, so nothing is replaced twice. Every step reads a text once: runs of capitalised words are typed from the right to the left, so
that what stands before a run is still the text and what follows is already typed, and neither is scanned again for each run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.lexicons import (
    FIRST_PERSON, FUNCTION_WORDS, HEALTH_NEAR, HEALTH_STRONG, HEALTH_WEAK, LOCATION_CUES, MONTH_SHORT, MONTHS, OPPONENT_CUES, ORDINALS, PLACEHOLDERS, ROLE_KINDS,
    ROLE_NOUNS, RUN_ENDS, SPEECH_VERBS, SPORT_WORDS, STATE_WORDS, TITLES, UNITS, WEEKDAYS,
)
from tidewright.session import in_slices, share_package

#: Words that begin no name, whatever the corpus.
COMMON = frozenset(FUNCTION_WORDS) | frozenset(FIRST_PERSON) | frozenset(SPORT_WORDS) | frozenset(STATE_WORDS) | WEEKDAYS | frozenset(MONTHS) | ROLE_NOUNS | SPEECH_VERBS
MARK = {kind: chr(0xD800 + k) for k, kind in enumerate(PLACEHOLDERS)}
KIND = {mark: kind for kind, mark in MARK.items()}
MARKS = "".join(KIND)

NAME = r"[A-Z][A-Za-z]*(?:[-'][A-Z][A-Za-z]*)*"
RUN = re.compile(rf"{NAME}(?: {NAME})*")
WORD = re.compile(r"[A-Za-z][A-Za-z'-]*")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: White space is only entered at its beginning, so that a long stretch of it is read once.
CLAUSE = re.compile(r"(?<!\s)\s+(?:and|but)\s+|(?<!\s)\s*;\s*")
URL = re.compile(rf"\b(?:https?://|www\.)[^\s{MARKS}]+", re.IGNORECASE)
PHONE = re.compile(r"(?<!\w)\+?\d[\d\s().-]{5,}\d(?!\w)")
AT_HANDLE = re.compile(r"@[A-Za-z0-9][A-Za-z0-9_.]+")
TOLD_HANDLE = re.compile(rf"\b(username|handle|tag|account|nickname)\s+(?:was|is)\s+([^\s{MARKS}]+?)(?=[\s,;!?]|\.(?:\s|$)|$)", re.IGNORECASE)
#: A whole run of a handle's signs that holds a digit.
HANDLE_LETTERS = re.compile(r"(?<![a-z0-9._])[a-z._]*[0-9][a-z0-9._]*")
HANDLE_SHAPE = re.compile(r"\b[a-z][a-z0-9]*[._][a-z0-9._]*[a-z0-9]\b")
_MONTH = "|".join((*MONTHS, *MONTH_SHORT))
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
DATE = re.compile(rf"(\bon\s+)?(?:\b{_DAY}\s+(?:{_MONTH})\.?(?:\s+\d{{4}})?\b|\b(?:{_MONTH})\.?\s+{_DAY}(?:,?\s+\d{{4}})?\b|\b\d{{1,2}}[/.]\d{{1,2}}(?:[/.]\d{{2,4}})?\b)", re.IGNORECASE)
ROLE_NAME = re.compile(rf"\b((?:my|our|the)\s+({'|'.join(sorted(ROLE_NOUNS))})\s+)([a-z][a-z'-]+)\b")
NUMBER = re.compile(rf"\b(?:number|no\.|#)\s*\d{{1,3}}\b(?!\s*(?:{'|'.join(sorted(UNITS))})\b)", re.IGNORECASE)
PLACING = re.compile(rf"\b((?:finish|finished|finishing|placed|placing|came|coming|ranked|seeded)\s+)(?:no\.?\s*)?(?:{'|'.join(ORDINALS)}|\d{{1,2}}(?:st|nd|rd|th))\b", re.IGNORECASE)
ONLY = re.compile(r"\bthe only\b[^,.;]*?(?=(?<!\s)\s+(?:in|on|at|from|to|with)\b|[,.;]|$)", re.IGNORECASE)
LONG_NUMBER = re.compile(r"\b\d{5,}\b")
DIGIT = re.compile(r"\d")
LEAST_PHONE_DIGITS, REACH = 9, 48


@dataclass
class Report:
    """What was done to one text, and what it may still hold."""

    text: str = ""
    counts: dict[str, int] = field(default_factory=dict)
    clauses: int = 0
    flags: list[str] = field(default_factory=list)


def _is_health(part: str) -> bool:
    words = {w.lower() for w in WORD.findall(part)}
    return not words.isdisjoint(HEALTH_STRONG) or not words.isdisjoint(HEALTH_WEAK) and not words.isdisjoint(HEALTH_NEAR)


def without_health(text: str) -> tuple[str, int]:
    """Step 1: the text without its clauses of health detail, and how many went. Sentences without any stay whole; of others the
    clauses (parted by and, but and semicolons) that hold none are joined again."""
    kept, gone = [], 0
    none = not _is_health(text)  # then no sentence is
    for sentence in SENTENCE.split(text):
        if none or not _is_health(sentence):
            kept.append(sentence.strip())
            continue
        clauses = CLAUSE.split(sentence)
        clean = [c.strip() for c in clauses if not _is_health(c)]
        gone += len(clauses) - len(clean)
        rest = " and ".join(filter(None, clean))
        if rest:
            kept.append(rest[0].upper() + rest[1:] + ("" if rest[-1] in ".!?" else "."))
    return " ".join(filter(None, kept)).strip(), gone


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: in a run without blanks, from its first letter or digit to its last, if a sign @ stands in between and a point
    after that, two signs or more before the end."""
    for m in re.finditer(rf"[^\s{MARKS}]*@[^\s{MARKS}]*", text):
        run = m[0]
        inner = [i for i in (0, len(run) - 1)]
        while inner[0] < len(run) and not (run[inner[0]].isalnum() or run[inner[0]] == "_"):
            inner[0] += 1
        while inner[1] >= 0 and not (run[inner[1]].isalnum() or run[inner[1]] == "_"):
            inner[1] -= 1
        first, last = inner
        at = run.find("@", first + 1)
        if at > 0 and run.rfind(".", at + 2, max(0, last - 1)) > 0:
            yield m.start() + first, m.start() + last + 1


def _put(text: str, spans: Iterator[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _shaped_handles(text: str) -> Iterator[tuple[int, int]]:
    for m in HANDLE_LETTERS.finditer(text):
        digits = max(m[0].rfind(d) for d in "0123456789")
        if digits >= 0:
            # one sign beyond the run lets the pattern see whether a word goes on there
            for h in HANDLE_SHAPE.finditer(text, m.start(), min(len(text), m.end() + 1)):
                if h.start() <= m.start() + digits and (h.end() < len(text) or h.end() <= m.end()):
                    yield h.span()


def _contacts(text: str) -> str:
    """Step 2."""
    if "://" in text or "www." in text.lower():
        text = URL.sub(MARK["URL"], text)
    if "@" in text:
        text = _put(text, _emails(text), MARK["CONTACT"])
    text = PHONE.sub(lambda m: MARK["CONTACT"] if sum(map(str.isdigit, m[0])) >= LEAST_PHONE_DIGITS else m[0], text)
    text = AT_HANDLE.sub(MARK["HANDLE"], text)
    low = text.lower()
    if any(w in low for w in ("username", "handle", "tag", "account", "nickname")):  # a plain search is cheaper than the pattern
        text = TOLD_HANDLE.sub(lambda m: f"{m[1]} was {MARK['HANDLE']}", text)
    return _put(text, _shaped_handles(text), MARK["HANDLE"])


def _dates(text: str) -> str:
    """Step 3; "on" a date becomes "in" a window of time."""
    return text if not DIGIT.search(text) else DATE.sub(lambda m: ("in " if m[1] else "") + MARK["EVENT_WINDOW"], text)


def _back(text: str, at: int) -> int:
    """Where the white space before `at` begins."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The lower-cased word that ends at `at` (cut beyond REACH letters, where it is no cue), and where it begins."""
    found = re.search(r"[A-Za-z][A-Za-z'-]*$", text[max(0, at - REACH) : at])
    return (found[0].lower(), at - len(found[0])) if found else ("", at)


def _kind_of(text: str, start: int, words: list[str], following: list[str]) -> tuple[str, int, bool]:
    """(kind, where the placeholder begins, whether a cue says so) of a run of capitalised words."""
    end_of_gap = _back(text, start)
    if len(words) > 1:
        for kind, ends in RUN_ENDS.items():
            if words[-1].lower() in ends:
                year = re.search(r"\b\d{4}$", text[max(0, end_of_gap - 5) : end_of_gap]) if kind == "EVENT" and end_of_gap < start else None
                return kind, end_of_gap - 4 if year else start, True
    title = re.search(r"(?<!\w)[A-Za-z]+\.?$", text[max(0, end_of_gap - REACH) : end_of_gap])
    if title and title[0].rstrip(".").lower() in TITLES:
        return ROLE_KINDS.get(title[0].rstrip(".").lower(), "PERSON"), end_of_gap - len(title[0]), True
    word, at = _word_before(text, end_of_gap)
    if word in ROLE_NOUNS:
        return ROLE_KINDS.get(word, "PERSON"), start, True
    if word in OPPONENT_CUES:
        return "OPPONENT", start, True
    far = _word_before(text, _back(text, at))[0] if word in ("to", "in", "at", "from", "near") and _back(text, at) < at else ""
    if word in LOCATION_CUES or far in LOCATION_CUES:
        return "LOCATION", start, True
    if following in (["and", "i"], ["and", "me"]):
        return "TEAMMATE", start, True
    if len(words) > 1 and following and following[0] in SPEECH_VERBS:
        return "ATHLETE", start, True
    return "PERSON", start, False


def _names(text: str, common: frozenset[str]) -> str:
    """Step 4: names in lower case after a role, then runs of capitalised words, from the last to the first."""
    text = ROLE_NAME.sub(lambda m: m[0] if m[3] in common else m[1] + MARK[ROLE_KINDS.get(m[2], "PERSON")], text)
    parts: list[str] = []  # of the result, from the right to the left
    at = len(text)  # what stands from here on is done
    following: list[str] = []  # the next words of the result from there on
    for m in reversed(list(RUN.finditer(text))):
        start = m.start()
        words = text[start : min(m.end(), at)].split()  # a title that went with the run after it is no part of this one
        end = start + sum(map(len, words)) + len(words) - 1
        while words and words[0].lower() in common:
            start += len(words.pop(0)) + 1
        while words and words[-1].lower() in common:
            end -= len(words.pop()) + 1
        if not words:
            continue
        following = [*(w.lower() for w in _first_words(text, end, at)), *following][:2]
        kind, begins, cued = _kind_of(text, start, words, following)
        gap = _back(text, start)
        if not cued and len(words) == 1 and (not gap or text[gap - 1] in ".!?"):
            following = [words[0].lower(), *following][:2]
            parts.append(text[start:at])
            at = start
            continue
        parts += [text[end:at], MARK[kind]]
        at = begins
    return "".join([text[:at], *reversed(parts)])


def _first_words(text: str, start: int, end: int) -> list[str]:
    """At most two words between two places."""
    out = []
    for m in WORD.finditer(text, start, end):
        out.append(m[0])
        if len(out) == 2:
            break
    return out


def _quasi(text: str) -> str:
    """Step 5: numbers on shirts, placings and claims to be the only one; numbers with a unit stay."""
    if DIGIT.search(text):
        text = NUMBER.sub(MARK["ID"], text)
    low = text.lower()
    if any(w in low for w in ("finish", "plac", "came", "coming", "ranked", "seeded")):
        text = PLACING.sub(lambda m: m[1] + MARK["ID"], text)
    return ONLY.sub(MARK["ID"], text) if "the only" in low else text


def _left(text: str, common: frozenset[str]) -> list[str]:
    """Step 6: capitalised words that no rule resolved, and long numbers."""
    plain = re.sub(f"[{MARKS}]", " ", text)
    found = []
    for m in RUN.finditer(plain):
        words = [w for w in m[0].split(" ") if w.lower() not in common]
        gap = _back(plain, m.start())
        if words and not (len(words) == 1 and (not gap or plain[gap - 1] in ".!?")):
            found.append("unresolved_capitalised_token:" + " ".join(words))
    return found + [f"long_digit_run:{m[0]}" for m in LONG_NUMBER.finditer(plain)]


def deidentify(text: str | None, common: frozenset[str] = COMMON) -> Report:
    """All six steps. Null and blank texts give an empty text. Time is linear in the text's length."""
    if not text or not text.strip():
        return Report()
    out, clauses = without_health(text)
    out = _quasi(_names(_dates(_contacts(out)), common))
    out = re.sub(r"[ \t]{2,}", " ", out).strip()
    out = re.sub(r"(?<!\s)\s+([,.;:!?])", r"\1", out)
    counts: dict[str, int] = {}
    for mark in re.findall(f"[{MARKS}]", out):
        counts[KIND[mark]] = counts.get(KIND[mark], 0) + 1
    flags = _left(out, common)
    return Report(re.sub(f"[{MARKS}]", lambda m: f"[{KIND[m[0]]}]", out), counts, clauses, flags)


def common_words(docs: DataFrame, text: str = "text", share: float = 0.001, least: int = 5, most: int = 20_000) -> frozenset[str]:
    """Words that occur in lower case in at least `share` of the documents (and `least` of them), besides COMMON: what is often
    written small is no name. At most the `most` frequent ones reach the driver, of equal ones the smaller words."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\b[a-z][a-z]+\b"), F.lit(0)))).alias("w"))
    need = max(least, -(-int(docs.count() * share * 1000) // 1000))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    return COMMON | {r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(most).collect()}


def deidentified(docs: DataFrame, key: str, text: str = "text", common: frozenset[str] = COMMON) -> DataFrame:
    """(key, text, kinds, clauses, flags): the text with placeholders, their kinds in order of place, how many health clauses went, and
    the residual flags. One Arrow function."""
    share_package(docs.sparkSession)
    each: Callable[[str | None], Report] = lambda t: deidentify(t, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [each(t) for t in batch.column("text").to_pylist()]
            kinds = [re.findall(rf"\[({'|'.join(PLACEHOLDERS)})\]", r.text) for r in found]
            columns = [batch.column(key), pa.array([r.text for r in found]), pa.array(kinds, pa.list_(pa.string())), pa.array([r.clauses for r in found], pa.int32()), pa.array([r.flags for r in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "text", "kinds", "clauses", "flags"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, text string, kinds array<string>, clauses int, flags array<string>")
