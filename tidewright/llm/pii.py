"""Personal data by weak supervision.

Fixed patterns find the base spans. Beyond them, wider candidate spans of three kinds (names, numbers, addresses) are voted on by
six labelers a kind: patterns (form), gazetteers (given names, dialling codes, domain endings) and context (words beside the
span). A labeler votes yes, no or not at all, and no candidate is thrown away before the votes; the base patterns' own matches
are candidates as well, on which the pattern labeler votes yes, so that context is learnt from them. Expectation maximisation
over the counts of all vote patterns of all documents, for each kind by itself, estimates the labelers' reliabilities and a
posterior for each pattern. A logistic span classifier is then fitted to the posteriors on hashed features of the span's words
and neighbours, not on the votes. A candidate that it accepts and that meets no base span is added.

The driver receives counts by vote pattern (a number fixed by the labelers) and, for the classifier, a sample bounded by SAMPLE.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, map_batches, read_table, slices

KINDS = ("email", "ip", "card", "phone", "person", "number", "address")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates: runs of capitalised words, whose parts of two or three different words may be names; digit groups; at signs.
RUN = re.compile(r"(?<![\w'’-])[^\W\d_a-zß-öø-ÿ](?:\.|[^\W\d_]*(?:[-'’][^\W\d_]+)*)(?:\x20[^\W\d_a-zß-öø-ÿ](?:\.(?=\x20)|[^\W\d_]*(?:[-'’][^\W\d_]+)*))+")
NUMBER = re.compile(r"(?<![\w+])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}(?!\w)")
AT_SIGN = re.compile(r"(?<![^\s<(])[^\s<>()@,;]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[^\s<>()@,;]{2,100}")
FORMS = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\+?[0-9]{1,3}(?:[ ./-][0-9]{2,4}){2,6}|00[1-9][0-9]{8,13}|0[1-9](?:[ .][0-9]{2}){4}")
NEIGHBOUR = re.compile(r"[^\W_]+")
#: Words of the gazetteer and context labelers.
GIVEN_NAMES = frozenset(
    "anna maria james john mary robert patricia michael linda david elizabeth william barbara richard susan joseph jessica thomas "
    "sarah carlos ana luis carmen jose josé pierre marie jean claire hans peter klaus petra ursula stefan jürgen günter hélène "
    "françois andré maría lucía sofía javier miguel pablo elena laura martin paul emma julia daniel".split()
)
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra".split())
NAME_BEFORE = frozenset("contact name named signed attn dear by nombre nom llamado appelé heißt namens patient employee customer author".split())
NAME_AFTER = frozenset("said says wrote lives born aged told called sagte wohnt geboren dijo vive nació dit habite né née".split())
NOT_NAME = frozenset(
    "the a an this that these for from in on at of and or to with is it der die das und ein eine von zu el la los las de en un una y "
    "le les du des et une license version university company inc ltd gmbh street road avenue river lake mount north south east west "
    "new old great grand central national international general public united states january february march april may june july "
    "august september october november december monday tuesday wednesday thursday friday saturday sunday home news about".split()
)
NEAR_NUMBER = frozenset("phone tel telephone telefon teléfono téléphone mobile handy móvil call fax contact ssn passport iban account card born dob id".split())
NOT_NUMBER = frozenset("version isbn page pages order invoice chapter figure table section total sum population year serial item article code".split())
UNITS = frozenset("km m kg euros euro dollars usd eur percent items people times units bytes rows years".split())
DIALLING = ("001", "0033", "0034", "0044", "0049", "0039", "0041", "0043", "+1", "+33", "+34", "+44", "+49", "+39", "+41", "+43", "0800")
NEAR_ADDRESS = frozenset("email mail contact write address reach correo courriel adresse kontakt".split())
NOT_ADDRESS = frozenset("git ssh scp price rate each sold user".split())
ENDINGS = frozenset("com org net edu gov de fr es uk eu io".split())
LABELERS, NO, YES, UNVOTED = 6, 1, 2, 0.02
#: Hashed features of the span classifier, and the most distinct candidates of one kind and side that it is fitted on.
FEATURES, SAMPLE = 4096, 4000


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses; each at sign is looked at once, so long runs take linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        seg = text[free:at]
        start = free + len(seg.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind; a failing match is dropped."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if len(m[0]) < 14:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def _words_before(text: str, at: int) -> list[str]:
    return NEIGHBOUR.findall(text[max(0, at - 40) : at].lower())[-3:]


def _word_after(text: str, at: int) -> str:
    m = NEIGHBOUR.search(text, at, at + 24)
    return m[0].lower() if m else ""


def _form(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:24]))


def _hashed(kind: int, names: list[str]) -> list[int]:
    return sorted({crc32(f"{kind}|{x}".encode("utf-8", "surrogatepass")) % FEATURES for x in names})


def _pack(votes: tuple[int, ...]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v
    return out


Candidate = tuple[int, int, int, int, list[int]]  # kind, start, end, votes as a base-3 number, features


def _person_candidates(text: str) -> list[Candidate]:
    out = []
    for m in RUN.finditer(text):
        words, at = [], m.start()
        for w in m[0].split(" "):
            words.append((w, w.lower().rstrip("."), at, at + len(w)))
            at += len(w) + 1
        if not all(w[0].isupper() for w, _, _, _ in words):
            continue
        before, after = _words_before(text, m.start()), _word_after(text, m.end())
        opens = text[: m.start()].rstrip(" ")[-1:] if m.start() < 2 else text[max(0, m.start() - 2) : m.start()].rstrip(" ")[-1:]
        for i in range(len(words)):
            for n in (2, 3):
                part = words[i : i + n]
                low = [x for _, x, _, _ in part]
                if len(part) < n or len(set(low)) < n or len(part[-1][1]) < 2:
                    continue
                prev = words[i - 1][1] if i else before[-1] if before else ""
                end = i + n == len(words)
                following = after if end else words[i + n][1]
                shapely = all(2 <= len(x) <= 15 and not w.isupper() or len(x) == 1 for w, x, _, _ in part)
                titled = any(x in TITLES or x in NAME_BEFORE for x in low)
                votes = _pack((
                    NO if not shapely else 0,
                    YES if low[0] in GIVEN_NAMES else NO if any(x in GIVEN_NAMES for x in low[1:]) and n == 2 else 0,
                    NO if titled or any(x in NOT_NAME for x in low) else 0,
                    YES if prev in TITLES or prev in NAME_BEFORE else 0,
                    YES if following in NAME_AFTER else 0,
                    NO if (not end and words[i + n][1] not in NOT_NAME) or (i and prev in GIVEN_NAMES) else 0,
                ))
                names = [
                    "bias", f"n={n}", f"prev={prev}", f"next={following}", f"first={low[0]}", f"last3={low[-1][-3:]}", f"run={min(6, len(words))}",
                    f"at={i == 0}{end}", f"opens={opens if not opens.isalnum() else 'w'}", f"form={' '.join(_form(w) for w, _, _, _ in part)}",
                    f"len={sum(map(len, low)) // (3 * n)}", *(f"in={x}" for x in low), f"pair={prev}|{min(3, len(words) - i)}",
                ]
                out.append((4, part[0][2], part[-1][3], votes, _hashed(4, names)))
    return out


def _number_candidates(text: str, base: set[tuple[int, int]]) -> list[Candidate]:
    out = []
    for m in NUMBER.finditer(text):
        span, start, end = m[0], m.start(), m.end()
        before, after = _words_before(text, start), _word_after(text, end)
        digits = [c for c in span if c.isdigit()]
        plain = len(digits) == len(span)
        failing = 14 <= len(digits) <= 19 and not _luhn("".join(digits))
        near, against = bool(NEAR_NUMBER.intersection(before[-2:])), bool(NOT_NUMBER.intersection(before[-2:]))
        votes = _pack((
            YES if (start, end) in base or FORMS.fullmatch(span) else NO if failing else 0,
            YES if span.replace(" ", "").startswith(DIALLING) else 0,
            YES if near else 0,
            NO if against else 0,
            NO if plain and not near else 0,
            NO if after in UNITS else 0,
        ))
        names = ["bias", f"digits={len(digits)}", f"form={_form(span)}", f"plain={plain}", f"head={span[:2]}", f"next={after}", f"groups={len(re.findall('[0-9]+', span))}",
                 *(f"prev{k}={w}" for k, w in enumerate(reversed(before[-2:]))), *(f"near={w}" for w in before[-2:]), f"luhn={failing}"]
        out.append((5, start, end, votes, _hashed(5, names)))
    return out


def _address_candidates(text: str, base: set[tuple[int, int]]) -> list[Candidate]:
    out = []
    if "@" not in text and "at]" not in text and "at)" not in text:
        return out
    sorted_base = sorted(base)
    starts = [a for a, _ in sorted_base]
    for m in AT_SIGN.finditer(text):
        start, end = m.start(), m.start() + len(m[0].rstrip(".!?:'\"]}"))
        span = text[start:end]
        hidden = "@" not in span
        if hidden:  # the host may go on after a spelt-out dot
            more = re.compile(r"(?:\x20?[\[(](?:dot|punkt|point)[\])]\x20?[A-Za-z0-9-]+)+").match(text, end)
            end, span = (more.end(), text[start : more.end()]) if more else (end, span)
        before, after = _words_before(text, start), _word_after(text, end)
        local, ending = re.split(r"@|\x20?[\[(]at[\])]\x20?", span, maxsplit=1)[0], re.split(r"[^A-Za-z]+", span.lower())[-1]
        inside = any(b <= end for _, b in sorted_base[bisect_left(starts, start) : bisect_left(starts, end)])
        votes = _pack((
            YES if inside or re.search(r"[A-Za-z0-9](?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z]{2,}$", span) else NO,
            YES if ending in ENDINGS else NO,
            YES if NEAR_ADDRESS.intersection(before[-3:]) else 0,
            NO if NOT_ADDRESS.intersection(before[-2:]) else 0,
            YES if hidden else 0,
            NO if not re.search("[A-Za-z]", local) else 0,
        ))
        names = ["bias", f"hidden={hidden}", f"ending={ending}", f"local={_form(local)}", f"len={len(span) // 6}", f"next={after}", f"dots={min(4, span.count('.'))}",
                 *(f"prev{k}={w}" for k, w in enumerate(reversed(before[-2:]))), f"head={span[:1] if not span[:1].isalnum() else 'w'}"]
        out.append((6, start, end, votes, _hashed(6, names)))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[Candidate]:
    """Wider spans with the votes of the labelers and the features of the classifier."""
    held = {(a, b) for _, a, b in base}
    return _person_candidates(text) + _number_candidates(text, held) + _address_candidates(text, held)


def decode_votes(votes: int) -> list[int]:
    out = []
    for _ in range(LABELERS):
        votes, v = divmod(votes, 3)
        out.append(v)
    return out[::-1]


def reliabilities(counts: dict[int, int], rounds: int = 60, belief: float = 0.02) -> tuple[float, np.ndarray, dict[int, float]]:
    """Prior, P(vote | class) of each labeler and the posterior of each vote pattern of one kind, by expectation maximisation on
    counts. `belief`, as a share of all candidates, is the weight of the prior belief that yes votes stand on the right spans.
    Candidates without any vote take no part in the estimate; with nothing said for them they get the posterior UNVOTED."""
    patterns = sorted(p for p in counts if p)
    votes = np.array([decode_votes(p) for p in patterns]).reshape(-1, LABELERS)
    weight = np.array([counts[p] for p in patterns], float)
    yes, no = (votes == YES).sum(axis=1), (votes == NO).sum(axis=1)
    post = (yes + 0.05) / (yes + 2 * no + 1.0)
    prior, table = 0.5, np.zeros((LABELERS, 2, 3))
    pseudo = (1 + belief * weight.sum()) * np.array([[0.6, 0.35, 0.05], [0.5, 0.05, 0.45]])
    for _ in range(rounds):
        prior = float(np.clip((weight @ post + 0.5) / (weight.sum() + 2), 1e-4, 1 - 1e-3))
        for k in range(LABELERS):
            for c, p in ((0, 1 - post), (1, post)):
                table[k, c] = [(weight * p * (votes[:, k] == v)).sum() + pseudo[c, v] for v in range(3)]
                table[k, c] /= table[k, c].sum()
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[k, 1, votes[:, k]] / table[k, 0, votes[:, k]]) for k in range(LABELERS))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return prior, table, {0: UNVOTED, **dict(zip(patterns, post.tolist()))}


def fit_classifier(rows: list[tuple[list[int], float, float]], rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model of (features, posterior, weight), by gradient steps of decreasing size."""
    beta, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    if not rows:
        return beta
    at = np.concatenate([f for f, _, _ in rows]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    y, w = np.array([p for _, p, _ in rows]), np.array([w for _, _, w in rows])
    w = w / w.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, beta[at], len(rows)), -30, 30)))
        grad = np.bincount(at, (w * (y - p))[of], FEATURES) - decay / len(rows) * beta
        seen += grad**2
        beta += 0.5 * grad / np.sqrt(seen)
    return beta


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def free_spans(chosen: list[tuple[float, int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The likeliest of overlapping spans (probability, kind, start, end) that meet no base span; of equal ones the longest, then
    the first. Taken spans lie apart, so a search among their starts finds any that overlap."""
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(base, key=lambda x: x[1]):  # base spans of two kinds may overlap: merged
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    clear = []
    for p, k, a, b in chosen:
        i = bisect_right(starts, a)
        if not (i and ends[i - 1] > a) and not (i < len(starts) and starts[i] < b):
            clear.append((p, k, a, b))
    clear.sort(key=lambda x: x[2])
    out, group, reach = [], [], -1
    for x in [*clear, (0.0, -1, 1 << 62, 1 << 62)]:  # overlapping spans form groups, few each
        if group and x[2] >= reach:
            held: list[tuple[int, int, int]] = []
            for _, k, a, b in sorted(group, key=lambda x: (-round(x[0], 9), x[2] - x[3], x[2])):
                if not any(a < d and c < b for _, c, d in held):
                    held.append((k, a, b))
            out += held
            group = []
        group.append(x)
        reach = max(reach, x[3])
    return out


def _scan():
    span = pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
    wide = pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("votes", pa.int32()), ("feats", pa.list_(pa.int32()))])

    def each(batch: pa.RecordBatch):
        for part in slices(batch, "text", 2048, 8 << 20):
            base, more = [], []
            for text in part.column("text").to_pylist():
                own = sorted(base_spans(text or ""), key=lambda x: (x[1], x[0]))
                base.append([{"kind": k, "a": a, "b": b} for k, a, b in own])
                more.append([{"kind": k, "a": a, "b": b, "votes": v, "feats": f} for k, a, b, v, f in candidates(text or "", own)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(wide))], names=["doc_id", "base", "more"])

    return each


def learnt(seen: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> np.ndarray:
    """The span classifier's weights from all candidates' votes: reliabilities on the counts of all vote patterns, the classifier
    on at most `sample` distinct candidates of each kind and side (those of the least hashes), weighted to stand for all."""
    vectors = seen.select(F.explode("more").alias("c")).groupBy("c.kind", "c.votes", "c.feats").agg(F.count(F.lit(1)).alias("n"))
    vectors = scratch.keep(vectors, "vectors")
    counts: dict[int, dict[int, int]] = {}
    for r in vectors.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect():  # at most 3 ** LABELERS patterns a kind
        counts.setdefault(r["kind"], {})[r["votes"]] = r["n"]
    posterior = {(k, v): p for k, c in counts.items() for v, p in reliabilities(c)[2].items()}
    if not posterior:
        return np.zeros(FEATURES)
    book = F.broadcast(seen.sparkSession.createDataFrame([(k, v, p) for (k, v), p in posterior.items()], "kind int, votes int, p double"))
    judged = vectors.join(book, ["kind", "votes"]).withColumn("side", F.col("p") >= 0.5)
    totals = {(k, side): sum(n for v, n in c.items() if (posterior[k, v] >= 0.5) == side) for k, c in counts.items() for side in (True, False)}
    rows = []
    for k, side in sorted(totals):
        if totals[k, side]:
            part = judged.where((F.col("kind") == k) & (F.col("side") == side)).orderBy(F.xxhash64("feats", "votes"), "votes").limit(sample).select("feats", "p", "n").collect()
            scale = totals[k, side] / sum(r["n"] for r in part)
            rows += [(r["feats"], r["p"], r["n"] * scale) for r in part]
    return fit_classifier(rows)


def find_pii(docs: DataFrame, accept: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs(doc_id, text).

    Offsets are code points, ends exclusive. Null and empty texts have no spans (empty string, hash of the empty string); very
    long texts are read whole, in time linear in their length. Of overlapping added spans the likeliest stays, then the longest,
    then the first. Extra columns aren't read; rows repeat as they do in docs; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    schema = "doc_id long, base array<struct<kind: int, a: int, b: int>>, more array<struct<kind: int, a: int, b: int, votes: int, feats: array<int>>>"
    seen = scratch.keep(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, schema), "seen")
    beta = learnt(seen, scratch, sample)
    least = float(np.log(accept / (1 - accept)))

    def make():
        def each(batch: pa.RecordBatch):
            rows = []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist()):
                own = [(x["kind"], x["a"], x["b"]) for x in base]
                scored = [(float(beta[x["feats"]].sum()), x["kind"], x["a"], x["b"]) for x in more]
                added = free_spans([x for x in scored if x[0] > least], own)
                every = sorted(own + added, key=lambda x: (x[1], x[0]))
                rows.append((*(sum(k == i for k, _, _ in own) for i in range(4)), hashlib.sha256(joined(own).encode()).hexdigest(), joined(every)))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

        return each

    return map_batches(seen, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op1_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
