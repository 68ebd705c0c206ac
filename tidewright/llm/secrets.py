"""Secrets: fixed patterns, and a linear-chain conditional random field over all tokens for what the patterns miss.

Tags are outside (0), begin (1) and inside (2). Tokens are runs without blanks and quotes that hold a letter or digit, cut at
logins of addresses and at arguments. Every token can be tagged. Most are provably outside in the best path whatever stands around
them (Field says when), so they are passed over and the Viterbi path of a text falls apart there; the transitions from and to
them are scored, so what is found is what decoding the whole chain would find.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches, read_table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BUCKETS, OWN_BUCKETS, MOST_PAIR = 4096, 3584, 0.7
#: Words that name a secret, in the four languages of the corpus, by what they name.
NAMES = {
    "pass": "password passwd pwd pass passphrase passwort kennwort losung passe contraseña contrasena clave palabra",
    "code": "passcode pin otp code zugangscode codigo código kode",
    "key": "key apikey schlüssel schluessel clé cle llave",
    "secret": "secret token geheimnis jeton ficha secreto secrète",
    "auth": "bearer authorization credential credentials private access aws auth zugang zugangsdaten acceso accès acces identifiants credenciales",
}
PROSE = re.compile(r"([^\W\d_][^\W\dA-Z_]*)([.,;:!?)]*)")
NAMES = {word: kind for kind, words in NAMES.items() for word in words.split()}
#: Endings of compound names.
NAME_ENDS = ("passwort", "kennwort", "schlüssel", "zugangscode", "password", "passwd", "token", "secret", "passphrase")
#: A run without blanks and quotes; an apostrophe within a word belongs to it.
RAW = re.compile(r"""[^\s"'`]+(?:(?<=\w)'(?=\w)[^\s"'`]+)*""")
WORDS = re.compile(r"[^\W\d]+")
QUOTE = re.compile(r"""["'`]""")
NOT_BLANK = re.compile(r"\S+")
#: Where a run is cut: user, password and host of an address; arguments one by one. What stands before a separator is its name.
LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:([^/@:?#]*)(?::([^/@]*))?@)")
ARGUMENT = re.compile(r"[?&;,](?=[A-Za-z_][A-Za-z0-9_.-]*=)")
HEAD = re.compile(r"[(\[{<:=,;|>-]*(?:[A-Za-z_][A-Za-z0-9_.-]*[:=]+(?!//|$))?[(\[{<]*")
QUOTES, NEAR = "\"'`", 40
DENIED = -1e9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind; a failing match is dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def shape(token: str) -> str:
    """Runs of letters, digits and signs, each written once: aA9-."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^A-Za-z0-9]", "-", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", token)))))[:24]


def parts_of(raw: str) -> list[tuple[int, int]]:
    """The tokens of a run: it is cut at logins and arguments, and names with their separator, leading and closing signs go."""
    edges, login = [0], LOGIN.match(raw)
    if login:
        edges += [login.start(1), *([login.start(2)] if login[2] is not None else []), login.end()]
    edges += [m.end() for m in ARGUMENT.finditer(raw, edges[-1])]
    out = []
    for a, b in zip(edges, [*edges[1:], len(raw)]):
        inner = bool(login) and 0 < a < login.end()
        start = a if inner else a + HEAD.match(raw[a:b]).end()
        end = b if b == len(raw) else b - 1  # without the sign that parts them
        end = start + len(raw[start:end].rstrip("" if inner else ".,;:)]}>"))
        bare = raw[start:end].rstrip("!?")
        if bare.isalpha():  # these marks may close a secret, but not a word
            end = start + len(bare)
        if start < end and any(map(str.isalnum, raw[start:end])):
            out.append((start, end))
    return out


def split_runs(text: str) -> tuple[list[str], Callable[[], list[int]]]:
    """The runs of a text, as RAW finds them, and a function that gives where they begin."""
    raws = text.split()
    if any(q in text for q in QUOTES):
        found = [(m[0], m.start()) for m in RAW.finditer(text)]
        return [r for r, _ in found], lambda: [a for _, a in found]
    if sum(map(len, raws)) + len(raws) - 1 == len(text):  # single blanks between them and none around
        return raws, lambda: [a - len(r) - 1 for a, r in zip(accumulate(map((1).__add__, map(len, raws))), raws)]
    return raws, lambda: [m.start() for m in NOT_BLANK.finditer(text)]


def tokens_of(text: str) -> list[tuple[int, int]]:
    """All tokens of a text."""
    return [(m.start() + a, m.start() + b) for m in RAW.finditer(text) for a, b in parts_of(m[0])]


def file_features(text: str) -> list[str]:
    """What the whole text is like: code or prose, many or few assignments."""
    lines = text.count("\n") + 1
    return [f"file:assigns={min(3, (text.count('=') + text.count(': ')) * 4 // lines)}", f"file:braces={min(2, text.count('{') + text.count(';'))}"]


@lru_cache(maxsize=200_000)
def _bucket(name: str) -> int:
    """Features of the place of a token ("at:") have buckets of their own."""
    h = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
    return OWN_BUCKETS + h % (BUCKETS - OWN_BUCKETS) if name.startswith("at:") else h % OWN_BUCKETS


def _kind(token: str) -> str:
    letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
    return "word" if re.fullmatch(r"[^\W\d_]?[^\W\dA-Z_]*", token) else "letters" if letters == len(token) else "digits" if digits == len(token) else "plain" if letters + digits == len(token) else "signs"


def string_features(token: str) -> list[str]:
    """What the token itself shows: shape, length, character mix, how little it reads like words."""
    kind = _kind(token)
    if kind == "word":  # lower case but for the first letter: all such words of a length are alike
        return [f"kind=word,title={token[0].isupper()}", f"kind=word,len={min(9, len(token) // 3)}"]
    form = shape(token)
    hard = max(map(len, re.findall(r"[bcdfghjklmnpqrstvwxz]+", token.lower())), default=0)
    switches = len(re.findall(r"[a-z][A-Z]|[A-Z]{2,}[a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]", token))
    long = min(9, len(token) // 4)
    stems = re.findall(r"[A-Za-z]?[a-z]{3,}", token)
    worded = int(4 * sum(map(len, stems)) / len(token))
    return [
        f"shape={form[:6]}", f"runs={min(8, len(form) // 2)}", f"len={long}", f"mix={int(5 * len(set(token)) / min(len(token), 40))}", f"digits={int(5 * sum(map(str.isdigit, token)) / len(token))}",
        f"signs={min(4, sum(not c.isalnum() for c in token))}", f"kind={kind}", f"kind={kind},hard={min(6, hard)},len={long}", f"kind={kind},switches={min(9, switches)},len={long}", f"kind={kind},worded={worded},len={long}",
        f"slash={min(3, token.count('/'))},dot={min(3, token.count('.'))},dash={min(3, token.count('-'))},under={min(3, token.count('_'))}", f"url={'://' in token or token.lower().startswith('www.')},mail={'@' in token}",
    ]


def names_in(words: list[str]) -> list[str]:
    """For each word what it names, or nothing; parts of snake_case and camelCase count, and endings of compounds."""
    out = []
    for w in words:
        low = w.lower().strip("_")
        parts = [low, *low.split("_"), *(x.lower() for x in re.findall(r"[A-Z][a-z]+$", w))]
        out.append(next((NAMES[x] for x in reversed(parts) if x in NAMES), "secret" if low.endswith(NAME_ENDS) else ""))
    return out


def _edge(char: str) -> str:
    return char if char and char in ".,;:=()[]{}<>/@|&" else "w" if char.isalnum() else "o" if char else ""


def place_of(text: str, start: int, end: int, kind: str, size: int, near: bool = True) -> tuple:
    """What stands around the token: separator, quotes, what the two words before it name, and the sign after it. near: whether a
    naming word may stand there."""
    before, after = text[max(0, start - NEAR) : start], text[end : end + 1]
    named, beside, bare = "", False, before.rstrip(" \t" + QUOTES)
    if near:
        found = list(WORDS.finditer(before))[-2:]
        names = names_in([m[0] for m in found])
        named = next((x for x in reversed(names) if x), "")
        beside = bool(names) and bool(names[-1]) and not re.search(r"\w\W+$|[0-9]", before[found[-1].end() :])
    quote = f"{before[-1:] in tuple(QUOTES)}{after in tuple(QUOTES)}"
    return kind, size, _edge(before.rstrip()[-1:]), quote, bare[-1:] in (":", "="), named, beside, _edge(after), after == "@" and bare[-1:] in (":", "/")


def _place_names(kind: str, size: int, sep: str, quote: str, parted: bool, named: str, beside: bool, after: str, login: bool) -> list[str]:
    return [
        "at:bias", f"sep={sep}", f"quote={quote}", f"named={named}", f"next={after}", f"login={login}", f"kind={kind},parted={parted},named={named}", f"kind={kind},beside={beside}",
        f"kind={kind},size={size},parted={parted},beside={beside},named={bool(named)}", f"kind={kind},quote={quote},parted={parted}",
    ]


def token_features(text: str, start: int, end: int, of_file: list[str]) -> list[int]:
    """Buckets of one token's features: its own, those of its place and the file's."""
    token = text[start:end]
    return [_bucket(x) for x in (*string_features(token), *_place_names(*place_of(text, start, end, _kind(token), min(9, len(token) // 2))), *of_file)]


class Crf:
    """Weights of a linear-chain conditional random field with three tags."""

    def __init__(self) -> None:
        self.unary, self.pair = np.zeros((BUCKETS, 3)), np.zeros((3, 3))

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.unary[r].sum(axis=0) for r in rows])

    def transitions(self) -> np.ndarray:
        out = self.pair.copy()
        out[0, 2] = DENIED
        return out

    def fit(self, data: list[tuple[list[list[int]], list[int], bool, bool]], rounds: int, rate: float = 0.3, decay: float = 1e-4) -> Crf:
        """Stochastic gradient of the conditional log likelihood by forward-backward, with per-weight step sizes.
        Each run comes with its tags and whether outside tokens stand before and after it."""
        seen_u, seen_p = np.full((BUCKETS, 3), 1e-6), np.full((3, 3), 1e-6)
        order = list(range(len(data)))
        rng = random.Random(5)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                rows, tags, before, after = data[k]
                u, t = self.scores(rows), self.transitions()
                n = len(rows)
                fwd, bwd = np.zeros((n, 3)), np.zeros((n, 3))
                fwd[0] = u[0] + np.array([0, 0, DENIED]) + before * t[0]
                bwd[-1] = after * t[:, 0]
                for i in range(1, n):
                    fwd[i] = u[i] + np.logaddexp.reduce(fwd[i - 1][:, None] + t, axis=0)
                for i in range(n - 2, -1, -1):
                    bwd[i] = np.logaddexp.reduce(t + (u[i + 1] + bwd[i + 1])[None, :], axis=1)
                total = np.logaddexp.reduce(fwd[-1] + bwd[-1])
                marginal = np.exp(fwd + bwd - total)
                for i, r in enumerate(rows):
                    g = -marginal[i]
                    g[tags[i]] += 1
                    idx = np.unique(r)
                    own = np.repeat(g[None, :], len(idx), axis=0)
                    own[idx < OWN_BUCKETS, 1:] = g[1] + g[2]  # begin and inside share them, so that they differ by place alone
                    step = own - decay * self.unary[idx]
                    seen_u[idx] += step**2
                    self.unary[idx] += rate * step / np.sqrt(seen_u[idx])
                if n > 1 or before or after:
                    g = np.zeros((3, 3))
                    if before:
                        g[0] -= marginal[0]
                        g[0, tags[0]] += 1
                    if after:
                        g[:, 0] -= marginal[-1]
                        g[tags[-1], 0] += 1
                    for i in range(1, n):
                        g -= np.exp(fwd[i - 1][:, None] + t + (u[i] + bwd[i])[None, :] - total)
                        g[tags[i - 1], tags[i]] += 1
                    seen_p += g**2
                    # small weights of pairs keep needed() small, and so most words cold
                    self.pair = np.clip(self.pair + rate * g / np.sqrt(seen_p), -MOST_PAIR, MOST_PAIR)
        return self

    def decode(self, rows: list[list[int]], before: bool = False, after: bool = False) -> list[int]:
        """The best tag path by Viterbi; of equal paths the one with the smaller tags. before, after: outside tokens are there."""
        u, t = self.scores(rows), self.transitions()
        best, back = u[0] + np.array([0, 0, DENIED]) + before * t[0], []
        for i in range(1, len(rows)):
            all_ = best[:, None] + t
            back.append(all_.argmax(axis=0))
            best = all_.max(axis=0) + u[i]
        tags = [int((best + after * t[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def needed(self) -> float:
        """How far begin and inside must lie below outside for a token to be outside in every best path, whatever its neighbours: the
        most that tagging it can gain on transitions, and what its follower loses by being begin instead of inside."""
        t, bias = self.pair, self.unary[_bucket("at:bias")]
        tagged = [(p, x) for p in range(3) for x in (1, 2) if (p, x) != (0, 2)]
        alone = max(t[p, x] + t[x, n] - t[p, 0] - t[0, n] for p, x in tagged for n in (0, 1))
        within = max(t[p, x] + t[x, 2] + t[2, n] - t[p, 0] - t[0, 1] - t[1, n] for p, x in tagged for n in range(3))
        last = max(t[p, x] - t[p, 0] for p, x in tagged)  # at the end of a text
        return max(alone, last, bias[2] - bias[1] + max(within, max(t[p, x] + t[x, 2] - t[p, 0] - t[0, 1] for p, x in tagged)))


def _random_secret(rng: random.Random) -> str:
    """A key or token as programs make them."""
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda alphabet, low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    both = lambda low, high: next(x for x in iter(lambda: some(base62, low, high), "") if re.search("[0-9]", x) and re.search("[A-Z]", x) and re.search("[a-z]", x))
    return rng.choice([
        lambda: both(18, 44), lambda: both(20, 30), lambda: some(base62[:52], 15, 40), lambda: rng.choice(["sk-", "ghp_", "xox-", "pk_live_", "glpat-", "npm_", "key-"]) + both(16, 40),
        lambda: some(base62 + "+/", 36, 64) + rng.choice(["", "=", "=="]), lambda: ".".join(both(18, 40) for _ in range(3)), lambda: some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 32),
    ])()


def _chosen_secret(rng: random.Random, word) -> str:
    """A password as people make them: only its place tells it from other words."""
    some = lambda alphabet, low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    return rng.choice([
        lambda: word().title() + rng.choice("!@#$%^&*") + some(letters, 3, 8) + rng.choice(["", *"!@#$%^&*"]), lambda: word() + str(rng.randint(1, 9999)) + rng.choice(["", word()]), lambda: some(letters, 6, 16),
        lambda: some(letters[:52], 6, 20), lambda: word() + word(), lambda: word().title() + str(rng.randint(1, 99)), lambda: word().replace("o", "0").replace("e", "3") + str(rng.randint(1, 99)) + "X",
    ])()


def training_lines(count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, bool]]]]:
    """Labelled lines made by rule: (text, [(start, end, begins)]). Secrets stand after naming words of four languages, in logins of
    addresses, or anywhere if they look random, also in several parts; the rest are prose, names, paths, identifiers, versions,
    dates, addresses and numbers, also beside separators and naming words."""
    rng = random.Random(seed)
    sounds = ["ba", "re", "ton", "lin", "st", "er", "mo", "du", "al", "in", "ce", "po", "sch", "ung", "eau", "qu", "os", "ción", "ä", "tr", "ghe", "my", "ck"]
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))
    small = ["the", "of", "to", "and", "is", "for", "der", "und", "la", "de", "et", "que", "el", "in", "a", "on"]
    plain = lambda n: " ".join(rng.choice([word, word, lambda: rng.choice(small), lambda: word().title()])() + rng.choice(["", "", "", "", "", ",", ".", rng.choice(["!", "?", "...", " -", " –", " |", " *", "!!", "###", "$$", "%", " &", "»", "*", " •"])]) for _ in range(n))
    digits = lambda low, high: "".join(rng.choice("0123456789") for _ in range(rng.randint(low, high)))
    secret, chosen = (lambda: _random_secret(rng)), (lambda: _chosen_secret(rng, word))
    name = lambda kind: rng.choice([w for w, k in NAMES.items() if k == kind])
    styled = lambda n: rng.choice([n, n, n.title(), n.upper(), f"{word()}_{n}", f"{word()}{n.title()}", f"{n} {word()}"])
    parted = lambda: rng.choice([": ", ":", "=", " = ", ' = "', '="', ": '", '": "'])
    # what stands before the secret, the secret, what stands after it
    true = [
        lambda: (styled(name("pass")) + parted(), chosen(), ""),
        lambda: (f"{rng.choice(['the', 'your', 'das', 'le', 'la', 'el'])} {name('pass')} {rng.choice(['is', 'ist', 'lautet', 'est', 'es'])} ", next(x for x in iter(chosen, "") if not x.isalpha() or not x[1:].islower()), ""),
        lambda: (styled(name("code")) + parted(), rng.choice([digits(4, 10), f"{digits(3, 4)}-{digits(3, 4)}"]), ""),
        lambda: (f"{name('code')} {rng.choice(['is', 'ist', 'lautet', 'est', 'es', ''])} ".replace("  ", " "), rng.choice([digits(4, 10), f"{digits(3, 4)}-{digits(3, 4)}"]), ""),
        lambda: (styled(name(rng.choice(["key", "secret", "auth"]))) + parted(), rng.choice([secret, chosen])(), ""),
        lambda: (rng.choice(["Bearer ", "authorization: Bearer ", "bearer token ", "Authorization: Basic ", "access key "]), secret(), ""),
        lambda: (f"{rng.choice(['postgres', 'mysql', 'redis', 'amqp', 'https', 'ftp', 'mongodb+srv'])}://{rng.choice([word(), 'root', 'admin', ''])}:", rng.choice([chosen, secret])().replace("@", "a").replace("/", "b"), f"@{word()}.{word()}.org{rng.choice(['', ':5432', '/' + word(), '/' + word() + '/' + word()])}"),
        lambda: (f'{{"{word()}": "{word()}", "{styled(name(rng.choice(["pass", "key", "secret", "auth"])))}": "', rng.choice([secret, chosen])(), f'", "{word()}": {rng.choice([digits(1, 4), chr(34) + word() + chr(34)])}}}'),
        lambda: (f"{word()}:\n  {word()}: {word()}\n  {styled(name(rng.choice(['pass', 'key', 'secret', 'auth'])))}: ", rng.choice([secret, chosen])(), f"\n  {word()}: {rng.choice([digits(1, 4), word()])}"),
        lambda: ("https://", secret().replace("/", "b"), f"@{word()}.com/{word()}/{word()}"),
        lambda: (rng.choice(["", "", "use ", "with ", "see ", "id ", f"{word()} "]), secret(), ""),
        lambda: (f"{word()}={word()}&{rng.choice(['sig', 'signature', 'key', 'auth'])}=", secret(), ""),
    ]
    false = [
        *[lambda: plain(rng.randint(4, 16))] * 6,
        lambda: f"{rng.choice(['the key', 'access to', 'private', 'secret', 'bearer of', 'a token of', 'authorization for', 'the code', 'a pass', 'pin', 'la clave', 'le code de', 'der Schlüssel zu', 'la clé de', 'palabra', 'el acceso a', 'der Zugang zu'])} {plain(rng.randint(1, 6))}",
        lambda: f"{rng.choice(['note', 'see', 'total', 'title', 'value', 'name', 'key', 'code', 'access', word()])}{parted()}{plain(rng.randint(1, 3))}",
        lambda: f"{rng.choice(['total', 'value', 'page', 'year', 'order', word()])}{parted()}{rng.choice([digits(1, 9), '$' + digits(2, 4) + '.' + digits(2, 2), digits(1, 3) + '%'])}",
        lambda: f"at {rng.randint(1, 23)}:{rng.randint(10, 59)} {plain(2)}",
        lambda: f"{word()}.{word()}{rng.choice(['', digits(1, 3)])}@{word()}.{rng.choice(['org', 'com', 'example'])}",
        lambda: f"{word()}{rng.choice([': ', ' ', ' = '])}{word()}{digits(1, 4)}{rng.choice(['', word()])}",
        lambda: f"{rng.choice(['https://', 'http://', 'www.'])}{word()}.org/{word()}{digits(0, 3)}{rng.choice(['', '/' + word() + '-' + word() + '.html', '?' + word() + '=' + digits(1, 3), '/' + digits(4, 8)])}",
        lambda: f"{rng.choice(['see', 'file', 'in', ''])} {rng.choice(['', '/', './', 'C:/'])}{word()}/{word()}/{word()}{digits(1, 3)}.{rng.choice(['txt', 'py', 'json'])}",
        lambda: rng.choice(["_", "-", "."]).join(word() for _ in range(rng.randint(2, 4))) + rng.choice(["", digits(1, 3)]),
        lambda: word() + "".join(word().title() for _ in range(rng.randint(1, 3))) + rng.choice(["", "()", f"({word()})", f"({word()}, {digits(1, 2)})"]),
        lambda: f"{word()}-20{digits(2, 2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{digits(2, 2)}:{digits(2, 2)}Z",
        lambda: f"{rng.choice(['isbn', 'order', 'ref', 'nr', 'tel', 'call', 'card', ''])} {rng.choice(['', '+', word().upper()[:3]])}{digits(6, 16)}",
        lambda: f"{rng.choice(['version', 'v', 'ip', ''])} {digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}{rng.choice(['', '.' + digits(1, 3), '-' + word()])}",
        lambda: f"{rng.choice(['tel', 'phone', 'call', 'card'])}{rng.choice([': ', ' '])}{'-'.join(digits(3, 4) for _ in range(rng.randint(2, 4)))}",
        lambda: f"{word().upper()} {word().upper()}{rng.choice(['', '!', '?', '...'])} {rng.choice(['####', '***', '&&&&', '$$$', '----', '====', '!!!!'])}",
        lambda: f"{word()} {rng.choice(['#', '*', '|', '&', '%', '+', '->'])} {word()}{rng.choice(['', '!', '?!', '…'])}",
        lambda: f"<{rng.choice(['a', 'div', 'p', 'li'])} {rng.choice(['class', 'href', 'id'])}=\"{word()}-{word()}\">{plain(2)}</{rng.choice(['a', 'div', 'p'])}>",
        lambda: f'{{"{word()}": "{word()}", "{word()}": {digits(1, 5)}, "{word()}": ["{word()}", "{word()}"]}}',
        lambda: f"{word()}:\n  {word()}: {rng.choice([digits(1, 4), word()])}\n  {word()}: {word()}\n",
        lambda: f"{rng.choice(['la', 'el', 'le', 'der', 'die', 'the', 'das'])} {rng.choice(list(NAMES))} {rng.choice(['de', 'of', 'zu', 'von', 'for', 'a', 'du', 'in'])} {plain(rng.randint(1, 3))} {rng.choice(['is', 'ist', 'est', 'es'])} {plain(2)}",
        lambda: f"{rng.choice(['id', 'uuid', 'run'])}{parted()}{'-'.join(''.join(rng.choice('0123456789abcdef') for _ in range(n)) for n in (8, 4, 4, 4, 12))}",
    ]
    out = []
    for _ in range(count):
        text, spans = plain(rng.randint(0, 7)) + rng.choice([" ", "\n", " "]), []
        if rng.random() < 0.5:
            before, s, after = rng.choice(true)()
            text += before
            spans.append((len(text), len(text) + len(s), True))
            text += s
            if after == "" and rng.random() < 0.15 and len(s) > 15:  # in several parts
                for _ in range(rng.randint(1, 3)):
                    more = _random_secret(rng).replace(".", "a")
                    text += rng.choice([" ", "\n"])
                    spans.append((len(text), len(text) + len(more), False))
                    text += more
            text += after or ('"' if before.endswith('"') else "'" if before.endswith("'") else "")
        else:
            text += rng.choice(false)()
        text += rng.choice(["", "\n", ".", "", rng.choice(["\n", " ", ". ", "; ", ", "]) + plain(rng.randint(1, 5))])
        out.append((text, spans))
    return out


@lru_cache(maxsize=4)
def trained(lines: int = 4000, rounds: int = 4) -> Crf:
    """The field fitted on a bounded set of labelled lines; `lines` is the bound."""
    data = []
    for text, spans in training_lines(lines):
        tags = {a: 1 if begins else 2 for a, _, begins in spans}
        tokens = tokens_of(text)
        of_file = file_features(text)
        if tokens:
            data.append(([token_features(text, a, b, of_file) for a, b in tokens], [tags.get(a, 0) for a, _ in tokens], False, False))
    return Crf().fit(data, rounds)


#: What may stand before a token of prose.
USUAL = ("w", ".", ",", ";", ")", "", "o", "|")


class Field:
    """The field over all tokens of texts. A run of characters is cold if its tokens are outside in every best path wherever no
    separator, quote, unusual sign or naming word stands before it: their scores, and the most that such a place can
    add, lie below outside by what is needed. That is found once for each different run and kind of file, and kept; all other tokens
    are scored where they stand and decoded together with their neighbours."""

    HOT, NAMING, PARTING, EMPTY = 1, 2, 4, 8
    MOST = 300_000

    def __init__(self, crf: Crf) -> None:
        self.crf, self.needed, self.pair = crf, crf.needed(), crf.transitions().tolist()
        self.known: list[dict[str, int]] = [{}, {}]
        self.strings: dict[str, tuple[tuple[float, float, float], str, int]] = {}
        self.places: dict[tuple, tuple[float, float, float]] = {}
        self.parts: dict[str, list[tuple[int, int]]] = {}
        self.file = self.file_bound(False), self.file_bound(True)

    def _sum(self, names: list[str]) -> tuple[float, float, float]:
        return tuple(self.crf.unary[[_bucket(x) for x in names]].sum(axis=0).tolist())

    def _string(self, token: str) -> tuple[tuple[float, float, float], str, int]:
        found = self.strings.get(token)
        if found is None:
            found = self._sum(string_features(token)), _kind(token), min(9, len(token) // 2)
            if len(token) <= 64:
                if len(self.strings) >= self.MOST:
                    self.strings.clear()
                self.strings[token] = found
        return found

    def _place(self, key: tuple) -> tuple[float, float, float]:
        found = self.places.get(key)
        if found is None:
            found = self.places[key] = self._sum(_place_names(*key))
        return found

    def file_bound(self, code: bool) -> float:
        """The most that a file of prose, or of code, adds to begin or inside over outside."""
        files = [self._sum([f"file:assigns={a}", f"file:braces={b}"]) for a in range(4) for b in range(3) if (a < 2 and b == 0) != code]
        return max(max(x[1], x[2]) - x[0] for x in files)

    def _learn(self, raw: str, file: float, known: dict[str, int]) -> int:
        plain = PROSE.fullmatch(raw)
        if plain and plain[1].lower() not in NAMES and not plain[1].lower().endswith(NAME_ENDS):
            alike = ("x" if raw[0].islower() else "X") * min(27, len(plain[1])) + plain[2]  # has the same features
            if raw != alike:
                flag = known.get(alike)
                flag = self._learn(alike, file, known) if flag is None else flag
                if len(raw) <= 64:
                    known[raw] = flag
                return flag
        flag, words = 0, WORDS.findall(raw)
        if any(names_in(words)):
            flag |= self.NAMING
        if _edge(raw[-1:]) not in USUAL:
            flag |= self.PARTING
        parts = self._parts(raw)
        if not parts:
            flag |= self.EMPTY
        for a, b in parts:
            own, kind, size = self._string(raw[a:b])
            after = _edge(raw[b : b + 1]) if b < len(raw) else "o"
            for sep in USUAL if a == 0 else ("",):
                place = self._place((kind, size, sep, "FalseFalse", False, "", False, after, False))
                if a or max(own[1] + place[1], own[2] + place[2]) + file > own[0] + place[0] - self.needed:
                    flag |= self.HOT
        if len(raw) <= 64:
            if len(known) >= self.MOST:
                known.clear()
            known[raw] = flag
        return flag

    def _parts(self, raw: str) -> list[tuple[int, int]]:
        found = self.parts.get(raw)
        if found is None:
            found = parts_of(raw)
            if len(raw) <= 64:
                if len(self.parts) >= self.MOST:
                    self.parts.clear()
                self.parts[raw] = found
        return found

    def runs(self, text: str, of_file: list[str] | None = None) -> list[tuple[list[tuple[int, int]], list[bool], bool, bool]]:
        """Runs of neighbouring tokens that aren't known to be outside, whether a naming word may stand near each, and whether outside
        tokens stand before and after the run."""
        names = of_file or file_features(text)
        code = not (names[0] in ("file:assigns=0", "file:assigns=1") and names[1] == "file:braces=0")
        known, file = self.known[code], self.file[code]
        raws, starts = split_runs(text)
        for raw in set(raws).difference(known):
            if raw.islower() and raw.isalpha() and len(raw) < 28 and raw not in NAMES and not raw.endswith(NAME_ENDS):
                flag = known.get("x" * len(raw))
                known[raw] = self._learn("x" * len(raw), file, known) if flag is None else flag
            else:
                self._learn(raw, file, known)
        flags = list(map(known.get, raws))
        if None in flags:  # too long to be kept, or cleared since
            flags = [self._learn(raw, file, known) if f is None else f for raw, f in zip(raws, flags)]
        marked, n = [i for i, f in enumerate(flags) if f], len(raws)
        if not n:
            return []
        starts = starts()
        hot, near = set(), set()
        for i in marked:
            f = flags[i]
            if f & 1:
                hot.add(i)
            if f & 4:
                hot.add(i + 1)
            if f & 2:
                end, i = starts[i] + len(raws[i]) + NEAR, i + 1
                while i < n and starts[i] <= end:
                    near.add(i)
                    i += 1
        hot |= near
        hot.add(n - 1)
        for q in QUOTE.finditer(text):
            i = bisect_right(starts, q.start())
            if i and starts[i - 1] + len(raws[i - 1]) > q.start():
                continue  # an apostrophe within a word
            hot.update((i - 1, i) if i and starts[i - 1] + len(raws[i - 1]) == q.start() else (i,))
        # signs alone are no tokens: they neither part runs nor stand for outside
        out: list[tuple[list[tuple[int, int]], list[bool], bool, bool]] = []
        run: list[tuple[int, int]] = []
        by_name: list[bool] = []
        last = -1
        for i in sorted(hot):
            if not 0 <= i < n or flags[i] & 8:
                continue
            if run and not all(f & 8 for f in flags[last + 1 : i]):
                out.append((run, by_name, True, True))
                run, by_name = [], []
            parts = self._parts(raws[i])
            run += [(starts[i] + a, starts[i] + b) for a, b in parts]
            by_name += [i in near or len(parts) > 1 or parts[0][0] > 0] * len(parts)
            last = i
        if run:
            out.append((run, by_name, True, not all(f & 8 for f in flags[last + 1 :])))
        if out:
            run, by_name, _, after = out[0]
            first = bisect_right(starts, run[0][0]) - 1
            out[0] = run, by_name, not all(f & 8 for f in flags[:first]), after
        return out

    def scores(self, text: str, a: int, b: int, file: tuple[float, float, float], near: bool = True) -> list[float]:
        """Scores of the tags of one token where it stands: the sum of the weights of its features."""
        own, kind, size = self._string(text[a:b])
        place = self._place(place_of(text, a, b, kind, size, near))
        return [own[k] + place[k] + file[k] for k in range(3)]

    def path(self, u: list[list[float]], before: bool, after: bool) -> list[int]:
        """Crf.decode() of scores, for short runs."""
        t = self.pair
        best = [u[0][0] + before * t[0][0], u[0][1] + before * t[0][1], u[0][2] + DENIED + before * t[0][2]]
        back = []
        for own in u[1:]:
            from_ = [max(range(3), key=lambda p, x=x: best[p] + t[p][x]) for x in range(3)]
            best = [best[p] + t[p][x] + own[x] for x, p in enumerate(from_)]
            back.append(from_)
        tags = [max(range(3), key=lambda x: best[x] + after * t[x][0])]
        for from_ in reversed(back):
            tags.append(from_[tags[-1]])
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans that the field tags as secrets: from each begin to its last inside."""
        names, out = file_features(text), []
        file = self._sum(names)
        for run, near, before, after in self.runs(text, names):
            u = [self.scores(text, a, b, file, by_name) for (a, b), by_name in zip(run, near)]
            if all(max(x[1], x[2]) < x[0] - self.needed for x in u):  # cold in place
                continue
            for (a, b), tag in zip(run, self.path(u, before, after)):
                if tag == 1:
                    out.append((a, b))
                elif tag == 2:
                    out[-1] = (out[-1][0], b)
        return out


@lru_cache(maxsize=2)
def _field(crf: Crf) -> Field:
    return Field(crf)


def field_spans(text: str, crf: Crf) -> list[tuple[int, int]]:
    return _field(crf).spans(text)


def all_spans(text: str, crf: Crf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted by start and kind. A span of the field that meets a base span adds nothing."""
    base = sorted(base_spans(text), key=lambda x: (x[1], x[0]))
    reach, starts, far = -1, [], []
    for _, a, b in base:  # far[i]: the greatest end of the base spans up to i
        reach = max(reach, b)
        starts.append(a)
        far.append(reach)
    more = []
    for a, b in field_spans(text, crf):
        k = bisect_right(starts, b - 1)
        if not k or far[k - 1] <= a:
            more.append((3, a, b))
    return base, sorted(base + more, key=lambda x: (x[1], x[0]))


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs(doc_id, text).

    Offsets are code points, ends exclusive. Null and empty texts have no spans (empty string, hash of the empty string); very
    long texts are read whole, in time linear in their length. Ties between tag paths go to the smaller tags. Extra columns
    aren't read; rows repeat as they do in docs; an empty table gives no rows.
    """
    model = crf or trained()

    def make():
        def each(batch: pa.RecordBatch):
            found = [all_spans(x or "", model) for x in batch.column("text").to_pylist()]
            counts = [pa.array([sum(k == i for k, _, _ in base) for base, _ in found], pa.int64()) for i in range(3)]
            own = [pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([joined(every) for _, every in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *own], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


def redact(docs: DataFrame, crf: Crf | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by the mask and n_chars, where it exists, counted anew; null stays null."""
    model = crf or trained()

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for _, a, b in all_spans(text, model)[1]:
            if a >= at:
                parts += [text[at:a], mask]
            at = max(at, b)
        return "".join([*parts, text[at:]]) if parts else text

    def make():
        def each(batch: pa.RecordBatch):
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(map(clean, batch.column(k).to_pylist()), pa.string()))

        return each

    out = map_batches(docs, make, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
