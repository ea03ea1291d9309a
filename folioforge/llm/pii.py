"""Personal data by a semi-Markov conditional random field (operator 1).

The base spans come from their patterns. Candidate segments of up to MAX_TOKENS tokens are scored with
features of the entire span, and a dynamic program over segments picks boundaries and types together;
its spans that overlap no base span are added. A segment can only be an entity if it holds a cue: a run
of two digits or more, "at" in brackets, or "at" with "dot". Stretches further from a cue than a segment
and its features reach are therefore left out without changing the best segmentation. Weights are
fitted here, by exact likelihood gradients, on sentences from a small generator (no corpus text, so
every run fits the same model).

Null text counts as empty. Every row is judged on its own, so repeated rows get equal results, and rows
without a doc_id too. Of base spans that begin together the kind that stands first in KINDS comes first;
of segmentations that score alike the one of the shorter last segment is taken. An empty table gives no
rows. Columns other than doc_id and text are not read. Time is linear in the length of a text: no pattern
can rescan a long run, and no token is too long for a segment.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import textscan as ts

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the model adds: spelt-out addresses, numbers without a plus sign, account and social numbers.
MODEL_KINDS = ("email_text", "phone_local", "iban", "ssn")
ALL_KINDS = KINDS + MODEL_KINDS
#: Tokens of a segment at most, and what its features see on either side of it beside.
MAX_TOKENS, CONTEXT = 16, 2
#: Segment ends that are scored at a time, which bounds the memory that a text takes.
PIECE = 4096

Span = tuple[int, int, str]
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def _emails(t: str) -> list[Span]:
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        begin = max(end, t.rfind("@", end, at) + 1)
        start = begin + len(t[begin:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((start, m.end(), "email"))
            end = m.end()
            at = t.find("@", end)
        else:
            at = t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[Span]:
    """Spans of the base patterns in code points, by start and then by kind."""
    out = _emails(t) if "@" in t else []
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(t):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], ALL_KINDS.index(s[2])))
    return out


# --- the model

#: Where a segment that can be an entity has its digits, its bracketed "at", or its "dot".
_CUE = re.compile(r"[0-9]{2,}|[\[(]\s*(?i:at)\s*[\])]|(?<![^\W\d_])(?i:dot)(?![^\W\d_])")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_WORDS = {w: k for k, w in enumerate(("at", "dot", "tel", "phone", "call", "fax", "mobile", "ssn", "social", "iban", "account", "mail", "email", "reach", "version", "page", "year", "com", "org", "net"), 16)}
_PUNCT = {c: k for k, c in enumerate(".,-()[]+@:/_", 4)}
N_CLASS = 16 + len(_WORDS)


def token_class(tok: str) -> int:
    c = tok[0]
    if c.isdecimal() and c.isascii():
        return 0
    if (k := _WORDS.get(tok.lower())) is not None:
        return k
    if c.isalpha():
        return 1 if c.isupper() and tok.isupper() and len(tok) == 2 else 2
    return _PUNCT.get(c, 3)


class Windows:
    """Tokens of some stretches of text, in arrays; `begin` and `owner` have the first token and the text of each stretch."""

    def __init__(self) -> None:
        self.cls, self.length, self.gap = array("b"), array("b"), array("b")  # gap: white space before a token
        self.start, self.end = array("q"), array("q")
        self.begin: list[int] = []
        self.owner: list[int] = []

    def __len__(self) -> int:
        return len(self.cls)

    def add(self, owner: int, text: str, a: int, b: int) -> None:
        self.begin.append(len(self.cls))
        self.owner.append(owner)
        last = a
        for m in _TOKEN.finditer(text, a, b):
            i, k = m.span()
            self.cls.append(token_class(m[0]))
            self.length.append(min(k - i, 40))
            self.gap.append(min(i - last, 2))
            self.start.append(i)
            self.end.append(k)
            last = k

    def owner_of(self, token: int) -> int:
        return self.owner[bisect_right(self.begin, token) - 1]


_DIGIT_BINS = np.digitize(np.arange(200), [1, 3, 5, 7, 9, 10, 11, 12, 14, 16, 17, 20, 23])  # 14 bins
_FEW = np.minimum(np.arange(800), 5)
#: Sizes of the whole-span features' tables.
FEATURES = {"tokens": MAX_TOKENS + 1, "digits": 14, "letters": 8, "first": N_CLASS * 6, "last": N_CLASS * 6, "before": N_CLASS + 1, "before2": N_CLASS + 1, "after": N_CLASS + 1, "dots": 6, "dashes": 6, "brackets": 6, "gaps": 6, "at": 6, "dot_words": 6, "at_words": 6, "groups": 6, "code": 2, "longest": 12, "glued": 4}
OFFSETS = dict(zip(FEATURES, np.cumsum([0, *list(FEATURES.values())[:-1]]), strict=True))
N_FEATURES = sum(FEATURES.values())
LABELS = ("outside", *MODEL_KINDS)


def segments(w: Windows, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end (exclusive), feature rows and whether it holds a cue, of every single token and every longer segment with a cue
    that end after token `low` and not after `high`; ordered by end and then by length."""
    high = len(w) if high is None else high
    lo, hi = max(0, low - MAX_TOKENS - CONTEXT), min(len(w), high + 1)  # all that their features see
    n = hi - lo
    cls, length, gap = (np.array(x[lo:hi], np.int64) for x in (w.cls, w.length, w.gap))
    window = np.searchsorted(w.begin, np.arange(lo, hi), side="right")
    start_of, end_of = np.searchsorted(window, window), np.searchsorted(window, window, side="right")
    end = np.repeat(np.arange(low + 1, high + 1) - lo, MAX_TOKENS)
    size = np.tile(np.arange(1, MAX_TOKENS + 1), high - low)
    start = end - size
    ok = start >= np.maximum(start_of[end - 1], 0)
    start, end, size = start[ok], end[ok], size[ok]
    cum = lambda x: np.concatenate(([0], np.cumsum(x)))
    span = lambda c: c[end] - c[start]
    digit, letter = cls == 0, (cls == 1) | (cls == 2) | (cls >= 16)
    digits, letters = span(cum(np.where(digit, length, 0))), span(cum(np.where(letter, length, 0)))
    # only segments that hold a cue can be entities
    at_word, bracket = cls == _WORDS["at"], (cls >= _PUNCT["("]) & (cls <= _PUNCT["]"])
    enclosed = np.zeros(n, bool)
    enclosed[1:-1] = at_word[1:-1] & bracket[:-2] & bracket[2:] & (window[:-2] == window[2:])
    able = (span(cum(digit & (length >= 2))) > 0) | (span(cum(enclosed)) > 0) | ((span(cum(at_word)) > 0) & (span(cum(cls == _WORDS["dot"])) > 0))
    used = able | (size == 1)
    start, end, size, digits, letters, able = start[used], end[used], size[used], digits[used], letters[used], able[used]
    few = lambda m: _FEW[np.minimum(span(cum(m)), 700)]
    bucket = np.minimum(np.digitize(length, [2, 3, 4, 5, 8]), 5)
    near = lambda i, ok: np.where(ok, cls[np.clip(i, 0, n - 1)], N_CLASS)
    inner_gaps = cum(gap > 0)
    first_dig = np.where(digit[start], length[start], 0)
    cols = {
        "tokens": size, "digits": _DIGIT_BINS[np.minimum(digits, 199)], "letters": np.minimum(np.digitize(letters, [1, 2, 3, 6, 12, 24, 40]), 7),
        "first": cls[start] * 6 + bucket[start], "last": cls[end - 1] * 6 + bucket[end - 1],
        "before": near(start - 1, start > start_of[start]), "before2": near(start - 2, start - 1 > start_of[start]), "after": near(end, end < end_of[end - 1]),
        "dots": few(cls == _PUNCT["."]), "dashes": few(cls == _PUNCT["-"]), "brackets": few(bracket), "gaps": np.minimum(inner_gaps[end] - inner_gaps[start + 1], 5),
        "at": few(cls == _PUNCT["@"]), "dot_words": few(cls == _WORDS["dot"]), "at_words": few(cls == _WORDS["at"]), "groups": few(digit),
        "code": (cls[start] == 1).astype(np.int64), "longest": np.minimum(first_dig, 11), "glued": np.minimum(((start > start_of[start]) & (gap[start] == 0)).astype(np.int64) + 2 * ((end < end_of[end - 1]) & (gap[np.minimum(end, n - 1)] == 0)), 3),
    }
    return start + lo, end + lo, np.stack([cols[k] + OFFSETS[k] for k in FEATURES], axis=1), able


def _scores(feats: np.ndarray, start: np.ndarray, end: np.ndarray, able: np.ndarray, weights: np.ndarray) -> np.ndarray:
    s = weights[feats].sum(axis=1)
    s[end - start > 1, 0] = -np.inf  # the outside comes in single tokens
    s[~able, 1:] = -np.inf
    return s


def viterbi(w: Windows, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation: (first token, end token, label) of its entities. PIECE ends are scored at a time."""
    n = len(w)
    best, came, said = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int8)
    for low in range(0, n, PIECE):
        high = min(n, low + PIECE)
        start, end, feats, able = segments(w, low, high)
        s = _scores(feats, start, end, able, weights)
        label = s.argmax(axis=1)
        top = s[np.arange(len(s)), label]
        upto = np.searchsorted(end, np.arange(low + 1, high + 2)).tolist()
        for e, a, b in zip(range(low + 1, high + 1), upto, upto[1:], strict=False):
            x = best[start[a:b]] + top[a:b]
            k = int(x.argmax())
            best[e], came[e], said[e] = x[k], start[a + k], label[a + k]
    out, e = [], n
    while e > 0:
        if said[e]:
            out.append((int(came[e]), e, int(said[e])))
        e = int(came[e])
    return out[::-1]


def gradient(w: Windows, gold: list[tuple[int, int, int]], weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the log-likelihood of a window's gold segments, and the log-likelihood."""
    start, end, feats, able = segments(w)
    s = _scores(feats, start, end, able, weights)
    n = len(w)
    total = np.logaddexp.reduce(s, axis=1)
    upto = np.searchsorted(end, np.arange(n + 2))
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    for e in range(1, n + 1):
        a, b = upto[e], upto[e + 1]
        alpha[e] = np.logaddexp.reduce(alpha[start[a:b]] + total[a:b])
    for e in range(n, 0, -1):
        a, b = upto[e], upto[e + 1]
        np.logaddexp.at(beta, start[a:b], beta[e] + total[a:b])
    p = np.exp(alpha[start][:, None] + s + beta[end][:, None] - alpha[n])
    want = np.zeros_like(p)
    key = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(start, end, strict=True))}
    inside = np.zeros(n, bool)
    score = 0.0
    for a, b, label in gold:
        want[key[a, b], label] = 1
        inside[a:b] = True
        score += s[key[a, b], label]
    for i in np.flatnonzero(~inside):
        want[key[int(i), int(i) + 1], 0] = 1
        score += s[key[int(i), int(i) + 1], 0]
    diff = want - p
    grad = np.zeros_like(weights)
    for c in range(feats.shape[1]):
        for k in range(weights.shape[1]):
            grad[:, k] += np.bincount(feats[:, c], weights=diff[:, k], minlength=len(weights))
    return grad, score - alpha[n]


def _sentence(r: random.Random) -> list[tuple[str, str]]:
    """Pieces of a made-up sentence with the label of each."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.choice([1, 2, 2, 3, 3, 4, 4, 6, 20])))
    filler = lambda: r.choice([word(), word(), word(), word() + r.choice(".,"), "the", "and"])
    capitals = lambda n: "".join(r.choice("ABCDEFGHKLMNPRSTW") for _ in range(n))

    def entity() -> tuple[str, str]:
        kind = r.choice(MODEL_KINDS)
        if kind == "email_text":
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" (at) ", "."), ("(at)", ".")])
            local = r.choice([word(), word(), r.choice("abcdefgh") + "." + word(), word() + "." + word(), word() + d(2), word() + "_" + word(), word() + "-" + word()])
            host = word() if r.random() < 0.8 else word() + r.choice([dot, "-"]) + word()
            return local + at + host + dot + r.choice(["com", "org", "net", "de", "edu", "fr", "info"]), kind
        if kind == "phone_local":
            return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"({d(3)}) {d(3)} {d(4)}"]), kind
        if kind == "iban":
            code = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"]) + d(2)
            body = r.choice([d(r.choice([14, 18, 20, 22])), capitals(4) + d(r.choice([10, 14])), d(16) + capitals(1) + d(6), capitals(1) + d(22)])
            return code + (" " + " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if r.random() < 0.5 else body), kind
        return f"{d(3)}-{d(2)}-{d(4)}", kind

    def decoy() -> str:
        hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40])))
        return r.choice([d(1), d(2), d(4), d(r.randint(5, 12)), d(16), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)}.{d(1)}", f"version {d(1)}.{d(1)}.{d(2)}", f"{d(2)}.{d(2)}.{d(3)}.{d(2)}", hexes, f"{d(3)},{d(3)}", f"page {d(3)}", f"at {word()} the", f"AKIA{d(4)}{word().upper()}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{word()}{d(2)}@{word()}.com", f"{d(4)}-{d(4)}", f"{d(2)} {d(2)} {d(2)}", f"isbn {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}"])

    out: list[tuple[str, str]] = []
    for _ in range(r.randint(1, 3)):
        out += [(filler(), "") for _ in range(r.randint(2, 5))]
        if r.random() < 0.5:
            out.append((r.choice(["tel", "phone:", "call", "ssn", "IBAN", "account", "mail", "email:", "reach"]), ""))
        out.append(entity() if r.random() < 0.55 else (decoy(), ""))
    return [*out, *[(filler(), "") for _ in range(r.randint(1, 4))]]


def example(r: random.Random) -> tuple[Windows, list[tuple[int, int, int]]]:
    """A made-up window with the segments that stand in it."""
    text, spans = "", []
    for piece, kind in _sentence(r):
        text += " " if text else ""
        if kind:
            spans.append((len(text), len(text) + len(piece), LABELS.index(kind)))
        text += piece
    w = Windows()
    w.add(0, text, 0, len(text))
    gold = [(bisect_left(w.start, a), bisect_left(w.end, b) + 1, k) for a, b, k in spans]
    return w, [g for g in gold if g[1] - g[0] <= MAX_TOKENS]


@lru_cache(maxsize=2)
def fit(examples: int = 300, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (feature, label), by AdaGrad on the exact log-likelihood."""
    r = random.Random(seed)
    data = [example(r) for _ in range(examples)]
    weights, square = np.zeros((N_FEATURES, len(LABELS))), np.full((N_FEATURES, len(LABELS)), 1e-2)
    for _ in range(epochs):
        for k in range(0, len(data), 10):
            g = sum(gradient(w, gold, weights)[0] for w, gold in data[k : k + 10]) / 10 - 1e-4 * weights
            square += g * g
            weights += 0.3 * g / np.sqrt(square)
    return weights


def _before(t: str, floor: int, at: int, n: int) -> int:
    """Where the n-th token before `at` begins; floor if there are fewer."""
    reach = 8 * n
    while True:
        low = max(floor, at - reach)
        begins = [m.start() for m in _TOKEN.finditer(t, low, at)]
        if low > floor and begins and begins[0] == low:  # it may begin further left
            begins.pop(0)
        if len(begins) >= n:
            return begins[-n]
        if low == floor:
            return floor
        reach *= 4


def _after(t: str, at: int, n: int) -> int:
    """Where the n-th token from `at` ends; the end of the text if there are fewer."""
    for k, m in enumerate(_TOKEN.finditer(t, at), 1):
        if k == n:
            return m.end()
    return len(t)


def stretches(t: str) -> list[tuple[int, int]]:
    """The parts of a text, from token to token, that hold every segment with a cue and what its features see."""
    out: list[tuple[int, int]] = []
    n = MAX_TOKENS - 1 + CONTEXT
    for m in _CUE.finditer(t):
        floor = out[-1][1] if out else 0
        if m.end() < floor and _CUE.search(t, m.end(), floor):
            continue  # a later cue of the same stretch carries it on
        low, high = _before(t, floor, m.start(), n) if m.start() > floor else floor, _after(t, m.end(), n)
        if out and low <= floor:
            out[-1] = (out[-1][0], max(floor, high))
        else:
            out.append((low, high))
    return out


def model_spans(texts: list[str], base: list[list[Span]], weights: np.ndarray) -> list[list[Span]]:
    """The model's spans of each text that overlap no base span."""
    w = Windows()
    for k, t in enumerate(texts):
        for a, b in stretches(t):
            w.add(k, t, a, b)
    out: list[list[Span]] = [[] for _ in texts]
    if not len(w):
        return out
    covers: dict[int, list[tuple[int, int]]] = {}
    for a, e, label in viterbi(w, weights):
        k, x, y = w.owner_of(a), w.start[a], w.end[e - 1]
        if LABELS[label] == "iban" and not _iban(texts[k][x:y]):
            continue
        cover = covers.get(k)
        if cover is None:
            cover = covers[k] = _union(base[k])
        i = bisect_left(cover, (y, 0))
        if not i or cover[i - 1][1] <= x:
            out[k].append((x, y, LABELS[label]))
    return out


def _iban(span: str) -> bool:
    """Whether the check digits of an account number are right."""
    s = re.sub(r"[^0-9A-Za-z]", "", span).upper()
    return s.isascii() and len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _union(spans: list[Span]) -> list[tuple[int, int]]:
    """Disjoint stretches that cover the spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(texts: list[bytes | None], weights: np.ndarray) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text."""
    read = [(t or b"").decode("utf-8", "replace") for t in texts]
    base = [base_spans(t) for t in read]
    more = model_spans(read, base, weights)
    return base, [sorted(a + b, key=lambda s: (s[0], ALL_KINDS.index(s[2]))) for a, b in zip(base, more, strict=True)]


def digest(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan_pii(docs: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and all spans, of each row."""
    weights = fit()

    def block(part, texts):
        base, both = scan(texts, weights)
        return {"doc_id": part.column(0), "base_sha256": [hashlib.sha256(digest(x).encode()).hexdigest() for x in base], "spans": [digest(x) for x in both]} | {f"n_{k}": np.array([sum(s[2] == k for s in x) for x in base], np.int64) for k in KINDS}

    return ts.map_blocks(docs, block, SCHEMA)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(ts.table(spark, sf_dir, "documents"))
