"""Plain versions of the operators' base rules, a document at a time."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def spans(text, rules):
    """(counts, digest) of the base spans."""
    found, counts = [], []
    for k, (kind, rx, ok) in enumerate(rules):
        own = [(m.start(), k, m.end(), kind) for m in re.finditer(rx, text or "") if ok(m)]
        counts.append(len(own))
        found += own
    said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    return counts, said, hashlib.sha256(said.encode()).hexdigest()


def contamination(text, items):
    """n_words, n_hit, n_items, digest, contaminated."""
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    w = WORD.findall(low(text))
    hit, found = [0] * len(w), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if (own := windows.get(tuple(w[k : k + n]))) is not None:
                found |= {str(x) for x in own if x is not None}
                hit[k : k + n] = [1] * n
    h = sum(hit)
    return len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)


def shingle_set(text, width):
    w = TOKEN.findall(low(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def near_dup(texts, width=2):
    """{id: (set size, component)} of {id: text}."""
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = TOKEN.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if TOKEN.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    rep = {j for v in at.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n


PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = WORD.findall(low(text))
    at, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
