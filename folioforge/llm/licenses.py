"""Licence scans by template-markup matching (operator 9).

Templates (`templates.py`) are compiled into automata over words: mandatory words, optional
regions that may be left out, and replaceable regions of up to n words. The automata of all
templates and the four base phrases run together as one set of states, started only where a word
stands that some template can begin with and, for its mandatory opening, only where the next
mandatory word follows. A text gets a template's label where some run reaches its end. A template
that ends in `<<id>>` names licences by an expression: each identifier of the expression that follows on its line makes a label. Of
licence texts of which one is within another only the longer counts.

Null text counts as empty: no words, no labels, score 0. Each row is judged on its own, so
repeated rows get equal results, and rows without a doc_id too. Where a template's runs end in several
places the longest counts. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import textscan as ts
from .templates import TEMPLATES

#: Base phrases and their labels.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
#: More words than any template matches.
LONGEST = 2_000
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_BEFORE = re.compile(rb"[\x20\t:=\"']*+")
_PIECE = re.compile(rb"[\x20\t]*+(?:(?P<open>\()|(?P<close>\))|(?P<op>AND|OR|WITH)(?![0-9A-Za-z.+:-])|(?P<id>[0-9A-Za-z][0-9A-Za-z.+:-]*+))")


def identifiers(text: bytes) -> list[str]:
    """The licences of the expression that a text begins with: identifiers joined by AND, OR and parentheses, each with its exception.

    The expression ends where the text no longer goes on as one; it stays on its line.
    """
    at, depth, out, wants, excepted = _BEFORE.match(text).end(), 0, [], True, False
    while m := _PIECE.match(text, at):
        if m["open"] and wants and not excepted:
            depth += 1
        elif m["close"] and not wants and depth:
            depth -= 1
        elif m["op"] and not wants:
            wants, excepted = True, m["op"] == b"WITH"
        elif m["id"] and wants:
            name = m["id"].decode().rstrip(".-:").lower()
            if excepted:
                out[-1] += f" with {name}"
            else:
                out.append(name)
            wants = excepted = False
        else:
            break
        at = m.end()
    return out


class Automaton:
    """Word automata of some templates, run as one.

    A state is (template, position); `edges[s]` maps a word to a state, `free[s]` is the state after any
    word, and `skip[s]` lists the states reached without a word.
    """

    def __init__(self, templates: dict[str, str]):
        self.edges: list[dict[str, int]] = []
        self.free: list[int | None] = []
        self.skip: list[list[int]] = []
        self.final: dict[int, str] = {}
        self.begin: dict[str, list[int]] = {}
        #: labels of templates that end in an identifier
        self.named = {label for label, markup in templates.items() if markup.endswith("<<id>>")}
        for label, markup in templates.items():
            start = self._compile(label, markup.removesuffix("<<id>>"))
            for s in self.closure([start]):
                for word in self.edges[s]:
                    self.begin.setdefault(word, []).append(start)

    def _state(self) -> int:
        self.edges.append({})
        self.free.append(None)
        self.skip.append([])
        return len(self.edges) - 1

    def _compile(self, label: str, markup: str) -> int:
        start = at = self._state()
        opened: list[int] = []
        for part in re.split(r"(<<[^>]*>>)", markup):
            if part == "<<optional>>":
                opened.append(at)
                at, before = self._state(), at
                self.skip[before].append(at)
            elif part == "<<end>>":
                after = self._state()
                self.skip[at].append(after)
                self.skip[opened.pop()].append(after)
                at = after
            elif m := re.fullmatch(r"<<any (\d+)>>", part):
                after = self._state()
                self.skip[at].append(after)
                for _ in range(int(m[1])):
                    nxt = self._state()
                    self.free[at] = nxt
                    self.skip[nxt].append(after)
                    at = nxt
                at = after
            else:
                for word in _WORD.findall(part.lower()):
                    nxt = self._state()
                    self.edges[at][word] = nxt
                    at = nxt
        if opened:
            raise ValueError(f"{label}: an optional region isn't ended")
        self.final[at] = label
        return start

    @lru_cache(maxsize=65_536)  # noqa: B019  one automaton lives as long as its worker
    def _closed(self, states: tuple[int, ...]) -> tuple[int, ...]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return tuple(sorted(seen))

    def closure(self, states) -> tuple[int, ...]:
        return self._closed(tuple(sorted(states)))

    def run(self, words, k: int, starts: list[int]) -> dict[str, int]:
        """Templates accepted from word k on, and the word after the longest acceptance of each."""
        live, found = self.closure(starts), {}
        while live:
            for s in live:
                if s in self.final:
                    found[self.final[s]] = k
            if k >= len(words):
                break
            word, nxt = words[k], set()
            for s in live:
                if (t := self.edges[s].get(word)) is not None:
                    nxt.add(t)
                if (t := self.free[s]) is not None:
                    nxt.add(t)
            live = self.closure(nxt) if nxt else ()
            k += 1
        return found


class _Lazy:
    """Words of a document, read where they are asked for."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        base = {f"base:{k}": v for k, v in PHRASES.items()}
        self.automaton = Automaton(base | (TEMPLATES if templates is None else templates))
        #: hashes of the words that some run can begin with
        data, off = ts.join_texts([w.encode() for w in self.automaton.begin])
        w = ts.Words(data, off, ts.ALNUM, fold=False)
        self.openers = dict(zip(w.hashes().tolist(), self.automaton.begin, strict=True))
        self.keys = np.sort(np.array(list(self.openers), np.uint64))
        # what may follow an opener; runs start only where one of these does
        self.follow: dict[str, set[str] | None] = {}
        for word, starts in self.automaton.begin.items():
            nxt: set[str] | None = set()
            for s in self.automaton.closure(starts):
                if (t := self.automaton.edges[s].get(word)) is not None:
                    for u in self.automaton.closure([t]):
                        nxt = None if nxt is None or self.automaton.free[u] is not None or u in self.automaton.final else nxt | set(self.automaton.edges[u])
            self.follow[word] = nxt

    def scan(self, texts: list[bytes | None]) -> dict[str, list]:
        """The columns of the contract for each text."""
        data, off = ts.join_texts(texts)
        w = ts.Words(data, off, ts.ALNUM, fold=True)
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[at] == h)
        doc = np.searchsorted(w.first[1:], places, side="right")
        base: list[list[int]] = [[] for _ in texts]
        kinds: list[set[str]] = [set() for _ in texts]
        own: list[set[str]] = [set() for _ in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        whole: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for k, d in zip(places.tolist(), doc.tolist(), strict=True):
            word, a, b = self.openers[int(h[k])], int(w.first[d]), int(w.first[d + 1])
            words = _Lazy(w.data, w.starts[a:b], w.ends[a:b])
            k -= a
            if words[k] != word or (self.follow[word] is not None and (k + 1 >= len(words) or words[k + 1] not in self.follow[word])):
                continue
            for label, end in self.automaton.run(words, k, self.automaton.begin[word]).items():
                spans[d].append((k, end))
                if label in self.automaton.named:
                    stop = int(w.ends[a + end - 1])
                    line = data[stop : off[d + 1]]
                    line = line[: int(np.argmax(line == 10))]  # a block ends each text with a line feed
                    own[d] |= {f"{label}:{name}" for name in identifiers(line.tobytes())}
                elif label.startswith("base:"):
                    base[d].append(k)
                    kinds[d].add(label[5:])
                elif label.startswith("text:"):
                    whole[d].append((k, end, label))
                else:
                    own[d].add(label)
        for d, found in enumerate(map(sorted, whole)):
            own[d] |= {label for a, b, label in found if not any(x <= a and b <= y and y - x > b - a for x, y, _ in _around(found, a))}
        return {
            "n_words": w.counts.tolist(), "n_base": [len(x) for x in base], "first_word": [min(x, default=None) for x in base], "last_word": [max(x, default=None) for x in base],
            "base_labels": [",".join(sorted(x)) for x in kinds], "labels": [",".join(sorted(x | y)) for x, y in zip(kinds, own, strict=True)],
            "score": [_covered(x) / n if n else 0.0 for x, n in zip(spans, w.counts.tolist(), strict=True)],
        }


def _around(found: list[tuple[int, int, str]], at: int) -> list[tuple[int, int, str]]:
    """Matches, by where they begin, that may hold one that begins at a word: no template matches more than LONGEST words."""
    return found[bisect_left(found, (at - LONGEST,)) : bisect_right(found, (at, 1 << 60))]


def _covered(spans: list[tuple[int, int]]) -> int:
    """Words in any of the spans."""
    total = upto = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Places of base phrases, labels, and the share of words that matched wording covers, for each row of docs."""
    import pyarrow as pa

    held: list[Scanner] = []
    longs = {"n_words", "n_base", "first_word", "last_word"}

    def block(part, texts):
        if not held:
            held.append(Scanner(templates))
        found = held[0].scan(texts)
        return {"doc_id": part.column(0)} | {k: pa.array(v, pa.int64() if k in longs else pa.float64() if k == "score" else pa.string()) for k, v in found.items()}

    return ts.map_blocks(docs, block, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(ts.table(spark, sf_dir, "documents"))


