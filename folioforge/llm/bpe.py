"""Byte-level BPE by a lazily determinised transducer (operator 6).

Encoding. A token sequence is what the merges make exactly when each token is what the merges make
of its own bytes and each neighbouring pair is what they make of its joint bytes. So each prefix of
a piece has one last token, and the encoding of a longer prefix passes only through prefixes from
which the bytes read since still begin some token. A state of the transducer holds, for those live
prefixes, the tokens since the last one that all of them agree on; reading a byte extends each live
prefix in the vocabulary's trie, picks the token that ends here, drops dead prefixes and emits the
tokens that have become common. Transitions are made where they are needed again and kept, up to
MAX_STATES states; the lookahead is bounded by the longest token. So a piece of any length costs a step
for each byte, unlike merging, whose cost grows faster than the piece.

Decoding is an incremental machine over UTF-8 states, fed with any chunks of bytes; it hands out
whole characters as soon as they end and replaces what isn't UTF-8 as Python's decoder does. Texts
are decoded through it, DECODE tokens at a time.

Null text counts as empty: no tokens. Every row is judged on its own, so repeated rows get equal
results, and rows without a doc_id too. Lone surrogates can't occur in Spark's strings. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import textscan as ts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: What a worker's tables hold at most; what goes is made anew where it is met again.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 60_000, 200_000, 200_000
#: Tokens that are decoded at a time.
DECODE = 4096


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges make of a piece: the lowest-ranked neighbouring pair joins first, leftmost on a tie."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min(((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


#: A live prefix: the trie node of the bytes after it, and its tokens since the common one.
Live = tuple[int, tuple[int, ...]]


class Transducer:
    """Encoder of pieces; tables grow as they are needed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        #: the trie: the node after a node and a byte, the token that ends at a node, whether a node has more below it
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], bytearray([1])
        for raw, rank in ranks.items():
            node = 0
            for b in raw:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = nxt
            self.ends[node] = rank
        self._made: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        #: (last common token or -1, live prefixes); the first state has the empty prefix only
        self.states: dict[tuple[int, tuple[Live, ...]], int] = {}
        self.keys: list[tuple[int, tuple[Live, ...]]] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.missed: set[int] = set()
        self._state((-1, ((0, ()),)))

    def _state(self, key: tuple[int, tuple[Live, ...]]) -> int:
        k = self.states.get(key)
        if k is None:
            k = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return k

    def made(self, token: int) -> bool:
        """Whether the merges make the token of its own bytes."""
        ok = self._made.get(token)
        if ok is None:
            raw = self.token[token]
            ok = self._made[token] = merge(raw, self.ranks) == [raw]
        return ok

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; none for a single byte."""
        if token not in self._halves:
            raw = self.token[token]
            parts = merge(raw, {k: v for k, v in ((raw[i:j], self.ranks.get(raw[i:j])) for i in range(len(raw)) for j in range(i + 2, len(raw) + 1)) if v is not None and k != raw} | {raw[i : i + 1]: 0 for i in range(len(raw))}) if len(raw) > 1 else []
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the two tokens as neighbours.

        Seen backwards in time: the parts at the seam are undone, the later-made one first, and at no
        moment may they have had a merge that comes before the merges that took them up.
        """
        ok = self._fits.get(a << 32 | b)
        if ok is None:
            if len(self._fits) > MAX_PAIRS:
                self._fits.clear()
            ok = self._fits[a << 32 | b] = self._apart(a, b)
        return ok

    def _apart(self, a: int, b: int) -> bool:
        taken_a = taken_b = 1 << 60  # rank of the merge that takes the part up
        while True:
            joint = self.ranks.get(self.token[a] + self.token[b])
            if joint is not None and joint < taken_a and joint <= taken_b:
                return False
            x, y = self.halves(a), self.halves(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and a > b):
                a, taken_a = x[1], a
            else:
                b, taken_b = y[0], b

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte, and the tokens it emits."""
        last, live = self.keys[state]
        grown: list[Live] = []
        here: tuple[int, ...] | None = None
        for node, tokens in live:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.ends[nxt]
            if here is None and token >= 0 and self.made(token):
                before = tokens[-1] if tokens else last
                if before < 0 or self.fits(before, token):
                    here = (*tokens, token)
            if self.inner[nxt]:
                grown.append((nxt, tokens))
        if here is None:
            raise ValueError("the vocabulary lacks a single byte")
        grown.append((0, here))
        common = 0
        shortest = min(len(t) for _, t in grown)
        while common < shortest and len({t[common] for _, t in grown}) == 1:
            common += 1
        out = grown[0][1][:common]
        if common:
            last, grown = out[-1], [(n, t[common:]) for n, t in grown]
        found = (self._state((last, tuple(grown))), out)
        self.steps[state][byte] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a piece. As the library does, a piece that is a token is that token.

        Kept transitions are followed as far as they go; the rest of the piece runs over the live
        prefixes themselves. A transition is made and kept when it is missed for the second time, so
        the table grows along prefixes that come again.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out: list[int] = []
        state, steps, at = 0, self.steps, 0
        for byte in piece:
            found = steps[state].get(byte)
            if found is None:
                miss = state << 8 | byte
                if miss in self.missed and len(self.keys) < MAX_STATES:
                    self.step(state, byte)
                elif len(self.keys) < MAX_STATES:
                    if len(self.missed) > MAX_PAIRS:
                        self.missed.clear()
                    self.missed.add(miss)
                return out + self._rest(state, piece[at:])
            state = found[0]
            if found[1]:
                out += found[1]
            at += 1
        # the whole piece is the prefix that ends here
        return out + list(self.keys[state][1][-1][1])

    def _rest(self, state: int, rest: bytes) -> list[int]:
        """The tokens after those emitted up to a state, for the last bytes of a piece."""
        last, live = self.keys[state]
        begin = (last, None)
        paths = []  # trie node, and the tokens before it as a list linked backwards
        for node, tokens in live:
            chain = begin
            for t in tokens:
                chain = (t, chain)
            paths.append((node, chain))
        child, ends, inner, known, made = self.child.get, self.ends, self.inner, self._fits.get, self._made.get
        for byte in rest:
            here, grown = None, []
            for node, chain in paths:
                nxt = child(node << 8 | byte)
                if nxt is None:
                    continue
                if here is None and (t := ends[nxt]) >= 0:
                    before = chain[0]
                    ok = known(before << 32 | t) if before >= 0 else True
                    if (ok or (ok is None and self.fits(before, t))) and (made(t) or self.made(t)):
                        here = (t, chain)
                if inner[nxt]:
                    grown.append((nxt, chain))
            grown.append((0, here))
            paths = grown
        out, chain = [], paths[-1][1]
        while chain is not begin:
            out.append(chain[0])
            chain = chain[1]
        return out[::-1]


class Utf8Machine:
    """Incremental UTF-8 decoding: feed bytes, get the characters that have ended."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _need(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        keep = 0
        # at most three last bytes can begin a character that hasn't ended
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b >= 0xC0:
                keep = k if self._need(b) > k and self._alive(data[-k:]) else 0
                break
            if b < 0x80:
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _alive(part: bytes) -> bool:
        """Whether the bytes can begin a character: bounds of the second byte depend on the first."""
        if len(part) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(part[0], (0x80, 0xBF))
        return low <= part[1] <= high and all(0x80 <= b <= 0xBF for b in part[2:])

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.raw = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.raw[rank] = raw
        self.written = [str(k) for k in range(len(self.raw))]
        #: pieces met lately, and those of the turn before
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) >= MAX_PIECES:  # those not met again since the last turn go
            self.older, self.pieces = self.pieces, {}
        pieces, older, out = self.pieces, self.older, []
        for p in self.split(text):
            ids = pieces.get(p)
            if ids is None:
                ids = older.get(p) or tuple(self.transducer.encode(p.encode()))
                if len(p) < 64:
                    pieces[p] = ids
            out += ids
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of token ids that arrive in chunks, character by whole character."""
        machine = Utf8Machine()
        for ids in chunks:
            if text := machine.feed(self.decode_bytes(ids)):
                yield text
        if text := machine.end():
            yield text


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=1)
def make(ranks_path: str | None = None) -> Tokenizer:
    """The tokenizer of a rank file; one is kept for a worker's life, with the tables that it has grown."""
    import public_tokenizers

    return Tokenizer(read_ranks(ranks_path or vocabulary_path()), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and ids, the token ids, of each row. `ranks_path` is a file that every machine has."""

    def block(part, texts):
        own = make(ranks_path)
        ids = [own.encode((t or b"").decode("utf-8", "replace")) for t in texts]
        return {"doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return ts.map_blocks(docs, block, "doc_id long, ids array<int>")


def round_trips(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes decoded from them, of each row."""

    def block(part, texts):
        own = make(ranks_path)
        n, ids_hash, text_hash = [], [], []
        for t in texts:
            ids = own.encode((t or b"").decode("utf-8", "replace"))
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(own.written.__getitem__, ids)).encode()).hexdigest())
            decoded = hashlib.sha256()
            for said in own.decode_stream(ids[k : k + DECODE] for k in range(0, len(ids), DECODE)):
                decoded.update(said.encode())
            text_hash.append(decoded.hexdigest())
        return {"doc_id": part.column(0), "n_tokens": np.array(n, np.int64), "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    return ts.map_blocks(docs, block, SCHEMA)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(ts.table(spark, sf_dir, "documents"))
