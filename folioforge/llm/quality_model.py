"""Quality classifier: a generalised additive model with pairwise interactions (operator 7).

Each whole text becomes a few measures. Each measure is cut into bins at training quantiles, of all
values and of those above the least one (most texts share the least of many measures), and has a
lookup table of additions to the logit; so has each chosen pair of measures, on COARSE joined bins each.
Tables are learnt by cyclic boosting: in each round every measure in turn gets a shallow tree on the
current residuals, whose leaves are added to its table at a low rate; then the pairs with the most to
explain are chosen on the residuals and boosted alike. Scoring is one addition per table.

Only labelled rows outside the held-out quarter train it, at most SAMPLE of them (in an order given
by a hash of doc_id, so any copy of the data gives the same sample). Every text is scored; a null
or empty text has all measures 0. Without labels of both kinds every score is 0.5. Repeated rows get
equal scores, and rows without a doc_id are scored too; a repeated label of a document counts once, the
greatest; null labels are left out; a value that equals an edge belongs to the bin above it. An empty
table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .quality_rules import measure, repeated
from .toxicity import held_out

SAMPLE, BINS, COARSE, PAIRS = 20_000, 32, 8, 6
THRESHOLD = 0.7
MEASURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "pipes", "digits", "shouts", "stops", "words_a_line", "distinct", "one_letter", "not_ascii")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_DIGITS, _SHOUTS, _STOPS = _table(b"0123456789"), _table(b"!?"), _table(b".,;:")


def features(texts: list[bytes | None]) -> np.ndarray:
    """(text, measure)"""
    m = {k: v.astype(float) for k, v in measure(texts).items()}
    data, off = ts.join_texts(texts)
    w = ts.Words(data, off, ts.ALNUM, fold=True)
    some, earlier = repeated(w.hashes(), w.doc())
    n, chars, own = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(w.counts, 1)
    size = np.maximum(np.diff(off) - 1, 1)
    count = lambda t: ts.seg_sum(t[data], off)
    return np.stack([
        np.log1p(m["n_words"]), m["word_chars"] / n, m["n_symbols"] / chars, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_repeat_words"] / n,
        m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_pipes"] / n, count(_DIGITS) / size, count(_SHOUTS) / n, count(_STOPS) / n,
        np.minimum(n / np.maximum(m["n_lines"], 1), 1000), 1 - ts.seg_sum(earlier, w.first) / own, ts.seg_sum(w.ends - w.starts == 1, w.first) / own, ts.seg_sum(data >= 128, off) / size,
    ], axis=1)


class Model:
    """Bin edges, and a table for each measure and for each pair of measures."""

    def __init__(self, edges: list[np.ndarray], bias: float):
        self.edges, self.bias = edges, bias
        self.one = [np.zeros(BINS) for _ in edges]
        #: the coarse bin of each of a measure's own bins
        self.joined = [np.arange(len(e) + 1) * min(COARSE, len(e) + 1) // (len(e) + 1) for e in edges]
        self.two: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def logit(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.bias)
        for k, t in enumerate(self.one):
            out += t[b[:, k]]
        for (i, j), t in self.two.items():
            out += t[self.joined[i][b[:, i]], self.joined[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(self.bins(x))))


_L2, _LEAST = 1.0, 5.0


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in two."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = cg**2 / (ch + _L2) + (g.sum() - cg) ** 2 / (h.sum() - ch + _L2) - g.sum() ** 2 / (h.sum() + _L2)
    gain[(cn < _LEAST) | (n.sum() - cn < _LEAST)] = -1
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over one measure's bins: the addition of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + _L2)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two measures' bins: a cut of one, then a cut of the other on each side; and its gain."""
    best = (np.zeros_like(g), 0.0)
    for flip in (False, True):
        G, H, N = (x.T if flip else x for x in (g, h, n))
        gain, at = _best_cut(G.sum(1), H.sum(1), N.sum(1))
        for cut in {at or len(G) // 2, len(G) // 2}:
            out = np.zeros_like(G)
            total = 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                out[rows] = _tree(G[rows].sum(0), H[rows].sum(0), N[rows].sum(0), 2)
                total += float((out[rows] * G[rows]).sum())
            if total > best[1]:
                best = (out.T if flip else out, total)
    return best


def edges_of(v: np.ndarray) -> np.ndarray:
    """Fewer than BINS edges: quantiles of the values, and of those above the least."""
    if not len(v):
        return np.zeros(0)
    inner = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    above = v[v > v.min()]
    return np.unique(np.concatenate([np.quantile(p, inner) for p in (v, above) if len(p)] + [above.min(initial=np.inf, keepdims=True)] * bool(len(above))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> Model:
    edges = [edges_of(x[:, k]) for k in range(len(MEASURES))]
    if len(np.unique(y)) < 2:
        return Model(edges, 0.0)
    p0 = y.mean()
    model = Model(edges, float(np.log(p0 / (1 - p0))))
    b = model.bins(x)
    counts = [np.bincount(b[:, k], minlength=BINS).astype(float) for k in range(x.shape[1])]
    z = model.logit(b)

    def residual():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(x.shape[1]):
            g, h = residual()
            add = rate * _tree(np.bincount(b[:, k], weights=g, minlength=BINS), np.bincount(b[:, k], weights=h, minlength=BINS), counts[k])
            model.one[k] += add
            z += add[b[:, k]]
    c = np.stack([model.joined[k][b[:, k]] for k in range(x.shape[1])], axis=1)
    cells = {(i, j): c[:, i] * COARSE + c[:, j] for i, j in combinations(range(x.shape[1]), 2)}
    grid = lambda ij, v: np.bincount(cells[ij], weights=v, minlength=COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = residual()
    one = np.ones(len(y))
    gains = {ij: _tree2(grid(ij, g), grid(ij, h), grid(ij, one))[1] for ij in cells}
    for ij in sorted(gains, key=lambda q: (-gains[q], q))[:PAIRS]:
        model.two[ij] = np.zeros((COARSE, COARSE))
    for _ in range(pair_rounds):
        for ij, table in model.two.items():
            g, h = residual()
            add = rate * _tree2(grid(ij, g), grid(ij, h), grid(ij, one))[0]
            table += add
            z += add.ravel()[cells[ij]]
    return model


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the measures of each row's text."""

    def block(part, texts):
        x = features(texts)
        off = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        return {"doc_id": part.column(0), "x": pa.ListArray.from_arrays(off, pa.array(x.ravel()))}

    return ts.map_blocks(docs, block, "doc_id long, x array<double>")


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from measured rows with a label (quality) outside the held-out part, `sample` of them at most."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    picked = own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = rows.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).select("x", "y").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(MEASURES))
    return fit(x, np.array(found.column("y").to_pylist(), float))


def score(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return ts.map_batches(rows, run, "doc_id long, score double")


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.settle(measured(ts.table(spark, sf_dir, "documents")))  # texts are read once
    model = train(rows, ts.table(spark, sf_dir, "labels"))
    return score(rows, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
