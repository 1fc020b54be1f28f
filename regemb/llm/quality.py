"""Text quality by a generalised additive model with pairs (operator 8).

Each text becomes a short vector of plain measures (lengths, shares of kinds
of characters, repeats of words and lines).  A model is a lookup table per
feature and one per chosen pair of features.  Tables are learned by cyclic
boosting: round after round, each feature in turn fits one shallow tree over
its bins to the current residual and adds a small step of it to its table.
Then the pairs that explain most of what is left are boosted alike on a coarse
grid.  Scoring bins a whole batch of vectors and adds table entries.

The fit uses at most ``max_rows`` labelled rows (the smallest by a hash of the
id) outside the held-out fold; only their vectors (a few hundred bytes each)
reach the driver.  Labels, language, source and id are never inputs.

Null text counts as empty; empty text has the all-zero vector and is scored
like any other.  Repeated rows score alike.  Without usable labels every row
scores 0.5.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regemb.llm.base import id_and_text
from regemb.llm.toxicity import labelled_sample

MAX_ROWS = 20_000
FEATURES = ["log_chars", "log_words", "word_length", "upper", "digits", "spaces", "marks",
            "other_signs", "bars", "shouts", "word_kinds", "word_repeats", "line_repeats",
            "line_words", "line_ends", "capital_words", "ends_in_sign", "longest_word"]
BINS = 24
PAIR_BINS = 6
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 40
RATE = 0.12

_KIND = np.zeros(256, np.int64)          # of a UTF-8 byte
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:192] = 5                       # continuation bytes: not characters
_KIND[192:] = 6
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 7
_KIND[ord("!")] = 8
_KIND[ord("|")] = 9
_SIGN_END = re.compile(r"[^\w\s.,;:?'\"()\-](?=\s|$)")


def measure(text: str) -> list[float]:
    """The feature vector of one text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    k = np.bincount(_KIND[raw], minlength=10)
    chars = len(raw) - int(k[5])
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = int(k[3] + k[4] + k[6])
    other = chars - int(k[1] + k[2] + k[3] + k[4] + k[6] + k[7] + k[8] + k[9])
    if not n:
        return [np.log1p(chars), 0.0, 0.0, 0.0, 0.0, 1.0] + [0.0] * (len(FEATURES) - 6)
    repeats = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    return [
        np.log1p(chars), np.log1p(n), letters / n, int(k[3]) / (letters + 1), int(k[2]) / chars,
        int(k[1]) / chars, int(k[7]) / n, other / n, int(k[9]) / n, int(k[8]) / n,
        len(set(words)) / n, repeats / n, 1.0 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(x.rstrip()[-1:] in ".?!" for x in lines) / max(1, len(lines)),
        sum(w[0].isupper() for w in words) / n, len(_SIGN_END.findall(text)) / n,
        np.log1p(max(map(len, words)))]


@dataclass
class AdditiveModel:
    """Intercept, bin edges and lookup tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            b = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for i, j, t in self.pairs:
                z += t[b[i], b[j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best cut of bins [lo, hi): (gain, first bin of the right part)."""
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    if hi - lo < 2:
        return 0.0, lo
    left, right = cg[:-1] ** 2 / (ch[:-1] + 1.0), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1.0)
    gain = left + right - cg[-1] ** 2 / (ch[-1] + 1.0)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A regression tree over ordered bins: its value in each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, at = max((*_split(g, h, lo, hi), i) for i, (lo, hi) in enumerate(parts))
        if gain <= 1e-6:
            break
        lo, hi = parts[at]
        parts[at:at + 1] = [(lo, cut), (cut, hi)]
    out = np.empty(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A cut along one axis, then one along the other in each half."""
    best, value = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        _, cut = _split(gg.sum(1), hh.sum(1), 0, len(gg))
        out = np.zeros_like(gg)
        for rows in (slice(0, cut), slice(cut, len(gg))):
            if gg[rows].size:
                out[rows] = shallow_tree(gg[rows].sum(0), hh[rows].sum(0), 2)[None, :]
        explained = float((out * gg).sum())
        if explained > best:
            best, value = explained, out if axis == 0 else out.T
    return value


def boost(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit the tables: cyclic boosting of single features, then of pairs."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(intercept=float(np.log(p / (1 - p))))
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    z = np.full(len(y), model.intercept)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        q = 1.0 / (1.0 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            r, w = pull()
            step = RATE * shallow_tree(np.bincount(b, r, sizes[j]), np.bincount(b, w, sizes[j]))
            model.tables[j] += step
            z += step[b]

    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grids(i: int, j: int, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = coarse[i] * size[j] + coarse[j]
        return (np.bincount(cell, r, size[i] * size[j]).reshape(size[i], size[j]),
                np.bincount(cell, w, size[i] * size[j]).reshape(size[i], size[j]))

    r, w = pull()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            if size[i] > 1 and size[j] > 1:
                g, h = grids(i, j, r, w)
                gains.append((float((_grid_tree(g, h) * g).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pairs = [(i, j, np.zeros((size[i], size[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            step = RATE * _grid_tree(*grids(i, j, *pull()))
            t += step
            z += step[coarse[i], coarse[j]]
    return model


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    rows = [measure(t) for t in batch.column("text").to_pylist()]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def _measure_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _vectors(b)
        yield pa.RecordBatch.from_pydict({
            "y": b.column("y"), **{f: pa.array(x[:, j]) for j, f in enumerate(FEATURES)}})


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1,
        max_rows: int = MAX_ROWS) -> AdditiveModel | None:
    """The model, or None where the labels show one class only."""
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, max_rows)
    schema = "y int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = sample.select("text", "y").mapInArrow(_measure_kernel, schema).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")   # the same sums in any layout
    y = (rows["y"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    return boost(rows[FEATURES].to_numpy(float), y)


def _score_kernel(model: AdditiveModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5) if model is None else model.score(_vectors(b))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(s)})
    return run


def score_documents(docs: DataFrame, model: AdditiveModel | None) -> DataFrame:
    """``(doc_id, score)`` of every row."""
    return id_and_text(docs).mapInArrow(_score_kernel(model), "doc_id long, score double")
