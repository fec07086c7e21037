"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically.

Each feature is cut into bins; a feature's contribution is a lookup table over its bins. Training cycles over the features
and fits, for each in turn, a shallow tree to the residuals of the logistic loss, adding a small step of it to that feature's
table; then the pairs of features whose joint residuals gain most get two-way tables by the same cycles. Scoring is an addition of
table entries per row, vectorised over a batch.

The model is fitted on the driver from at most TRAIN_ROWS labelled rows, taken by hash; every document is scored.

Defined cases: null and empty texts have the features of an empty text and a score like any other; rows without a label, or with a
null one, are not trained on; without two classes in training all scores are the base rate (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import as_bytes, hash_words, slices

TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIRS = 8
STEP = 0.15
FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digit", "punct", "symbol", "not_ascii", "newline", "distinct_words",
    "top_word", "repeated_pairs", "repeated_lines", "short_words", "mark_words", "capital_words", "stops", "word_spread", "pipes",
)

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"!?()-", range(128, 256), b" \t\r\v\f", b"\n"), 1):
    _CLASS[list(_set)] = _i


def _per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def features(texts: list[bytes]) -> np.ndarray:
    """len(FEATURES) figures of each text, computed over all texts at once."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(n), lengths + 1)[: len(raw)]
    kinds = np.bincount(owner * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8).astype(float)
    kinds[:, 7] -= 1  # the newline that joins the texts
    size = np.maximum(1, lengths)
    h, doc = hash_words(texts)
    words = np.bincount(doc, minlength=n).astype(float)
    w = np.maximum(1, words)
    space = np.isin(_CLASS[raw], (6, 7))
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    chars = (ends - starts).astype(float)
    first, last = _CLASS[raw[starts]], _CLASS[raw[ends - 1]]
    ordered = np.lexsort((h, doc))
    hs, ds = h[ordered], doc[ordered]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])] if len(hs) else np.empty(0, bool)
    runs = np.diff(np.r_[np.flatnonzero(new), len(hs)])
    top = np.zeros(n)
    np.maximum.at(top, ds[new], runs)
    pair, pd = h[:-1] * np.uint64(31) + h[1:], doc[:-1]
    inside = doc[:-1] == doc[1:] if len(h) else np.empty(0, bool)
    pair, pd = pair[inside], pd[inside]
    po = np.lexsort((pair, pd))
    fresh = np.r_[True, (pair[po][1:] != pair[po][:-1]) | (pd[po][1:] != pd[po][:-1])] if len(po) else np.empty(0, bool)
    distinct_pairs = np.bincount(pd[po][fresh], minlength=n)
    lines = [t.split(b"\n") for t in texts]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    mean = _per_text(chars, doc, n) / w
    spread = np.sqrt(np.maximum(0, _per_text(chars**2, doc, n) / w - mean**2))
    out = np.stack([
        np.log1p(lengths), np.log1p(words), mean, _per_text(chars > 12, doc, n) / w, kinds[:, 1] / size, kinds[:, 3] / size, kinds[:, 4] / size,
        kinds[:, 0] / size, kinds[:, 5] / size, kinds[:, 7] / size, np.bincount(ds[new], minlength=n) / w, top / w,
        1 - distinct_pairs / np.maximum(1, np.bincount(pd, minlength=n)), repeated, _per_text(chars <= 3, doc, n) / w,
        _per_text((last == 4) | (last == 0), doc, n) / w, _per_text(first == 1, doc, n) / w, _per_text(raw[ends - 1] == 46, doc, n) / w, spread,
        np.bincount(owner, weights=raw == 124, minlength=n) / size,
    ], axis=1)
    return out


class Additive:
    """Intercept, bin edges, one table per feature and one per chosen pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else [np.empty(0)] * len(FEATURES)
        self.coarse = [e[:: max(1, -(-len(e) // (PAIR_BINS - 1)))] for e in self.edges]
        rate = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(BINS + 1) for _ in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(y) and 0 < y.mean() < 1:
            self._fit(x, y)

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]

    @staticmethod
    def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
        """Values per bin of a tree of `depth` levels over ordered bins, from their gradients and curvatures."""
        out = np.zeros(len(grad))

        def split(a: int, b: int, level: int) -> None:
            g, w = grad[a:b].cumsum(), hess[a:b].cumsum()
            if level and b - a > 1:
                gain = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
                at = a + 1 + int(gain.argmax())
                split(a, at, level - 1)
                split(at, b, level - 1)
            else:
                out[a:b] = g[-1] / (w[-1] + 1)

        split(0, len(grad), depth)
        return out

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        score = np.full(len(y), self.base)

        def slope():
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f, b in enumerate(fine):
                g, w = slope()
                step = STEP * self._tree(np.bincount(b, g, BINS + 1), np.bincount(b, w, BINS + 1), 2)
                self.tables[f] += step
                score += step[b]
        g, w = slope()
        gains = []
        for i in range(len(fine)):
            for j in range(i):
                cell = coarse[i] * PAIR_BINS + coarse[j]
                gains.append(((np.bincount(cell, g) ** 2 / (np.bincount(cell, w) + 5)).sum(), i, j))
        chosen = [(i, j, coarse[i] * PAIR_BINS + coarse[j]) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        tables = [np.zeros(PAIR_BINS * PAIR_BINS) for _ in chosen]
        for _ in range(ROUNDS // 3):
            for (_, _, cell), table in zip(chosen, tables, strict=True):
                g, w = slope()
                step = STEP * np.bincount(cell, g, len(table)) / (np.bincount(cell, w, len(table)) + 5)
                table += step
                score += step[cell]
        self.pairs = [(i, j, t) for (i, j, _), t in zip(chosen, tables, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for b, table in zip(self._bins(x, self.edges), self.tables, strict=True):
            total += table[b]
        coarse = self._bins(x, self.coarse)
        for i, j, table in self.pairs:
            total += table[coarse[i] * PAIR_BINS + coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Additive:
    """Fit on at most about `most` labelled documents that are not held out; of several labels of one doc_id the smallest counts, once."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    total = known.count()
    share = int(min(1.0, most / max(1, total)) * (1 << 20))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share).groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(features(as_bytes(part.column("text")))), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # `picked` holds at most about TRAIN_ROWS pairs of integers.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, quality int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return Additive(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(as_bytes(part.column("text")))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Additive, least: float = 0.7) -> DataFrame:
    """The rows of docs (all columns) whose score is at least `least`."""

    def run(batches):
        for part in slices(batches):
            yield part.filter(pa.array(model.score(features(as_bytes(part.column("text")))) >= least))

    return docs.mapInArrow(run, docs.schema)
