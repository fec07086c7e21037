"""Vectorised word hashing: numpy over the bytes of a slice of documents, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that `common_runs` looks at, and the share of them that makes a run common.
SAMPLE_DOCS = 2000
COMMON_SHARE = 0.01
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words up to this length are hashed by a polynomial modulo 2**64, which long structured words could make collide.
SHORT = 32
#: A fixed pseudo-random value for each byte.
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _powers
    if len(_powers) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        both = np.empty((2, n), np.uint64)
        for row, base in zip(both, (_BASE, _U(inverse)), strict=True):
            row[0] = 1
            row[1:] = base
            np.cumprod(row, out=row)
        _powers = both.T.copy()
    return _powers[:n, 0], _powers[:n, 1]


def hash_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text) over all words of all texts, in order."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[_LOWER[raw] if lower else raw] * up, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > SHORT):
        word = raw[starts[i] : ends[i]]
        h[i] = xxhash.xxh3_64_intdigest((_LOWER[word] if lower else word).tobytes())
    first = np.cumsum([0, *(len(t) + 1 for t in texts)][:-1]) if texts else np.empty(0, np.int64)
    return h, np.searchsorted(first, starts, side="right") - 1


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + h[j : j + n]
    return mix(out)


def slices(batches, most_bytes: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice's texts stay near `most_bytes` (one long text may pass it)."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        at = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n + 1
        if at < batch.num_rows:
            yield batch.slice(at)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def runs_of(texts: list[bytes], k: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of each distinct run of k consecutive words of a text, ordered by text and hash."""
    h, doc = hash_words(texts, lower)
    g = rolling(h, k)
    inside = doc[: len(g)] == doc[k - 1 :] if len(g) else np.empty(0, bool)
    g, d = g[inside], doc[: len(g)][inside]
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])] if len(g) else np.empty(0, bool)
    return g[new], d[new]


def common_runs(docs: DataFrame, k: int, lower: bool = False, sample_docs: int = SAMPLE_DOCS, share: float = COMMON_SHARE) -> np.ndarray:
    """Runs of k words that at least `share` of about `sample_docs` documents hold, sorted.

    The sample is by hash, so the list is bounded by its documents' words divided by share * sample_docs. Callers use
    the list to spread their work; results must not depend on it.
    """
    every = max(1, docs.count() // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(every)) == 0).select("text")

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(runs_of(as_bytes(part.column("text")), k, lower)[0].view(np.int64))], ["g"])

    counts = sample.mapInArrow(run, "g long").groupBy("g").count()
    found = counts.where(F.col("count") >= max(4, int(share * sample_docs))).select("g").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x
