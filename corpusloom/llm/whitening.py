"""Embedding whitening by a weighted multiplicity covariance.

Entries become integers, x = floor(64 * c) + 1000000, so equal vectors can be grouped: an x-vector is one row with a multiplicity, however
often it occurs. Weights of the fit are these counts (the fit list is all vectors) or one (it is the distinct vectors).
Three sums over the distinct vectors, each a weighted product of matrices within a task and a sum over tasks:

1. n and the sums S of each dimension, exact;
2. the covariance, of vectors centred by S / n before they are multiplied;
3. the covariance of the whitened vectors, for the error against the identity.

Only matrices of dimensions x dimensions reach the driver, for the eigenvectors. Each distinct vector is whitened once, and the
rows of the table get theirs by a join on the packed x-vector (two bytes an entry for usual values). The offset of 1000000 cancels out of
all of that, so it is not packed.

Defined cases: vectors that are null or hold null or non-finite entries are left out; entries beyond +-2**56 count as +-2**56; vectors of each length are a
fit of their own, with its own n; empty vectors have no components and are left out; where a direction has no variance (fewer vectors than dimensions, or all equal)
its component has a null `whitened` and takes no part in the identity error; a null vec_id keeps its row; repeated rows are vectors each
time; an empty table gives no rows; other columns are ignored. Signs: a component's entry of largest size is positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

SCALE = 64
COMPONENTS = 32
LARGEST = 2.0**56
_WIDTHS = ((2, np.dtype("<i2")), (4, np.dtype("<i4")), (8, np.dtype("<i8")))
#: Rows that one product takes.
_ROWS = 4096


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a matrix of bytes."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _pack(batches):
    """(vec_id, key): the width of an entry in bytes, then floor(SCALE * entry) in the fewest bytes that hold all of them."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            batch = batch.filter(batch.column("embedding").is_valid())
            lists = batch.column("embedding")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
            ends = np.cumsum(sizes)
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            good = (bad[ends] == bad[ends - sizes]) & (sizes > 0)
            for size in np.unique(sizes[good]):
                rows = np.flatnonzero(good & (sizes == size))
                x = flat[(ends[rows] - size)[:, None] + np.arange(size)]
                y = np.floor(SCALE * np.clip(x, -LARGEST, LARGEST)).astype(np.int64)
                need = np.zeros(len(rows), np.int64)
                for width, kind in _WIDTHS[:2]:
                    need += 1 * ((y != y.astype(kind)).any(axis=1))
                for i, (width, kind) in enumerate(_WIDTHS):
                    if not (some := np.flatnonzero(need == i)).size:
                        continue
                    key = np.empty((len(some), 1 + int(size) * width), np.uint8)
                    key[:, 0] = width
                    key[:, 1:] = y[some].astype(kind).view(np.uint8).reshape(len(some), -1)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows[some])), _binary(key)], ["vec_id", "key"])


def _unpack(column: pa.Array):
    """(rows, integer vectors) of the packed keys of each length and width."""
    keys = column.to_pylist()
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(keys):
        kinds.setdefault((key[0], len(key)), []).append(i)
    for (width, size), rows in kinds.items():
        raw = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), size)[:, 1:]
        yield np.array(rows), np.ascontiguousarray(raw).view(dict(_WIDTHS)[width]).reshape(len(rows), (size - 1) // width).astype(np.int64)


def _offsets(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - S, exact: Python integers where 64 bits could be too few."""
    top = n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if top < 1 << 62:
        return y * n - np.array(sums, np.int64)
    return y.astype(object) * n - np.array(sums, object)


def _squares(off: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    top = max(abs(int(off.min(initial=0))), abs(int(off.max(initial=0))))
    return (off * off if top * top * max(1, off.shape[1]) < 1 << 62 else off.astype(object) ** 2).sum(axis=1).tolist()


def _chunks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            many = part.column("many").to_numpy()
            for rows, y in _unpack(part.column("key")):
                yield part.column("key").take(pa.array(rows)), many[rows], y


def _entries(dims: int, i, j, values, kind) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, kind)], ["dims", "i", "j", "v"])


def _sums(batches):
    """(dims, i, j, v): the weight at i = -1, the sum of each dimension else; exact."""
    totals: dict[int, list[int]] = {}
    for _, many, y in _chunks(batches):
        total = totals.setdefault(y.shape[1], [0] * (1 + y.shape[1]))
        top = int(np.abs(y).max(initial=0)) * int(many.sum())
        weighted = (y * many[:, None] if top < 1 << 62 else y.astype(object) * many.astype(object)[:, None]).sum(axis=0)
        for i, v in enumerate([int(many.sum()), *weighted.tolist()]):
            total[i] += v
    for dims, total in totals.items():
        yield _entries(dims, np.arange(-1, dims), np.zeros(dims + 1), [f"{v}" for v in total], pa.string())


def _products(view):
    """A task's weighted sums of outer products of view(integer vectors), as entries (dims, i, j, v) on and above the diagonal."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for _, many, y in _chunks(batches):
            z = view(y)
            product = (z * many[:, None]).T @ z
            held = totals.get(y.shape[1])
            totals[y.shape[1]] = product if held is None else held + product
        for dims, product in totals.items():
            i, j = np.triu_indices(len(product))
            yield _entries(dims, i, j, product[i, j], pa.float64())

    return run


def _matrices(entries: DataFrame) -> dict[int, np.ndarray]:
    """The symmetric matrix of each number of dimensions, summed over tasks."""
    found: dict[int, dict] = {}
    for r in entries.groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.dims, {})[r.i, r.j] = r.v
    out = {}
    for dims, cells in found.items():
        size = 1 + max((i for i, _ in cells), default=-1)
        out[dims] = np.zeros((size, size))
        for (i, j), v in cells.items():
            out[dims][i, j] = out[dims][j, i] = v
    return out


def distinct_vectors(packed: DataFrame, weights: str = "counts") -> DataFrame:
    """(key, many): each x-vector once, with its weight in the fit."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    return packed.groupBy("key").agg((F.count("*") if weights == "counts" else F.max(F.lit(1).cast("long"))).alias("many"))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """For each number of dimensions: n, S, the whitening matrix (a column for each component with variance), the share of variance that each
    component explains, and the largest error of the whitened covariance against the identity."""
    entries = "dims int, i int, j int, v "
    totals: dict[int, dict[int, int]] = {}
    for r in distinct.mapInArrow(_sums, entries + "string").groupBy("dims", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        totals.setdefault(r.dims, {})[r.i] = int(r.v)
    centre = {d: (t[-1], [t[i] for i in range(d)]) for d, t in totals.items()}

    def centred(y):
        n, sums = centre[y.shape[1]]
        return (_offsets(y, n, sums) / n).astype(np.float64)

    models = {}
    for dims, matrix in _matrices(distinct.mapInArrow(_products(centred), entries + "double")).items():
        n, sums = centre[dims]
        e, vectors = np.linalg.eigh(matrix / n)
        e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
        trace = float(np.trace(matrix)) / n
        real = e > max(1e-300, 8 * dims * np.finfo(float).eps * float(e[0])) if len(e) else np.empty(0, bool)
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0) if len(e) else vectors
        models[dims] = {"n": n, "sums": sums, "white": vectors[:, real] / np.sqrt(e[real]), "explained": [float(max(v, 0) / trace) if trace > 0 else 0.0 for v in e], "error": 0.0}
    white = {d: m["white"] for d, m in models.items()}
    for dims, matrix in _matrices(distinct.mapInArrow(_products(lambda y: centred(y) @ white[y.shape[1]]), entries + "double")).items():
        models[dims]["error"] = float(np.abs(matrix / models[dims]["n"] - np.eye(len(matrix))).max(initial=0.0))
    return models


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of each row that is not left out.

    deviation is the exact sum over dimensions of (n * x - S)**2, a decimal(38,0); whitened and explained are arrays over the components.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    packed = vectors.select("vec_id", v.alias("embedding")).mapInArrow(_pack, f"vec_id {id_type}, key binary")
    distinct = materialize(distinct_vectors(packed, weights))
    models = fit(distinct, components)

    def apply(batches):
        for keys, _, y in _chunks(batches):
            if not (model := models.get(y.shape[1])):
                continue
            off = _offsets(y, model["n"], model["sums"])
            z = (off / model["n"]).astype(np.float64) @ model["white"]
            whole = np.zeros((len(y), len(model["explained"])))
            whole[:, : z.shape[1]] = z
            absent = np.zeros(whole.shape, bool)
            absent[:, z.shape[1] :] = True
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * whole.shape[1], pa.array(whole.ravel(), mask=absent.ravel()))
            deviation = pa.array([f"{s}" for s in _squares(off)], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(y), y.shape[1], np.int32)), deviation, lists], ["key", "dims", "deviation", "whitened"])

    once = distinct.mapInArrow(apply, "key binary, dims int, deviation string, whitened array<double>")
    facts = vectors.sparkSession.createDataFrame([(d, m["n"], m["explained"], m["error"]) for d, m in models.items()], "dims int, n long, explained array<double>, identity_error double")
    # A row for each length of vectors.
    rows = packed.join(once, "key").join(F.broadcast(facts), "dims")
    return rows.select("vec_id", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")
