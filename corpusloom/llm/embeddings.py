"""Embedding near-dedup: a forest of random-projection trees with spill overlap.

The forest is fitted on a bounded sample of the vectors (SAMPLE_ROWS, by hash) and every vector is indexed: a node splits by a
random direction at the sample's median, and vectors within the spill margin of the split go to both sides. Vectors
of equal label that share a leaf are compared in double precision, block by block; a pair counts at the first leaf that both share
(leaves of linked vectors are looked up again in the forest), so no pair is counted twice and none has to be sent anywhere. A leaf
yields a row per vector: its links there, and the smallest vector that links inside the leaf connect it with. Equal vectors are one
representative with a multiplicity, so a common vector is one row.

Leaves hold about LEAF_ROWS vectors up to SAMPLE_ROWS / SAMPLE_LEAF * LEAF_ROWS of them (33 million); beyond, they grow with the
table, and so does the time of a leaf.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different lengths never meet; a null vec_id keeps its row with no links and a null component; rows of one vec_id count as
one vector each time, share a component, and state the links of the row that has most; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize
from corpusloom.llm.components import connected_components

TREES = 4
SAMPLE_ROWS = 65536
#: Vectors of all labels that a leaf should hold, and of the sample at least.
LEAF_ROWS = 2048
SAMPLE_LEAF = 4
SPILL = 0.2
_ROWS = 512


class Forest:
    """Arrays of nodes: direction, threshold, margin and children of inner nodes; children -1 in leaves."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf_rows: int, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.direction: list[np.ndarray | None] = []
        self.cut: list[tuple[float, float]] = []
        self.below: list[tuple[int, int]] = []
        least = max(SAMPLE_LEAF, leaf_rows * len(sample) // max(1, rows))
        self.roots = [self._grow(sample, least) for _ in range(trees)] if len(sample) else []

    def _grow(self, x: np.ndarray, least: int) -> int:
        node = len(self.below)
        self.direction.append(None)
        self.cut.append((0.0, 0.0))
        self.below.append((-1, -1))
        if len(x) <= least:
            return node
        d = self.rng.standard_normal(x.shape[1])
        d /= np.linalg.norm(d)
        p = x @ d
        middle, margin = float(np.median(p)), SPILL * float(p.std())
        left, right = x[p <= middle], x[p > middle]
        if not len(left) or not len(right):
            return node
        self.direction[node], self.cut[node] = d, (middle, margin)
        self.below[node] = (self._grow(left, least), self._grow(right, least))
        return node

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """Leaves of each row of x, in order of node, over all trees."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        todo = [(r, np.arange(len(x))) for r in self.roots]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            left, right = self.below[node]
            if left < 0:
                for r in rows:
                    out[r].append(node)
                continue
            p = x[rows] @ self.direction[node]
            middle, margin = self.cut[node]
            todo += [(left, rows[p <= middle + margin]), (right, rows[p > middle - margin])]
        return [sorted(o) for o in out]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows that can link: vec_id, label and a vector (doubles) with finite components, not all zero."""
    small = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding") if small else F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("label is not null and embedding is not null and size(embedding) > 0").where(F.coalesce(good, F.lit(False))).select("vec_id", "label", v.alias("v"))


def _by_length(column: pa.ChunkedArray | pa.Array):
    """(rows, unit vectors) of the lists of each length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        part = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
        yield int(size), rows, unit(_matrix(part))


def _leaf_links(group: pa.Table, threshold: float, forests: dict[int, Forest]) -> pa.Table:
    """Links inside one leaf of one label: (rep, links, low). Pairs that share an earlier leaf count there."""
    leaf = group.column("leaf")[0].as_py()
    ids = group.column("rep").to_numpy()
    many = group.column("many").to_numpy()
    links = np.zeros(len(ids), np.int64)
    up = np.arange(len(ids))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for size, rows, x in _by_length(group.column("v")):
        held: dict[int, frozenset] = {}

        def earlier(some):
            new = [k for k in np.unique(some).tolist() if k not in held]
            for k, found in zip(new, forests[size].leaves(x[new]) if new else (), strict=True):  # noqa: B023
                held[k] = frozenset(n for n in found if n < leaf)

        for at in range(0, len(rows), _ROWS):
            a, b = np.nonzero(x[at : at + _ROWS] @ x[at:].T >= threshold)
            keep = a < b
            a, b = a[keep] + at, b[keep] + at
            if len(a):
                earlier(np.concatenate((a, b)))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if held[i].isdisjoint(held[j]):
                    p, q = rows[i], rows[j]
                    links[p] += many[q]
                    links[q] += many[p]
                    r, s = root(p), root(q)
                    if r != s:
                        up[max(r, s)] = min(r, s)
    low = {}
    for k in range(len(ids)):
        low[root(k)] = min(low.get(root(k), ids[k]), ids[k])
    lows = np.array([low[root(k)] for k in range(len(ids))], np.int64)
    return pa.table({"rep": ids, "links": links, "low": lows}).filter(pa.array((links > 0) | (lows != ids)))


class _Or(dict):
    """Forests by length, with one for lengths that the sample lacks."""

    def __init__(self, known: dict, other: Forest):
        super().__init__(known)
        self.other = other

    def __missing__(self, _):
        return self.other


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; recall is that of the forest, precision is exact."""
    valid = valid_vectors(vectors)
    reps = materialize(valid.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).where("rep is not null"))
    total = reps.count()
    every = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < F.lit(int(min(1.0, sample_rows / max(1, total)) * (1 << 20)))
    sample = reps.where(every).orderBy("rep", "label").select("v").limit(2 * sample_rows).toArrow().column("v")
    forests = {d: Forest(x, total, trees, leaf_rows) for d, _, x in _by_length(sample)} if len(sample) else {}

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                of, leaf = [], []
                for d, rows, x in _by_length(part.column("v")):
                    # A length that the sample lacks has one leaf.
                    placed = forests[d].leaves(x) if d in forests else [[0]] * len(rows)
                    of.append(np.repeat(rows, [len(p) for p in placed]))
                    leaf += [n for p in placed for n in p]
                of = pa.array(np.concatenate(of) if of else np.empty(0, np.int64))
                columns = [part.column(c).take(of) for c in ("label", "rep", "many", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(leaf, pa.int64())], ["label", "rep", "many", "v", "leaf"])

    label_type, v_type = (reps.schema[c].dataType.simpleString() for c in ("label", "v"))
    placed = reps.select("label", "rep", "many", "v").mapInArrow(place, f"label {label_type}, rep long, many long, v {v_type}, leaf long")
    none = Forest(np.empty((0, 1)), 0, 0, 1)
    found = materialize(placed.groupBy("label", "leaf").applyInArrow(lambda t: _leaf_links(t, threshold, _Or(forests, none)), "rep long, links long, low long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("outside"))
    copies = valid.join(reps, ["label", "v"]).select("vec_id", "rep", "many")
    copies = materialize(copies.join(links, "rep", "left").select("vec_id", "rep", (F.coalesce("outside", F.lit(0)) + F.col("many") - 1).alias("n_links")))
    edges = found.select(F.col("rep").alias("a"), F.col("low").alias("b")).union(copies.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    comp = connected_components(edges).withColumnRenamed("node", "vec_id")
    out = vectors.select("vec_id").join(copies.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), "vec_id", "left").join(comp, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
