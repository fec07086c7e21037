"""N-gram Jaccard join: count-vector R-trees over groups of hashed shingles, with exact verification.

Two sets with 100 * |A & B| >= 90 * |A | B| differ in at most min(|A|, |B|) / 9 shingles. That gives a lossless way to
bring candidates together: hash the shingles into more groups than a size class can differ in, and at least one
group's content is equal; rows (class, group, content) meet by that key, each document having about a row per nine
shingles. The chain is

1. documents of equal sets become one representative;
2. rows whose key another document has are given their representative's group counts, a point of an R-tree's space: the sum
   of coordinate minima of two points bounds the overlap of their sets from above. Within a key, documents that the bound
   allows to link, directly or through others, are tied to the smallest of them. Keys of more than HOT documents tie all of
   theirs to the smallest without points, so no task holds such a group;
3. the components of those ties are clusters; nothing outside a cluster can link with it. A cluster that fits one block is
   compared in one task: an R-tree holds its points, boxes and points are cut off by the bound, and pairs that pass are
   verified on their whole sets, unless links already connect them;
4. larger clusters are compared with probes: about PROBES documents by hash are sent to each block of the cluster, which links
   its documents with them. Documents of the cluster's largest component need no further comparison with each other; of
   the rest, new probes are drawn while they at least halve, and at last all of the rest are compared with every block. So copies
   of one text cost rows in proportion to their number;
5. components of those links, with every document in its representative's.

Shingles that a bounded sample shows to be common are left out of the groups (two sets differ no more without them), which
keeps a popular line from bringing unlike documents together; verification is on whole sets.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component; below three words the
whole sequence is the only shingle; a null doc_id gets a null component; rows of one doc_id share the component that any of their
texts reaches; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize
from corpusloom.llm.components import connected_components
from corpusloom.llm.words import as_bytes, common_runs, hash_words, member, mix, rolling, runs_of, slices

#: A point has a power of two of groups, about one per four shingles, between these.
LEAST_GROUPS, MOST_GROUPS = 16, 8192
#: Documents and bytes of sets that one task compares at once, and documents of a key that it groups by the bound.
BLOCK, BLOCK_BYTES = 512, 64 << 20
HOT = 2048
#: Documents of a large cluster that all others are compared with in a round.
PROBES = 64
LEAF = 8


def shingle_sets(texts: list[bytes], words: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lowered."""
    if not texts:
        return []
    g, d = runs_of(texts, words, lower=True)
    h, doc = hash_words(texts, lower=True)
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        begin = np.searchsorted(doc, short)
        extra = np.array([mix(rolling(h[b : b + count[t]], count[t]) + np.uint64(count[t]))[0] for b, t in zip(begin, short, strict=True)], np.uint64)
        g, d = np.r_[g, extra], np.r_[d, short]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
    return np.split(g, np.searchsorted(d, np.arange(1, len(texts))))


def groups_of(n: int) -> int:
    """Groups of the point of a set of n shingles."""
    groups = LEAST_GROUPS
    while groups < MOST_GROUPS and 4 * groups < n:
        groups *= 2
    return groups


def group_counts(s: np.ndarray) -> np.ndarray:
    """Shingles per group: the set's point, in the smallest type that holds it. Groups are low bits of the hash, so the
    halves of a point add up to a coarser one."""
    counts = np.bincount((s & np.uint64(groups_of(len(s)) - 1)).astype(np.int64), minlength=groups_of(len(s)))
    return counts.astype(np.min_scalar_type(int(counts.max())))


def read_point(raw: bytes, n: int) -> np.ndarray:
    """The point of a set of n shingles from its bytes."""
    return np.frombuffer(raw, np.dtype(f"u{len(raw) // groups_of(n)}"))


def common_points(points: list[np.ndarray]) -> np.ndarray:
    """Points as rows of one matrix, folded to the coarsest of them."""
    groups = min(map(len, points))
    return np.stack([p.reshape(-1, groups).sum(0, dtype=np.int32) for p in points])


def size_classes(n: int, percent: int = 90) -> list[tuple[int, int]]:
    """(class, groups) under which a set of n shingles is keyed: every class that a partner of at least its size may be in.

    Class c holds the sizes from 1.5**c on, below 1.5**(c + 1).
    """
    most = n * 100 // percent
    c = 0
    while _start(c + 1) <= n:
        c += 1
    out = []
    while _start(c) <= most:
        out.append((c, differences(c, percent) + 1 + spare_groups(c, percent)))
        c += 1
    return out


def differences(c: int, percent: int) -> int:
    """Shingles in which a set of class c may differ from a smaller one at most."""
    return (_start(c + 1) - 1) * (100 - percent) // percent


def spare_groups(c: int, percent: int) -> int:
    """Groups beyond the pigeonhole's. With s of them, at least s + 1 groups of a linked pair are equal, so that each document may leave
    out the s of its keys that most documents have: the rarest key of those that the pair shares is never among them."""
    return 1 + differences(c, percent) // 4


def _start(c: int) -> int:
    return int(np.ceil(1.5**c))


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, point) of every row; digest (16 bytes) stands for the set, null for none."""

    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(as_bytes(part.column("text")), words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            points = [group_counts(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(points, pa.binary())], ["doc_id", "n_shingles", "digest", "point"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, point binary")


def _keys(docs: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """(key, c, doc_id): a row per group and class; sets too small to differ are left to their digests, copies in a slice to the first."""

    def run(batches):
        for part in slices(batches):
            seen: set[bytes] = set()
            keys, classes, ids = [], [], []
            for doc_id, s in zip(part.column("doc_id").to_pylist(), shingle_sets(as_bytes(part.column("text")), words), strict=True):
                if doc_id is None or not len(s) or (raw := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(raw)
                rare = s[~member(common, s)]
                spread = mix(rare)
                for c, groups in size_classes(len(s), percent):
                    if not differences(c, percent):
                        continue
                    content = np.zeros(groups, np.uint64)
                    np.add.at(content, (rare % np.uint64(groups)).astype(np.int64), spread)
                    keys.append(mix(content + np.uint64(c * 1_000_003) + mix(np.arange(groups, dtype=np.uint64))) >> np.uint64(16))  # a collision only adds a candidate
                    classes.append(np.full(groups, c, np.int8))
                    ids.append(np.full(groups, doc_id, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(ids))], ["key", "c", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, c tinyint, doc_id long")


def _shared(keyed: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id): keys that bring documents together, less the spare ones of each document and class that most documents have.

    Keys that the same documents have (same ends, same sums of both halves of their hashes) say the same and become one.
    """
    same = Window.partitionBy("key")
    h = F.xxhash64("doc_id")
    lo, hi = F.min("doc_id").over(same), F.max("doc_id").over(same)
    who = F.xxhash64(lo, hi, F.sum(F.shiftright(h, 32)).over(same), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).over(same))
    met = keyed.select("doc_id", "c", who.alias("key"), F.count("*").over(same).alias("many"), (lo < hi).alias("met")).where("met")
    mine = met.repartition("doc_id").groupBy("doc_id", "c", "key").agg(F.count("*").alias("n"), F.first("many").alias("many"))
    so_far = Window.partitionBy("doc_id", "c").orderBy(F.desc("many"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spare = F.element_at(F.array(*[F.lit(spare_groups(c, percent)) for c in range(64)]), F.col("c") + 1)
    return mine.select("key", "doc_id", F.sum("n").over(so_far).alias("nth"), spare.alias("spare")).where("nth > spare").select("key", "doc_id")


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of sets of a and b shingles that reach the threshold."""
    return -(-(percent * (a + b)) // (100 + percent))


class CountTree:
    """R-tree over group counts, packed by recursive halving along the widest coordinate, sizes first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.root = self._build(np.argsort(sizes, kind="stable"))

    def _build(self, rows: np.ndarray):
        p, n = self.points[rows], self.sizes[rows]
        box = (p.max(0), n.min(), n.max())
        if len(rows) <= LEAF:
            return box, rows, None
        if n.max() > 1.2 * n.min():
            order = rows[np.argsort(n, kind="stable")]
        else:
            order = rows[np.argsort(p[:, int(np.argmax(p.max(0) - p.min(0)))], kind="stable")]
        half = len(order) // 2
        return box, None, (self._build(order[:half]), self._build(order[half:]))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose counts allow the threshold with this point."""
        found, todo = [], [self.root]
        while todo:
            (top, least, most), rows, below = todo.pop()
            if 100 * most < percent * size or 100 * size < percent * least:
                continue
            if np.minimum(point, top).sum() < needed(size, int(least), percent):
                continue
            if below:
                todo += below
                continue
            n = self.sizes[rows]
            ok = np.minimum(point, self.points[rows]).sum(1) >= needed(size, n, percent)
            found.append(rows[ok])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


class Union:
    """Disjoint sets of integers, each known by its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (above := up.get(x, x)) != x:
            up[x] = up.get(above, above)
            x = above
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def link_forest(probes: list[tuple[int, int, np.ndarray]], others: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Spanning forest, as pairs of ids, of the links of probes with each other and with others: rows (id, component, set).

    Rows of one component are taken as connected, and only links that connect more are looked for.
    """
    if not probes or len(probes) + len(others) < 2:
        return []
    rows = probes + others
    sizes = np.array([len(s) for _, _, s in rows], np.int64)
    points = common_points([group_counts(s) for _, _, s in rows])
    tree = CountTree(points[: len(probes)], sizes[: len(probes)])
    union, links = Union(), []
    for q, (doc, component, shingles) in enumerate(rows):
        for r in tree.search(points[q], int(sizes[q]), percent):
            other, its, other_set = rows[r]
            if union.root(component) != union.root(its) and overlap(shingles, other_set) >= needed(len(shingles), len(other_set), percent):
                union.join(component, its)
                links.append((doc, other))
    return links


def allowed_forest(points: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the pairs that the bound allows to link.

    A component grows from its first row: each of its members takes in what the bound allows of the rows still outside.
    """
    order = np.argsort(sizes, kind="stable")
    outside = order
    forest = []
    while len(outside):
        todo, outside = [int(outside[0])], outside[1:]
        while todo and len(outside):
            q = todo.pop()
            n = sizes[outside]
            near = (100 * n >= percent * sizes[q]) & (100 * sizes[q] >= percent * n)
            near[near] = np.minimum(points[outside[near]], points[q]).sum(1) >= needed(int(sizes[q]), n[near], percent)
            taken = outside[near]
            forest += [(q, int(r)) for r in taken]
            todo += taken.tolist()
            outside = outside[~near]
    return forest


def _clusters(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, cluster) of the representatives that the bound may let link with another."""
    common = common_runs(docs.select("doc_id", "text"), words, lower=True)
    shared = materialize(_shared(_keys(docs, words, percent, common), percent))
    known = members.where("rep is not null").select("doc_id", "rep", "n_shingles", "point")
    reps = materialize(shared.join(known.select("doc_id", "rep"), "doc_id").select("key", "rep").distinct())
    sizes = reps.groupBy("key").agg(F.min("rep").alias("lo"), F.count("*").alias("many")).where("many > 1")
    sized = materialize(reps.join(sizes, "key"))
    ties = sized.where((F.col("many") > HOT) & (F.col("lo") < F.col("rep"))).select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    point = known.where("doc_id = rep").select("rep", F.col("n_shingles").cast("int").alias("n"), "point").dropDuplicates(["rep"])
    dealt = sized.where(F.col("many") <= HOT).select("key", "rep").join(point, "rep").select("key", "rep", "n", "point")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "rep")

    def run(batches):
        def settle(group):
            if len(group) < 2:
                return []
            ids = list(group)
            points = common_points([read_point(p, n) for n, p in group.values()])
            sizes = np.array([n for n, _ in group.values()], np.int64)
            union = Union()
            for a, b in allowed_forest(points, sizes, percent):
                union.join(ids[a], ids[b])
            return [(low, x) for x in ids if (low := union.root(x)) != x]

        key, group = None, {}
        for batch in batches:
            out = []
            for k, rep, n, point in zip(*(batch.column(c).to_pylist() for c in ("key", "rep", "n", "point")), strict=True):
                if k != key:
                    out += settle(group)
                    key, group = k, {}
                group[rep] = (n, point)
            yield _pairs(out)
        yield _pairs(settle(group))

    pairs = dealt.mapInArrow(run, "a long, b long").union(ties)
    found = connected_components(pairs).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    return found.join(members.where("rep = doc_id").select("doc_id", "n_shingles").dropDuplicates(["doc_id"]), "doc_id")


def _sets(docs: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """Rows of placed (doc_id, cluster, blocks) with their document's set as bytes."""
    joined = docs.select("doc_id", "text").join(placed, "doc_id").select("doc_id", "cluster", "blocks", "text")

    def cut(batches):
        for part in slices(batches):
            sets = shingle_sets(as_bytes(part.column("text")), words)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "cluster", "blocks")), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "cluster", "blocks", "shingles"])

    return joined.mapInArrow(cut, "doc_id long, cluster long, blocks int, shingles binary")


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of each group (cluster, chunk, block) of rows (probe, doc_id, component, shingles), probes with all rows."""

    def run(batches):
        key, sides = None, ([], [])
        for batch in batches:
            out = []
            for *k, probe, doc_id, component, raw in zip(*(batch.column(c).to_pylist() for c in ("cluster", "chunk", "block", "probe", "doc_id", "component", "shingles")), strict=True):
                if k != key:
                    out += link_forest(*sides, percent)
                    key, sides = k, ([], [])
                sides[0 if probe else 1].append((doc_id, component, np.frombuffer(raw, np.uint64)))
            yield _pairs(out)
        yield _pairs(link_forest(*sides, percent))

    columns = ["cluster", "chunk", "block", "probe", "doc_id", "component", "shingles"]
    dealt = rows.select(columns).repartition("cluster", "chunk", "block").sortWithinPartitions("cluster", "chunk", "block", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def _links(docs: DataFrame, clusters: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(a, b): links that span each component of the clusters (doc_id, cluster, n_shingles)."""
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n_shingles") * 8 / F.lit(BLOCK_BYTES))).cast("int")
    sizes = materialize(clusters.groupBy("cluster").agg(blocks.alias("blocks")))
    sets = materialize(_sets(docs, clusters.join(sizes, "cluster").select("doc_id", "cluster", "blocks"), words))
    small = sets.where("blocks = 1").select("cluster", F.lit(0).alias("chunk"), F.lit(0).alias("block"), F.lit(True).alias("probe"), "doc_id", F.col("doc_id").alias("component"), "shingles")
    links = materialize(_compare(small, percent))
    if sizes.where("blocks > 1").isEmpty():
        return links
    return links.union(_large_links(sets.where("blocks > 1"), percent, block))


def _large_links(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links that span the components of clusters of several blocks."""
    h = F.xxhash64("doc_id", F.lit(6))
    rest = sets.select("doc_id", "cluster").distinct()
    totals = materialize(sets.groupBy("cluster").agg(F.count("*").alias("total"), F.first("blocks").alias("blocks")))
    state = rest.withColumn("component", F.col("doc_id"))
    before, found = totals.select("cluster", F.lit(None).cast("long").alias("before")), []
    while True:
        left = rest.groupBy("cluster").agg(F.count("*").alias("left")).join(totals, "cluster").join(before, "cluster")
        last = (F.col("left") <= block) | F.coalesce(2 * F.col("left") > F.col("before"), F.lit(False))
        chunks = F.when(last, F.ceil(F.col("left") * F.col("blocks") / F.col("total"))).otherwise(1).cast("int")
        share = F.when(last, 1.0).otherwise(F.least(F.lit(PROBES), F.col("total") / F.col("blocks")) / F.col("left"))
        left = materialize(left.select("cluster", "left", last.alias("last"), chunks.alias("chunks"), share.alias("share")))
        if left.isEmpty():
            return _union(found)
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 32)) < F.col("share") * (1 << 32)
        probes = rest.join(left, "cluster").where(drawn).select("doc_id", F.pmod(h, F.col("chunks")).cast("int").alias("chunk"))
        at = sets.join(state.select("doc_id", "component"), "doc_id")
        asked = at.join(probes, "doc_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
        others = at.join(left.select("cluster", "chunks"), "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        others = others.withColumn("block", F.pmod(h, F.col("blocks")).cast("int")).withColumn("probe", F.lit(False))
        links = materialize(_compare(asked.unionByName(others), percent))
        found.append(links)
        reached = connected_components(links.union(state.select("doc_id", "component"))).withColumnRenamed("node", "doc_id")
        state = materialize(state.select("doc_id", "cluster").join(reached, "doc_id", "left").select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("component")))
        before = materialize(left.where("not last").select("cluster", F.col("left").alias("before")))
        parts = state.join(before, "cluster", "left_semi").groupBy("cluster", "component").agg(F.count("*").alias("n"))
        main = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
        rest = materialize(state.join(materialize(main), "cluster").where("component <> main").select("doc_id", "cluster"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def near_duplicate_components(docs: DataFrame, words: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    scanned = materialize(_scan(docs, words))
    copied = materialize(scanned.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rep = F.when(F.col("digest").isNotNull(), F.coalesce("first", "doc_id"))
    members = materialize(scanned.join(copied, "digest", "left").select("doc_id", "n_shingles", rep.alias("rep"), "point"))
    clusters = materialize(_clusters(docs, members, words, percent))
    copies = members.where("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(_links(docs, clusters, words, percent, block).union(copies))
    joined = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs (all columns) without near duplicates: of each component, the row of the smallest doc_id stays.

    Of several rows of one doc_id, the first by text stays; rows without a doc_id stay.
    """
    found = near_duplicate_components(docs, words, percent).where("component_id < doc_id").select("doc_id").distinct()
    left = docs.join(found, "doc_id", "left_anti").select(docs.columns)
    nth = fresh(docs, "nth")
    numbered = left.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return numbered.where((F.col(nth) == 1) | F.col("doc_id").isNull()).drop(nth)
