"""Centroid clustering by dual-tree Lloyd iterations over whole numbers.

A cover tree is built once over each block of vectors and kept with it in the
shared folder; one over the centroids is made for each round.  A block's task
descends both trees together: a pair of nodes goes where the bounds on its
distances show that no centroid below can be the nearest to any vector below,
and leaves that are left are compared exactly.  What leaves a task are sums and
counts of each centroid, so a round moves (tasks x centroids) rows.

Distances are sums of squared whole numbers, so results don't depend on how the
vectors are dealt or summed, and ties go to the smaller number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.scratch import drop, save, saved_path

#: Vectors of a block, and of a leaf at most unless they are copies.
BLOCK, LEAF = 2048, 16
#: Components at most: squared distances of 64 of them fit 64 bits, and those up to EXACT are whole numbers as doubles too.
MOST, EXACT = 1 << 27, 1 << 22
#: Bounds are doubles; a pair goes only where they say so by more than rounding can make.
SLACK = 1e-6


@dataclass
class CoverTree:
    """Nodes by level.  A level's centers lie more than 2**level apart, each point lies within that of one of them, and a center stays one on all finer levels.

    order: points, those of a leaf together; center: a point of each node;
    radius: how far its points lie from that at most; children: where those of
    a node begin (its own are up to the next node's); the points of leaf i are
    order[start[i]:start[i + 1]].  levels: where each level's nodes begin.
    """

    order: np.ndarray
    levels: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    start: np.ndarray


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, exact; as doubles where these hold them."""
    small = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) <= EXACT // max(1, int(np.sqrt(x.shape[1])))
    a, b = (v.astype(np.float64 if small else np.int64) for v in (x, y))
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """Cover tree of distinct or repeated points (at least one), by farthest-first traversal.

    The next center is the point farthest from all before; its distance then is
    the radius that those before cover.  So the centers up to a radius of 2**i
    are a level: separated, covering and nested.  It ends when there are enough
    centers for leaves of ``leaf`` points, or when all points are centers' copies.
    """
    n = len(points)
    x = points.astype(np.float64)
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    centers, gaps, owner = [0], [np.inf], np.zeros(n, np.int64)
    while len(centers) * leaf < n:
        p = int(far.argmax())
        if far[p] <= 0:
            break
        gaps.append(float(far[p]))
        d = np.sqrt(((x - x[p]) ** 2).sum(1))
        nearer = d < far
        owner[nearer] = len(centers)
        np.minimum(far, d, out=far)
        centers.append(p)
    c, gap = np.array(centers), np.array(gaps)
    # Levels by powers of two of the gap, coarse to fine: the first has the first center alone.
    powers = np.ceil(np.log2(gap[1:])).astype(np.int64) if len(c) > 1 else np.zeros(0, np.int64)
    sizes = [1, *(int(1 + np.flatnonzero(powers >= p)[-1] + 1) for p in sorted(set(powers.tolist()), reverse=True))]
    leaf_of, parent_of = owner, []
    for above, here in zip(sizes[:-1], sizes[1:], strict=True):
        near = _squares(points[c[:here]], points[c[:above]])
        up = near.argmin(1)
        up[:above] = np.arange(above)
        parent_of.append(up)
    # Nodes of each level are put in the order of their parents, from the top.
    ranks, places = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for up, here in zip(parent_of, sizes[1:], strict=True):
        by = ranks[-1][up]
        place = np.argsort(by, kind="stable")
        rank = np.empty(here, np.int64)
        rank[place] = np.arange(here)
        ranks.append(rank)
        places.append(place)
    levels = np.concatenate([[0], np.cumsum(sizes)])
    center = np.concatenate([c[p] for p in places])
    order = np.argsort(ranks[-1][leaf_of], kind="stable")
    start = np.searchsorted(ranks[-1][leaf_of][order], np.arange(sizes[-1] + 1))
    children, radius = [], []
    at = leaf_of
    for level in range(len(sizes) - 1, -1, -1):
        d = np.sqrt(((x - x[c[at]]) ** 2).sum(1))
        r = np.zeros(sizes[level])
        np.maximum.at(r, ranks[level][at], d)
        radius.append(r)
        if level:
            up = parent_of[level - 1]
            children.append(levels[level] + np.searchsorted(ranks[level - 1][up][places[level]], np.arange(sizes[level - 1])))
            at = up[at]
    return CoverTree(order, levels, center, np.concatenate(radius[::-1]), np.concatenate([*children[::-1], np.zeros(0, np.int64)]).astype(np.int64), start)


def _children(tree: CoverTree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child of each node of a level, and how many it has."""
    ends = np.append(tree.children[tree.levels[level] : tree.levels[level + 1]], tree.levels[level + 2])
    local = nodes - tree.levels[level]
    return ends[local], ends[local + 1] - ends[local]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the number in it, of all numbers of the ranges."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _pruned(v: np.ndarray, c: np.ndarray, tree: CoverTree, points: np.ndarray, ctree: CoverTree, centroids: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a vector node and a centroid node that may hold a nearest centroid."""
    a, b = points[tree.center[v]].astype(np.float64), centroids[ctree.center[c]].astype(np.float64)
    d = np.sqrt(((a - b) ** 2).sum(1))
    # A node's center is a centroid itself, so no vector below v is farther from its nearest than this.
    nearest = np.full(int(v.max()) + 1, np.inf)
    np.minimum.at(nearest, v, d + tree.radius[v])
    keep = d - tree.radius[v] - ctree.radius[c] <= nearest[v] + slack
    return v[keep], c[keep]


def candidates(tree: CoverTree, points: np.ndarray, ctree: CoverTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, centroid) pairs that bounds on distances leave, in order; each leaf has one at least.

    Both trees are descended by a level in turn.  Of the centroids' tree a leaf
    holds copies of one centroid, of which the smallest number stands for all.
    """
    slack = SLACK * (1 + float(np.abs(points).max(initial=0)) + float(np.abs(centroids).max(initial=0)))
    v, c, vl, cl = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    v_deep, c_deep = len(tree.levels) - 2, len(ctree.levels) - 2
    while True:
        v, c = _pruned(v, c, tree, points, ctree, centroids, slack)
        if cl < c_deep and (cl <= vl or vl == v_deep):
            which, c = _spread(*_children(ctree, cl, c))
            v, cl = v[which], cl + 1
        elif vl < v_deep:
            which, v = _spread(*_children(tree, vl, v))
            c, vl = c[which], vl + 1
        else:
            break
    leaf, group = v - tree.levels[vl], c - ctree.levels[cl]
    order = np.lexsort((group, leaf))
    return leaf[order], group[order]


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point and its squared distance; of equally near ones the smallest number."""
    # Leaves of single centroids: copies are left to the smallest number.
    _, first, copy_of = np.unique(centroids, axis=0, return_index=True, return_inverse=True)
    kept = np.sort(first)
    ctree = cover_tree(centroids[kept], leaf=1)
    number = kept[ctree.order]  # by leaf: each holds one
    leaf, group = candidates(tree, points, ctree, centroids[kept])
    number = number[ctree.start[:-1]]
    cluster, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    bounds = np.searchsorted(leaf, np.arange(len(tree.start)))
    for k in range(len(tree.start) - 1):
        rows = tree.order[tree.start[k] : tree.start[k + 1]]
        some = np.sort(number[group[bounds[k] : bounds[k + 1]]])
        d = _squares(points[rows], centroids[some])
        best = d.argmin(1)
        cluster[rows], distance[rows] = some[best], d[np.arange(len(rows)), best]
    return cluster, distance


_BLOCK = pa.schema({"ids": pa.binary(), "vectors": pa.binary(), "copies": pa.binary(), "tree": pa.binary()})


def _ipc(**columns: pa.Array | np.ndarray) -> bytes:
    """Columns of one length each as Arrow IPC, a record batch for each."""
    out = pa.BufferOutputStream()
    for name, values in columns.items():
        batch = pa.record_batch({name: values})
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _read(data: bytes) -> dict[str, np.ndarray]:
    source, out = pa.BufferReader(data), {}
    while source.tell() < len(data):
        with pa.ipc.open_stream(source) as r:
            for batch in r:
                out[batch.schema.names[0]] = batch.column(0)
    return out


def _blocks(vectors: DataFrame, dim: int, block: int, leaf: int) -> DataFrame:
    """Blocks of vectors, each with its cover tree over the different ones among them; written once."""
    names = ("order", "levels", "center", "radius", "children", "start")

    def built(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        unique, copies = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        tree = cover_tree(unique, leaf)
        packed = {n: pa.array(getattr(tree, n)) for n in names}
        narrow = next((t for t in (np.int16, np.int32) if np.abs(unique).max(initial=0) <= np.iinfo(t).max), np.int64)
        return pa.record_batch(
            [[_ipc(ids=pa.concat_arrays(ids))], [_ipc(vectors=unique.astype(narrow).ravel())], [_ipc(copies=copies.ravel().astype(np.int32))], [_ipc(**packed)]], schema=_BLOCK
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, n = [], [], 0
        for batch in batches:
            at = 0
            flat = np.floor(256.0 * batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
            if np.abs(flat).max(initial=0) > MOST:
                raise ValueError(f"a component times 256 is beyond {MOST}")
            flat = flat.astype(np.int64)
            while at < len(flat):
                to = min(len(flat), at + block - n)
                ids.append(batch.column("id").slice(at, to - at))
                rows.append(flat[at:to])
                n, at = n + to - at, to
                if n == block:
                    yield built(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield built(ids, rows)

    return save(vectors.mapInArrow(run, "ids binary, vectors binary, copies binary, tree binary"), "cover-trees")


def _opened(batch: pa.RecordBatch, i: int, dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray, CoverTree]:
    ids, points, copies, tree = (_read(batch.column(c)[i].as_py()) for c in _BLOCK.names)
    arrays = {k: v.to_numpy(zero_copy_only=False) for k, v in tree.items()}
    return ids["ids"], points["vectors"].to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim), copies["copies"].to_numpy(zero_copy_only=False), CoverTree(**arrays)


def _sums(blocks: DataFrame, centroids: np.ndarray, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Vectors and componentwise sums of each centroid that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, points, copies, tree = _opened(batch, i, dim)
                cluster, _ = nearest(points, tree, centroids)
                weight = np.bincount(copies, minlength=len(points))
                np.add.at(count, cluster, weight)
                np.add.at(total, cluster, points * weight[:, None])
        some = np.flatnonzero(count)
        if len(some):
            yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some]), "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    each = blocks.mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    summed = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(dim))).alias("total"))
    return {r["cluster"]: (r["n"], r["total"]) for r in summed.collect()}


def lloyd(
    vectors: DataFrame, *, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of each vector kept.

    Kept are vectors of exactly ``dim`` components, none null or not finite.
    Component x becomes floor(256 x); beyond 2**27 in size that is an error, as
    squares would not fit.  The first centroids are the k kept vectors with the
    smallest SHA-256 of seed and id (a null id counts as an empty one; of equal
    ids the smaller vector comes first); with fewer vectors all are.  Each round
    assigns every vector to its nearest centroid, ties to the smaller number, and
    puts each centroid that has some at the floor of their mean.  Repeated rows
    are rows each.  An empty table gives no rows.  Other columns aren't read.
    The driver holds k centroids, and k sums in each round.
    """
    one, other = F.col(f"`{id_col}`"), F.col(f"`{vector}`").cast("array<double>")
    fine = (F.size(other) == dim) & F.forall(other, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(one.alias("id"), other.alias("vector")).where(F.coalesce(fine, F.lit(False)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    whole = F.transform("vector", lambda x: F.floor(256 * x))
    first = kept.select(digest.alias("digest"), whole.alias("vector")).orderBy("digest", "vector").limit(k).collect()
    kind = dict(vectors.dtypes)[id_col]
    if not first:
        return kept.select(F.col("id").alias("vec_id"), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid", "array<bigint>"))))
    centroids = np.array([r["vector"] for r in first], np.int64)
    if np.abs(centroids).max(initial=0) > MOST:
        raise ValueError(f"a component times 256 is beyond {MOST}")
    blocks = _blocks(kept, dim, block, leaf)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in _sums(blocks, centroids, dim).items():
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, points, copies, tree = _opened(batch, i, dim)
                cluster, distance = nearest(points, tree, centroids)
                yield pa.record_batch({"vec_id": ids, "cluster": pa.array(cluster[copies], pa.int32()), "distance": pa.array(distance[copies])})

    placed = save(blocks.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "clusters")
    drop(blocks.sparkSession, saved_path(blocks))
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    told = [(c, x, sum(inertia.values()), centroids[c].tolist()) for c, x in sorted(inertia.items())]
    # One row for each of the k centroids.
    clusters = F.broadcast(placed.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>"))
    return placed.join(clusters, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
