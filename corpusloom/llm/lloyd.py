"""Centroid clustering: exact Lloyd rounds on integer vectors by a dual-tree search.

Each task cuts its vectors into blocks and builds a cover tree over each block,
once; blocks with their trees are a table that the rounds read.  A round builds a
tree over the centroids and walks pairs of a vector node and a centroid node:
pairs whose least distance exceeds the greatest distance to some other centroid
go, a vector node with one centroid left is assigned whole, and leaves with more
are compared in integers.  Tasks send one sum per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Vectors in a block; the distances that its tree is built from take 8 * BLOCK ** 2 bytes.
BLOCK = 1024
#: A child of the cover tree covers points within its parent's radius divided by this.
SHRINK = 1.3
#: Scaled components are smaller than this, so that squared distances fit 64 bits.
LARGEST = 1 << 26


class Tree(NamedTuple):
    """Nodes numbered by breadth; a node holds the places ``start`` to ``end``, all within ``radius`` of its centre."""

    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # the first child's number; the others follow it
    children: np.ndarray  # 0 at a leaf


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def cover_tree(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over integer ``points`` and their order; a node's centre is the point at its first place.

    A node's children are centred on points farther than ``radius / SHRINK`` from
    each other, the farthest point left being taken until all are covered; every
    point goes to its nearest centre.  A leaf's points are equal.
    """
    x = points.astype(np.float64)
    distance = _distances(x, x)
    np.fill_diagonal(distance, 0)
    order = np.arange(len(points))
    start, end, radius, child, children = [0], [len(points)], [], [], []
    node = 0
    while node < len(start):
        own = order[start[node] : end[node]]
        near = distance[own[0], own]
        r = float(near.max())
        group, centres = np.zeros(len(own), np.int64), 1
        if r > 0:
            while near[far := int(near.argmax())] > r / SHRINK:
                to = distance[own[far], own]
                closer = to < near
                group[closer], near[closer] = centres, to[closer]
                centres += 1
        elif (points[own] != points[own[0]]).any():  # distances that rounding has lost
            group, centres = np.arange(len(own)), len(own)
        radius.append(r)
        child.append(len(start))
        children.append(0 if centres == 1 else centres)
        if centres > 1:
            order[start[node] : end[node]] = own[np.lexsort((near, group))]  # a centre is nearest to itself
            ends = start[node] + np.cumsum(np.bincount(group, minlength=centres))
            start += [start[node], *ends[:-1].tolist()]
            end += ends.tolist()
        node += 1
    return Tree(*map(np.array, (start, end, radius, child, children))), order


def centroid_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A binary tree over the centroids, their order, and each node's centre (the mean of its centroids)."""
    x = centroids.astype(np.float64)
    order = np.arange(len(x))
    start, end, radius, child, children, centre = [0], [len(x)], [], [], [], []
    node = 0
    while node < len(start):
        own = order[start[node] : end[node]]
        middle = x[own].mean(0) if len(own) > 1 else x[own[0]]
        centre.append(middle)
        away = np.sqrt(((x[own] - middle) ** 2).sum(1))
        radius.append(float(away.max()) if len(own) > 1 else 0.0)
        child.append(len(start))
        children.append(2 if len(own) > 1 else 0)
        if len(own) > 1:
            one = x[own[away.argmax()]]
            other = x[own[((x[own] - one) ** 2).sum(1).argmax()]]
            side = ((x[own] - one) ** 2).sum(1) - ((x[own] - other) ** 2).sum(1)
            order[start[node] : end[node]] = own[np.argsort(side, kind="stable")]
            half = start[node] + min(max(1, int((side < 0).sum())), len(own) - 1)
            start += [start[node], half]
            end += [half, end[node]]
        node += 1
    return Tree(*map(np.array, (start, end, radius, child, children))), order, np.array(centre)


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((points - centroids) ** 2).sum(-1)


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places where a run begins, its centroid, pairs compared exactly): runs of places with one nearest centroid.

    ``points`` lie in the tree's order.  Ties go to the smaller centroid.
    """
    over, order, centre = centroid_tree(centroids)
    x = points.astype(np.float64)
    slack = 1e-6 * (1 + max(np.sqrt((x * x).sum(1).max()), np.sqrt((centre * centre).sum(1).max())))
    most = np.full(len(tree.start), np.inf)  # no point of the node is farther from its centroid
    begins, labels, compared = [], [], 0
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(v):
        apart = np.sqrt(((x[tree.start[v]] - centre[c]) ** 2).sum(1))
        np.minimum.at(most, v, apart + tree.radius[v] + over.radius[c])
        kept = apart - tree.radius[v] - over.radius[c] <= most[v] + slack
        v, c = v[kept], c[kept]
        split = over.children[c] > 0
        pairs, open_ = np.bincount(v, minlength=len(most)), np.bincount(v[split], minlength=len(most))
        whole = (pairs[v] == 1) & ~split
        begins.append(tree.start[v[whole]])
        labels.append(order[over.start[c[whole]]])
        # The wider side of a node's pairs is opened: the centroids if any of theirs is as wide as the node.
        wide = np.zeros(len(most))
        np.maximum.at(wide, v[split], over.radius[c[split]])
        by_centroid = (open_[v] > 0) & ((wide[v] >= tree.radius[v]) | (tree.children[v] == 0))
        exact = ~whole & (open_[v] == 0) & (tree.children[v] == 0)
        if exact.any():
            at, to = v[exact], order[over.start[c[exact]]]
            compared += len(at)
            d = _squares(points[tree.start[at]], centroids[to])
            best = np.lexsort((to, d, at))
            first = np.ones(len(best), bool)
            first[1:] = at[best][1:] != at[best][:-1]
            begins.append(tree.start[at[best][first]])
            labels.append(to[best][first])
        stay = by_centroid & ~split
        opened = by_centroid & split
        down = ~whole & ~exact & ~by_centroid
        parts = tree.children[v[down]]
        below = np.repeat(tree.child[v[down]] - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
        most[below] = np.minimum(most[below], most[np.repeat(v[down], parts)])
        v, c = (
            np.concatenate([v[stay], np.repeat(v[opened], 2), below]),
            np.concatenate([c[stay], (over.child[c[opened]][:, None] + np.arange(2)).ravel(), np.repeat(c[down], parts)]),
        )
    begin, label = np.concatenate(begins), np.concatenate(labels)
    by = np.argsort(begin, kind="stable")
    return begin[by], label[by], compared


def _blocks(kind: pa.DataType, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("ids", pa.list_(kind)), ("points", pa.binary()), ("tree", pa.list_(pa.binary()))])

    def block(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree, order = cover_tree(points)
        return pa.RecordBatch.from_pydict({"ids": [ids.take(pa.array(order))], "points": [points[order].astype("<i4").tobytes()], "tree": [[a.astype("<f8" if i == 2 else "<i4").tobytes() for i, a in enumerate(tree)]]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = pa.array([], kind), np.zeros((0, dims), np.int64)
        for batch in batches:
            ids = pa.concat_arrays([ids, batch.column(0).cast(kind)])
            points = np.concatenate([points, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)])
            while len(points) >= BLOCK:
                yield block(ids[:BLOCK], points[:BLOCK])
                ids, points = ids[BLOCK:], points[BLOCK:]
        if len(points):
            yield block(ids, points)

    return run


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for ids, points, tree in zip(batch.column("ids"), batch.column("points"), batch.column("tree")):
        arrays = [np.frombuffer(a.as_py(), "<f8" if i == 2 else "<i4") for i, a in enumerate(tree.values)]
        yield ids.values, np.frombuffer(points.as_py(), "<i4").reshape(-1, dims).astype(np.int64), Tree(*(a if i == 2 else a.astype(np.int64) for i, a in enumerate(arrays)))


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, points, tree in _read(batch, dims):
                begin, label, _ = nearest(points, tree, centroids)
                np.add.at(count, label, np.diff(begin, append=len(points)))
                np.add.at(total, label, np.add.reduceat(points, begin, axis=0))
        yield pa.RecordBatch.from_pydict({"cluster": np.repeat(np.arange(k, dtype=np.int32), dims), "component": np.tile(np.arange(dims, dtype=np.int32), k), "n": np.repeat(count, dims), "total": total.ravel()})

    return run


def _assign(kind: pa.DataType, centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, points, tree in _read(batch, centroids.shape[1]):
                begin, label, _ = nearest(points, tree, centroids)
                cluster = np.repeat(label, np.diff(begin, append=len(points)))
                yield pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(cluster, pa.int32()), pa.array(_squares(points, centroids[cluster]), pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Components become ``floor(scale * x)``, x as double.  The first centroids are the
    ``k`` vectors with the smallest SHA-256 of ``seed:key``; every round assigns each
    vector to its nearest centroid (ties: the smaller number) and replaces centroids
    by the exact floor of their vectors' means; those without vectors stay.  In the
    end vectors are assigned once more.

    Vectors of other sizes or with a null, NaN or infinite component drop out, as
    null vectors do; no vector left gives no rows, fewer than ``k`` as many
    centroids.  Rows that repeat a key, or have none (hashed as ``null``), count each;
    equal hashes are ordered by the vector.  Scaled components beyond 2 ** 26 are an
    error, as their squared distances need not fit 64 bits.  Other columns aren't read.
    """
    spark = vectors.sparkSession
    whole = F.transform("raw", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("raw")).filter(usable(F.col("raw"), dims))
    small = F.forall("raw", lambda x: F.abs(x.cast("double") * scale) < LARGEST)
    rows = rows.select("vec_id", F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<bigint>")).alias("point"))
    kind = _arrow_kind(rows)
    blocks = stored(rows.mapInArrow(_blocks(kind, dims), f"ids array<{dict(rows.dtypes)['vec_id']}>, points binary, tree array<binary>"), "lloyd-blocks")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    first = rows.select(place.alias("place"), "point").orderBy("place", "point").limit(k).collect()  # k rows
    if not first:
        first = [([0] * dims,) * 2]  # there are no vectors: any centroid serves
    centroids = np.array([list(r[1]) for r in first], np.int64)
    for _ in range(rounds):
        summed = blocks.mapInArrow(_sums(centroids), "cluster int, component int, n long, total long").groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in summed.filter("n > 0").collect():  # at most k * dims rows
            centroids[r.cluster, r.component] = r.total // r.n
    assigned = stored(blocks.mapInArrow(_assign(kind, centroids), f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long"), "lloyd-assigned")
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # at most k rows
    of = [(j, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(inertia)]
    return assigned.join(F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _arrow_kind(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["vec_id"].dataType)
