"""Nearest neighbours, rank fusion and hydration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import l2, reciprocal_rank

#: Bounds of the numbers that a caller may ask for.
K_MOST, TOP_MOST, CANDIDATES = 4_096, 100, (10, 200)


def knn(vectors: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding", allow: DataFrame | None = None, most: int | None = K_MOST) -> DataFrame:
    """(key, distance): the exact k nearest, among the allowed keys if given.

    A k beyond ``most`` gives ``most`` rows, which is the contract of a page; None sets no bound.

    The allowlist is a semi join before the top-k, so a narrow scope can't be
    starved by nearer vectors outside it.
    """
    if k < 1:
        raise ValueError("k must be positive")
    scope = vectors if allow is None else vectors.join(allow.select(key).distinct(), key, "left_semi")
    q = F.array(*(F.lit(float(x)) for x in query))
    return scope.select(key, l2(F.col(vector), q).alias("distance")).orderBy("distance", key).limit(k if most is None else min(k, most))


def ranked(hits: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """Ranks from 1 by score, then key; ``hits`` is a top-k, at most ``K_MOST`` rows."""
    return hits.select(key, F.row_number().over(Window.orderBy(score, key)).alias(name))


def fuse(dense: DataFrame | None, sparse: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two top-k lists: (key, score, dense_rank, sparse_rank, used_dense).

    ``dense`` (key, distance) may be None, when no query vector could be made.
    """
    s = ranked(sparse, "score", key, "sparse_rank")
    if dense is None:
        both = s.withColumn("dense_rank", F.lit(None).cast("int"))
    else:
        both = ranked(dense, "distance", key, "dense_rank").join(s, key, "full_outer")
    part = lambda c: F.coalesce(reciprocal_rank(F.col(c), k), F.lit(0.0))
    return both.select(key, (part("dense_rank") + part("sparse_rank")).alias("score"), "dense_rank", "sparse_rank", F.lit(dense is not None).alias("used_dense"))


def fused_top(fused: DataFrame, k: int, key: str) -> DataFrame:
    """Best first; ties keep the dense order, then the sparse one."""
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), key).limit(k)


def hydrate(hits: DataFrame, chunks: DataFrame, meta: DataFrame, key: str = "chunk_id", doc: str = "doc_id") -> DataFrame:
    """Chunk text and document data of a top-k of at most ``K_MOST`` hits, which are the broadcast side; data are null where missing."""
    return chunks.join(F.broadcast(hits.limit(K_MOST)), key).join(meta, doc, "left")


def retrieve(query: str, point: Sequence[float] | None, chunks: DataFrame, vectors: DataFrame, meta: DataFrame, find: Callable[[str, int, DataFrame | None], DataFrame], top_k: int = 20, candidate_k: int = 50, allow: DataFrame | None = None, key: str = "chunk_id", doc: str = "doc_id") -> DataFrame:
    """Hybrid search: the ``top_k`` best chunks with their documents' data, in fused order (column ``rank``).

    ``chunks`` (key, doc, ..), ``vectors`` (key, embedding), ``meta`` (doc, ..);
    ``find(query, k, allow)`` is the sparse arm, as :meth:`TextIndex.top`.  The dense arm is left out where ``point`` is
    None (no query vector could be made), which ``used_dense`` tells.  ``allow``
    (key) limits both arms before their top-k; None means no limit, an empty one
    gives nothing, as does a blank query.
    """
    if not 1 <= top_k <= TOP_MOST:
        raise ValueError(f"top_k must be 1 to {TOP_MOST}")
    if not CANDIDATES[0] <= candidate_k <= CANDIDATES[1]:
        raise ValueError(f"candidate_k must be {CANDIDATES[0]} to {CANDIDATES[1]}")
    sparse = find(query, candidate_k, allow)
    dense = knn(vectors, point, candidate_k, key, allow=allow) if point is not None and query.strip() else None
    best = fused_top(fuse(dense, sparse, key), top_k, key)
    order = Window.orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), key)
    placed = best.withColumn("rank", F.row_number().over(order))  # top_k rows
    return hydrate(placed, chunks, meta, key, doc).orderBy("rank")


def scope(meta: DataFrame, key: str, **wanted: Sequence | None) -> DataFrame | None:
    """The keys whose columns hold one of the wanted values each; None (no limit) where nothing is asked for."""
    given = {c: list(v) for c, v in wanted.items() if v is not None}
    if not given:
        return None
    rows = meta
    for column, values in given.items():
        rows = rows.filter(F.col(column).isin(*values))
    return rows.select(key).distinct()
