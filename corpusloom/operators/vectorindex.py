"""A stored vector index in cells, searched exactly: cells that the triangle inequality rules out aren't read.

Cells are the nearest regions of sampled centres.  A cell keeps its centre, radius and
number of vectors; large cells lie in slices, so that a cell of copies is many rows of
many tasks.  A query's k-th distance is bounded by what its nearest cells hold, and a
cell is read if its centre's distance less its radius is within that bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vector import l2
from ..sources.scratch import written
from ..sources.versions import Versions

#: Bounds of the number of cells; their centres are held by every task.
CELLS = (1, 4096)
#: Vectors in a slice of a cell: a task holds one slice while queries pass.
SLICE = 8192
#: Distances are told apart beyond this share of themselves.
CLOSE = 1e-9


def _nearest_cell(centres: np.ndarray, kind: pa.DataType):
    half = (centres * centres).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            points = _matrix(batch.column("vector"), centres.shape[1])
            cell = np.concatenate([(half - points[i : i + 1024] @ centres.T).argmin(1) for i in range(0, len(points), 1024)])
            away = np.sqrt(((points - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(kind), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(away)], names=["key", "vector", "cell", "away"])

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


class VectorIndex:
    """Vectors (key, vector of one size) in cells below ``root``; vectors of other sizes and nulls are left out.

    :meth:`build` makes a new version and publishes it last.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.key, self.vector, self.versions = spark, key, vector, Versions(spark, root)

    def build(self, vectors: DataFrame, dims: int, cells: int | None = None) -> None:
        """Cells around the ``cells`` vectors whose keys have the smallest hashes; by default the square root of their number.

        The vectors are read for their number, once more for the sample, and once to be
        dealt to cells; they are shuffled once, by cell and slice.
        """
        number, _ = self.versions.latest()
        fine = F.forall(self.vector, lambda x: x.isNotNull() & ~F.isnan(x))
        rows = vectors.select(F.col(self.key).alias("key"), F.col(self.vector).cast("array<double>").alias("vector")).filter((F.size(F.col(self.vector)) == dims) & fine)
        n = rows.count()
        wanted = min(max(cells or math.isqrt(n), CELLS[0]), CELLS[1])
        centres = rows.orderBy(F.xxhash64("key"), "key").limit(wanted).select("vector").collect()  # at most CELLS[1] rows
        centres = np.unique(np.array([r.vector for r in centres], np.float64).reshape(-1, dims), axis=0)
        kind = to_arrow_type(rows.schema["key"].dataType)
        name = f"v={number + 1}"
        root = f"{self.versions.root}/{name}"
        self.versions.delete(name)
        key_kind = dict(rows.dtypes)["key"]
        dealt = written(rows.mapInArrow(_nearest_cell(centres, kind), f"key {key_kind}, vector array<double>, cell int, away double") if n else rows.select("key", "vector", F.lit(0).alias("cell"), F.lit(0.0).alias("away")), "vector-cells")
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # a row a cell
        table = [(r.cell, centres[r.cell].tolist(), r.radius, r.n, -(-r.n // SLICE)) for r in sizes]
        self.spark.createDataFrame(table, "cell int, centre array<double>, radius double, n long, slices int").coalesce(1).write.parquet(f"{root}/cells")
        slices = F.broadcast(self.spark.createDataFrame([(c, s) for c, _, _, _, s in table], "cell int, slices int"))
        cut = dealt.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("key", "vector"), "slices").cast("int"))
        cut.repartition("cell", "slice").sortWithinPartitions("cell", "slice").select("key", "vector", "slice", "cell").write.partitionBy("cell").parquet(f"{root}/vectors")
        self.versions.publish(number + 1, {"name": name, "key": key_kind, "dims": dims, "n": n})

    def _manifest(self) -> dict:
        return self.versions.latest()[1]

    def cells(self) -> DataFrame:
        """cell, centre, radius, n, slices."""
        m = self._manifest()
        return self.spark.read.schema("cell int, centre array<double>, radius double, n long, slices int").parquet(f"{self.versions.root}/{m['name']}/cells")

    def vectors(self, cells: Sequence[int] | None = None) -> DataFrame:
        """key, vector, slice, cell; of some cells alone, whose folders are read, if they are given."""
        m = self._manifest()
        rows = self.spark.read.schema(f"key {m['key']}, vector array<double>, slice int, cell int").parquet(f"{self.versions.root}/{m['name']}/vectors")
        return rows if cells is None else rows.filter(F.col("cell").isin([int(c) for c in cells]))

    def nearest(self, point: Sequence[float], k: int, allow: DataFrame | None = None) -> DataFrame:
        """(key, distance): the k nearest in order, among the keys of ``allow`` if given; equal distances by key.

        Cells are read from the nearest on until k vectors are found; then those cells
        that can hold a nearer one.
        """
        q = np.array(point, np.float64)
        about = [(float(np.sqrt(((np.array(r.centre) - q) ** 2).sum())), r.radius, r.n, r.cell) for r in self.cells().collect()]
        about = sorted((max(0.0, d - radius), d, n, cell) for d, radius, n, cell in about)
        to = F.array(*(F.lit(float(x)) for x in point))

        def best(cells: Sequence[int]) -> DataFrame:
            rows = self.vectors(cells).withColumnRenamed("key", self.key)
            if allow is not None:
                rows = rows.join(allow.select(self.key).distinct(), self.key, "left_semi")
            return rows.select(self.key, l2(F.col("vector"), to).alias("distance")).orderBy("distance", self.key).limit(k)

        size, seen = 0, 0
        while size < len(about) and seen < k:
            seen, size = seen + about[size][2], size + 1
        while size < len(about):
            found = best([c for *_, c in about[:size]]).agg(F.count("*").alias("n"), F.max("distance").alias("worst")).first()
            if found.n == k:
                reach = found.worst * (1 + CLOSE)
                size = max(size, sum(low <= reach for low, *_ in about))
                break
            size *= 4
        return best([c for *_, c in about[:size]])

    def nearest_each(self, queries: DataFrame, k: int, query_key: str, vector: str | None = None) -> DataFrame:
        """query_key, neighbour, distance, rank: the k nearest of every query; equal distances by key.

        Each query first meets its own nearest cells, as many as hold k vectors, which
        bounds its k-th distance; then all cells within the bound.  Queries travel to
        the slices they meet, each vector to its slice once: a task holds a slice and
        lets the queries pass.
        """
        met, _ = self._met(queries, k, query_key, vector)
        return met

    def cells_met(self, queries: DataFrame, k: int, query_key: str, vector: str | None = None) -> DataFrame:
        """query_key, met, cells: how many cells each query had to meet, of how many there are."""
        _, pairs = self._met(queries, k, query_key, vector)
        return pairs.groupBy("query").agg(F.count_distinct("cell").alias("met")).select(F.col("query").alias(query_key), "met", F.lit(self.cells().count()).alias("cells"))

    def _met(self, queries: DataFrame, k: int, query_key: str, vector: str | None) -> tuple[DataFrame, DataFrame]:
        dims = self._manifest()["dims"]
        rows = queries.select(F.col(query_key).alias("query"), F.col(vector or self.vector).cast("array<double>").alias("point")).filter(F.size("point") == dims)
        cells = self.cells().collect()  # at most CELLS[1] rows
        table = (np.array([r.centre for r in cells]).reshape(-1, dims), np.array([r.radius for r in cells]), np.array([r.n for r in cells]), np.array([r.cell for r in cells]))
        slices = F.broadcast(self.cells().select("cell", "slices"))
        query_kind, key_kind = dict(rows.dtypes)["query"], self._manifest()["key"]
        each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))

        def spread(asked: DataFrame) -> DataFrame:
            return asked.join(slices, "cell").withColumn("slice", each).drop("slices")

        q = to_arrow_type(rows.schema["query"].dataType)
        first = rows.mapInArrow(_pairs(table, k, q), f"query {query_kind}, point array<double>, cell int, reach double")
        near = written(self._compared(spread(first), k, query_kind, key_kind), "vector-first")
        worst = near.groupBy("query").agg(F.sort_array(F.collect_list("distance")).alias("d")).select("query", F.when(F.size("d") >= k, F.col("d")[k - 1]).otherwise(float("inf")).alias("reach"))
        every = rows.join(worst, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        pairs = written(every.mapInArrow(_pairs(table, None, q), f"query {query_kind}, point array<double>, cell int, reach double"), "vector-pairs")
        found = self._compared(spread(pairs), k, query_kind, key_kind)
        placed = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))).filter(F.col("rank") <= k)
        return placed.select(F.col("query").alias(query_key), "neighbour", "distance", "rank"), pairs

    def _compared(self, asked: DataFrame, k: int, query_kind: str, key_kind: str) -> DataFrame:
        """(query, neighbour, distance): of each slice a query meets, its k nearest within reach."""
        vectors = self.vectors().select("cell", "slice", "key", "vector", F.lit(None).cast(query_kind).alias("query"), F.lit(None).cast("double").alias("reach"), F.lit(0).alias("side"))
        met = asked.select("cell", "slice", F.lit(None).cast(key_kind).alias("key"), F.col("point").alias("vector"), "query", "reach", F.lit(1).alias("side"))
        rows = vectors.unionByName(met).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "side")
        return rows.mapInArrow(_compare(k, self._manifest()["dims"], to_arrow_type(asked.schema["query"].dataType), to_arrow_type(self.vectors().schema["key"].dataType)), f"query {query_kind}, neighbour {key_kind}, distance double")


def _pairs(table: tuple, k: int | None, kind: pa.DataType):
    """Queries with each cell they must meet: with a k, the nearest cells that hold k vectors; else all within reach."""
    centres, radius, n, names = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not len(centres):
                continue
            points = _matrix(batch.column("point"), centres.shape[1])
            away = np.sqrt(np.maximum((points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T, 0))
            slack = 1e-6 * (1 + np.sqrt((points**2).sum(1)) + np.sqrt((centres**2).sum(1)).max())
            if k is not None:
                order = np.argsort(away, 1)
                held = np.cumsum(n[order], 1) - n[order]
                query, at = np.nonzero(held < k)
                cell, reach = order[query, at], np.full(len(query), np.inf)
            else:
                limit = batch.column("reach").to_numpy(zero_copy_only=False)
                query, cell = np.nonzero(away - radius <= (limit * (1 + CLOSE) + slack)[:, None])
                reach = limit[query]
            at = pa.array(query)
            for i in range(0, len(query), 4096):
                part = at[i : i + 4096]
                yield pa.RecordBatch.from_arrays([batch.column("query").take(part).cast(kind), batch.column("point").take(part), pa.array(names[cell[i : i + 4096]], pa.int32()), pa.array(reach[i : i + 4096])], names=["query", "point", "cell", "reach"])

    return run


def _compare(k: int, dims: int, query_kind: pa.DataType, key_kind: pa.DataType):
    names = ["query", "neighbour", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, points, square = None, [], [], None
        for batch in batches:
            side = batch.column("side").to_numpy()
            where = np.stack([batch.column("cell").to_numpy(), batch.column("slice").to_numpy()], 1)
            change = np.flatnonzero((np.diff(side) != 0) | (np.diff(where, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *change], [*change, len(batch)]):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                if tuple(where[a]) != at:
                    at, keys, points = tuple(where[a]), [], []
                if side[a] == 0:
                    keys.append(part.column("key"))
                    points.append(_matrix(part.column("vector"), dims))
                    continue
                if not keys:
                    continue
                if len(keys) > 1:
                    keys, points = [pa.concat_arrays(keys)], [np.concatenate(points)]
                yield from _meet(part, keys[0], points[0])

    def _meet(part: pa.RecordBatch, keys: pa.Array, points: np.ndarray) -> Iterator[pa.RecordBatch]:
        asked, reach = _matrix(part.column("vector"), dims), part.column("reach").to_numpy(zero_copy_only=False)
        rank = np.empty(len(keys), np.int64)
        rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        for i in range(0, len(asked), 64):
            d = np.stack([np.sqrt(((points - x) ** 2).sum(1)) for x in asked[i : i + 64]])
            best = np.lexsort((np.broadcast_to(rank, d.shape), d), axis=1)[:, :k]
            near = np.take_along_axis(d, best, 1)
            query, place = np.nonzero(near <= (reach[i : i + 64] * (1 + CLOSE))[:, None])
            if len(query):
                yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(query + i)).cast(query_kind), keys.take(pa.array(best[query, place])).cast(key_kind), pa.array(near[query, place])], names=names)

    return run
