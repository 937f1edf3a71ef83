"""Tables that outlive an executor: intermediate results go to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_temporary: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session has no such setting, a local master (tests on one machine)
    gets a temporary folder, one per application; on a cluster that is an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = tempfile.mkdtemp(prefix="corpusloom-")
        found = _temporary[app]
    return found.rstrip("/")


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: after the write, losing any executor costs only the tasks it
    was running.  Reading back also gives the planner real sizes.  ``keep``: the
    table outlives :func:`discarding`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """On leaving, also by an error, tables that were stored inside are deleted: what they served must be written elsewhere by then."""
    before = len(_written)
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _written[before:]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _written[before:]


#: Dropped rows up to this many are broadcast, at 16 bytes each; more go through a shuffle join.
BROADCAST_KEYS = 1_000_000


#: Groups with this share of all rows or more are sent round, so there are at most 1 / HOT_SHARE of them; no other group is large.
HOT_SHARE = 1e-4


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int, others: str = "inner", hot_share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined with their ``groups`` (one row each, with their ``size`` in rows), no task getting a large group.

    Groups of ``hot_share`` of the ``total`` or more are broadcast; the rows of the
    others are joined as ``others`` says (left: rows without a group stay).
    """
    least = max(2, int(total * hot_share))
    hot, few = F.broadcast(groups.filter(F.col(size) >= least)), groups.filter(F.col(size) < least)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(few, on, others))


def text_hash(text: Column) -> Column:
    """With the key, what identifies a row: keys may repeat or be null."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def one_of_each(docs: DataFrame, members: DataFrame, group: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group; ``members``: (doc_id, row, group) per row, ``row`` being its text's hash.

    The row with the smallest key stays (null after all others), then by the
    text's hash; of rows that repeat key and text one stays.  Rows without a group
    (null) stay.
    """
    pairs = members.filter(F.col(group).isNotNull()).groupBy(group, "doc_id", "row").agg(F.count("*").alias("times"))
    pairs = stored(pairs, "group-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # A group's first is found by partial minima and joined back to pairs, not to rows.
    first = pairs.groupBy(group).agg(F.min(place).alias("first"), F.count("*").alias("pairs"), F.max("times").alias("most")).filter("pairs > 1 OR most > 1")
    judged = join_groups(pairs, stored(first, "group-first"), group, "pairs", pairs.count())
    judged = judged.select("doc_id", "row", "times", (place == F.col("first")).alias("stays"))
    out = stored(judged.filter("NOT stays OR times > 1"), "group-out")
    rows = docs.withColumn(_ROW, text_hash(F.col(text)))
    left = _on_rows(rows, out, key, "left_anti")
    repeated = out.filter("stays")
    if not repeated.isEmpty():
        left = left.unionByName(_on_rows(rows, repeated, key, "left_semi").dropDuplicates([key, _ROW]))
    return left.select(*docs.columns)


_ROW = "row hash of one_of_each"


def _on_rows(rows: DataFrame, chosen: DataFrame, key: str, how: str) -> DataFrame:
    chosen = chosen.select(F.col("doc_id").alias("chosen key"), F.col("row").alias("chosen row"))
    if chosen.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, F.col(key).eqNullSafe(F.col("chosen key")) & (F.col(_ROW) == F.col("chosen row")), how)
