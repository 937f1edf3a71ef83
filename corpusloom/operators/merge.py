"""Keyed upserts and replacements on immutable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per key the row with the greatest ``order``: an aggregation, so copies combine before the shuffle."""
    columns = rows.columns
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return best.select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins: ``new`` replaces ``old``; of several new rows of a key the greatest ``order`` stays.

    Columns missing on one side become null.
    """
    new = _latest(new, keys, order)
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First write wins: keys in ``old`` stay; of several new rows of a key the smallest ``order`` goes in."""
    columns = new.columns
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row")).select("_row.*")
    return old.unionByName(first, allowMissingColumns=True)


def classify_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Each key with ``action``: inserted, updated, skipped (same version) or kept (not in ``new``)."""
    o = old.select(*keys, F.col(version).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.col(version).alias("_new"), F.lit(True).alias("_in_new"))
    action = F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "kept").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
    return o.join(n, list(keys), "full_outer").select(*keys, action.alias("action"))


def change_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str, owned: Sequence[str]) -> DataFrame:
    """Upsert only where the version changed; ``owned`` columns keep their old values."""
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.lit(True).alias("_o"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    n = new.select(*keys, F.lit(True).alias("_n"), *(F.col(c).alias(f"_n_{c}") for c in columns if c in new.columns))
    take = F.col("_n").isNotNull() & (F.col("_o").isNull() | ~F.col(f"_o_{version}").eqNullSafe(F.col(f"_n_{version}")))
    pick = [
        (F.coalesce(f"_o_{c}", f"_n_{c}") if c in owned and c in new.columns else F.when(take, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")) if c in new.columns else F.col(f"_o_{c}")).alias(c)
        for c in columns
    ]
    return o.join(n, list(keys), "full_outer").select(*keys, *pick).select(*old.columns)


def replace_partition(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every group of ``keys`` in ``new`` replaces that group of ``old``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete_docs(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def backfill(df: DataFrame, lookup: DataFrame, on: str, column: str, default: str | None = None) -> DataFrame:
    """``column`` from a lookup table where the row has none."""
    found = lookup.select(on, F.col(column).alias("_found"))
    given = F.coalesce(F.col(column) if column in df.columns else F.lit(None), "_found", F.lit(default))
    columns = [c for c in df.columns if c != column]
    return df.join(found, on, "left").select(*columns, given.alias(column))


def append_defaults(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """``extra`` rows join where the key has no real row."""
    return rows.unionByName(extra.join(rows.select(key), key, "left_anti"))


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "position", start: int = 1) -> DataFrame:
    """Running numbers within each group; the group keys must spread the rows."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1))


def number_all(df: DataFrame, order: Sequence, name: str = "id", start: int = 1) -> DataFrame:
    """Running numbers over all rows in ``order``, without a window over them.

    Rows are dealt to ranges of the order and sorted there, written with their place,
    and counted per range; a range's first number is the sum of the counts before it.
    The counts are one number a partition.  Rows that the order doesn't tell apart
    get their numbers in any order, but keep them, as the places are stored.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33).cast("int")
    first, at = [], start
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row a partition
        first.append((r.part, at))
        at += r.n
    firsts = F.broadcast(df.sparkSession.createDataFrame(first, "_part int, _first long"))
    rows = placed.withColumn("_part", part).join(firsts, "_part")
    return rows.withColumn(name, F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_place")


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence, columns: Sequence[str]) -> DataFrame:
    """Nulls take the last value above them in their group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def split_years(df: DataFrame, date: str, path: str) -> None:
    """One directory per year; years without rows get none."""
    df.withColumn("year", F.year(F.col(date))).write.mode("overwrite").partitionBy("year").parquet(path)
