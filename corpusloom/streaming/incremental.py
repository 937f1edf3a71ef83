"""Incremental ingestion: file streams merged into tables, watermarks kept by checkpoints, windows over events."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert
from ..sources.keyed import BUCKETS, KeyedTable


def ingest(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], order: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    mark: Callable[[dict, DataFrame], dict] | None = None, buckets: int = BUCKETS,
) -> None:
    """Merge files that arrived since the last call into the :class:`KeyedTable` at ``target``.

    The checkpoint knows the files done.  A batch rewrites the buckets that its keys
    fall into and publishes them with its number and, where ``mark(old, batch)``
    gives one, the new watermark: a batch that stopped before is repeated whole, one
    that was published and is sent again changes nothing, its watermark included.
    """
    table = KeyedTable(spark, target, keys, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        state = table.state
        if state.get("batch", -1) >= number:
            return
        new = prepare(batch).persist()
        try:
            moved = {**state, "batch": number} | ({"mark": mark(state.get("mark", {}), new)} if mark else {})
            table.merge(new, lambda old, rows: upsert(old, rows, keys, order), moved)
        finally:
            new.unpersist()
        table.clean(keep=2)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of an ingested table's last version, or None."""
    return KeyedTable(spark, target, []).read()


def state_of(spark: SparkSession, target: str) -> dict:
    """What was published with the last version: the batch's number and the watermark."""
    return KeyedTable(spark, target, []).state


# ---- watermarks -----------------------------------------------------------------------------------


def date_mark(column: str, replay: bool = False) -> Callable[[dict, DataFrame], dict]:
    """The latest date seen, as ``{"date": ..}``; it never goes back, and rows that are replayed don't move it."""

    def mark(old: dict, batch: DataFrame) -> dict:
        seen = None if replay else batch.agg(F.max(F.col(column).cast("date")).cast("string")).first()[0]
        return {"date": max(filter(None, (old.get("date"), seen)), default=None)}

    return mark


def quarter_of(day: datetime.date) -> int:
    """A quarter's running number."""
    return day.year * 4 + (day.month - 1) // 3


def quarter_mark(column: str, today: datetime.date) -> Callable[[dict, DataFrame], dict]:
    """The last quarter done, as ``{"year": .., "quarter": ..}``.

    The quarter of ``today`` isn't over and so never done; a mark of it or of a later
    one, from a wrong clock, is taken back to the quarter before.
    """

    def mark(old: dict, batch: DataFrame) -> dict:
        seen = batch.agg(F.max(F.col(column).cast("date"))).first()[0]
        known = [old["year"] * 4 + old["quarter"] - 1] if old.get("year") else []
        known += [quarter_of(seen)] if seen else []
        if not known:
            return {}
        last = min(max(known), quarter_of(today) - 1)
        return {"year": last // 4, "quarter": last % 4 + 1}

    return mark


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and sums per window and group; on a stream, windows close ``late`` after their end."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of one key's rows with no gap longer than ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), "n")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a stream has now, as a table in memory (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def quarters_after(spans: DataFrame, first: str, last: str, done: str | None = None) -> DataFrame:
    """``spans`` with a row (year, quarter) for each quarter from the date ``first`` to ``last``, after that of ``done`` (null: all)."""
    number = lambda c: F.year(c) * 4 + F.quarter(c) - 1
    low = number(first) if done is None else F.greatest(number(first), F.coalesce(number(done) + 1, F.lit(0)))
    each = F.when(F.col(first).isNotNull() & (low <= number(last)), F.sequence(low, number(last)))
    rows = spans.withColumn("_quarter", F.explode(each))
    return rows.withColumns({"year": F.floor(F.col("_quarter") / 4).cast("int"), "quarter": F.pmod("_quarter", F.lit(4)) + 1}).drop("_quarter")
