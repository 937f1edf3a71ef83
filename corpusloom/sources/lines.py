"""Numbered lines of text files, so that a reader can go on behind any line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line; lines are counted from 1 in each file.

    Files are read in splits, whichever way Spark cuts them.  A split's lines are
    counted, the counts of a file's splits add up to each split's first number, and a
    line's place within its split does the rest: no file passes one task, unless it is
    compressed as a whole.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "block", "first", before.alias("before"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "value")


def json_lines_after(spark: SparkSession, path: str, schema: str, done: Mapping[str, int] | int = 0) -> DataFrame:
    """(file, line, record, bad) of the lines behind ``done``: a number of lines for all files, or per file name.

    ``bad`` lines, of which :func:`progress` counts, aren't JSON objects; their record
    is null.  Blank lines are neither records nor bad.
    """
    lines = numbered_lines(spark, path)
    name = F.element_at(F.split("file", "/"), -1)
    if isinstance(done, int):
        rest = lines.filter(F.col("line") > done)
    elif done:
        rest = lines.join(F.broadcast(spark.createDataFrame(list(done.items()), "_name string, _done long")), name == F.col("_name"), "left").filter(F.col("line") > F.coalesce("_done", F.lit(0))).drop("_name", "_done")
    else:
        rest = lines
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    rows = rest.filter(F.trim("value") != "").withColumn("_parsed", parsed)
    bad = F.coalesce(F.col("_parsed._corrupt").isNotNull(), F.lit(True)) | ~F.trim("value").startswith("{")
    record = F.from_json("value", schema)
    return rows.withColumn("bad", bad).select("file", "line", F.when(~F.col("bad"), record).alias("record"), "bad")


def progress(rows: DataFrame) -> DataFrame:
    """(file, line, records, bad): how far each file was read, and how many lines were what."""
    return rows.groupBy("file").agg(F.max("line").alias("line"), F.count(F.when(~F.col("bad"), 1)).alias("records"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
