"""Indexes of the registered queries' tables: built once per session and state of the files, then searched."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.textindex import TextIndex
from ..operators.trigrams import TrigramIndex
from ..operators.vectorindex import VectorIndex
from ..sources.scratch import folder

_made: dict[tuple, object] = {}


def state_of(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that a table is read from."""
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    seen = hashlib.sha1()
    for name in sorted(df.inputFiles()):
        path = hadoop.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()


def once(df: DataFrame, name: str, make: Callable[[SparkSession, str], object]):
    """What ``make(spark, folder)`` gave for this state of the table's files; the folder is one of the session's own."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, name, state_of(df))
    if key not in _made:
        _made[key] = make(spark, folder(spark, name))
    return _made[key]


def text_index(docs: DataFrame, key: str = "doc_id", name: str = "documents", **options) -> TextIndex:
    """The text index of a table's documents."""

    def make(spark: SparkSession, path: str) -> TextIndex:
        index = TextIndex(spark, path, key, buckets=16, **options)
        index.opened()
        index.update(docs.select(key, "text"))
        return index

    return once(docs, f"text-index-{name}", make)


def trigram_index(docs: DataFrame, key: str, text: str, name: str) -> TrigramIndex:
    def make(spark: SparkSession, path: str) -> TrigramIndex:
        index = TrigramIndex(spark, path, key, text, buckets=16)
        index.opened()
        index.update(docs.select(key, text))
        return index

    return once(docs, f"trigram-index-{name}", make)


def vector_index(vectors: DataFrame, dims: int = 64) -> VectorIndex:
    def make(spark: SparkSession, path: str) -> VectorIndex:
        index = VectorIndex(spark, path)
        index.build(vectors.select("vec_id", "embedding"), dims)
        return index

    return once(vectors, "vector-index", make)
