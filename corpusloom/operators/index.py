"""Chunk index maintenance: version keys, what to re-index, replacing documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from .merge import delete_docs

CLEANER = "v3"


def hash_version(*parts: Column) -> Column:
    """Content version of a document, with the cleaner's."""
    return F.concat(content_hash(*parts), F.lit(f"-{CLEANER}"))


def revision_version(revision: Column) -> Column:
    return F.concat(revision.cast("string"), F.lit(f"-{CLEANER}"))


def body_version(stamp: Column, body: Column, *parts: Column) -> Column:
    """``stamp or hash``, the body's first hash digits or ``no-body``, the cleaner's version."""
    first = F.coalesce(F.nullif(stamp, F.lit("")), content_hash(*parts))
    tail = F.when(F.coalesce(body, F.lit("")) != "", F.substring(content_hash(body), 1, 8)).otherwise("no-body")
    return F.concat_ws("-", first, tail, F.lit(CLEANER))


def version_diff(docs: DataFrame, meta: DataFrame, key: str = "doc_id", version: str = "version") -> DataFrame:
    """(key, status): new, updated, unchanged, or gone (indexed but no longer there)."""
    d = docs.select(key, F.col(version).alias("_d"), F.lit(True).alias("_in"))
    m = meta.select(key, F.col(version).alias("_m"), F.lit(True).alias("_was"))
    status = F.when(F.col("_was").isNull(), "new").when(F.col("_in").isNull(), "gone").when(F.col("_d").eqNullSafe(F.col("_m")), "unchanged").otherwise("updated")
    return d.join(m, key, "full_outer").select(key, status.alias("status"))


def to_index(docs: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that are new or changed."""
    return docs.join(version_diff(docs, meta, key).filter(F.col("status").isin("new", "updated")).select(key), key, "left_semi")


def reindex(docs: DataFrame, chunks: DataFrame, meta: DataFrame, chunk: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, meta) after indexing what changed in ``docs`` (doc_id, title, version, text).

    All chunks of a changed document are replaced; one that yields no chunk
    leaves the index.  Write both before reading them again.
    """
    todo = to_index(docs, meta, key)
    fresh = chunk(todo)
    counted = fresh.groupBy(key).agg(F.count("*").alias("chunk_count"))
    new_meta = todo.select(key, "version", "title").join(counted, key).withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    return (
        delete_docs(chunks, todo, key).unionByName(fresh, allowMissingColumns=True),
        delete_docs(meta, todo, key).unionByName(new_meta, allowMissingColumns=True),
    )


def index_tables(docs: DataFrame, old: dict[str, DataFrame], chunk: Callable[[DataFrame], DataFrame], embed: Callable[[Column, Column], Column], words: Callable[[Column], Column], key: str = "doc_id") -> dict[str, DataFrame]:
    """chunks, vectors, postings and meta after indexing what changed in ``docs`` (doc_id, title, version, text).

    ``old`` holds the same four, as they are.  Each chunk has an id of document
    and place, one vector (``embed`` of the document's title and the chunk's text)
    and the postings of its ``words``; what a document had before goes from all
    tables alike.  A table of one document replaces that document alone.  Write all
    four before reading them again; chunks are made once if ``chunk`` stores them.
    """
    todo = to_index(docs, old["meta"], key)
    fresh = chunk(todo).withColumn("chunk_id", F.concat_ws("#", F.col(key).cast("string"), "chunk_index"))
    named = fresh.join(todo.select(key, "title"), key)
    terms = fresh.select("chunk_id", key, F.explode(words(F.col("text"))).alias("term")).groupBy("term", "chunk_id", key).agg(F.count("*").alias("tf"))
    counted = fresh.groupBy(key).agg(F.count("*").alias("chunk_count"))
    meta = todo.select(key, "version", "title").join(counted, key).withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    new = {"chunks": fresh, "vectors": named.select("chunk_id", key, embed(F.col("title"), F.col("text")).alias("embedding")), "postings": terms, "meta": meta}
    return {name: delete_docs(old[name], todo, key).unionByName(rows, allowMissingColumns=True) for name, rows in new.items()}


def reading_order(chunks: DataFrame, doc_id, key: str = "doc_id") -> DataFrame:
    """One document's chunks from first to last."""
    return chunks.filter(F.col(key) == doc_id).orderBy("chunk_index")


def needs_rebuild(stamped: dict[str, str], wanted: dict[str, str]) -> bool:
    """Whether an index with these settings can't be kept."""
    return any(stamped.get(k) != v for k, v in wanted.items())


def map_reduce(items: DataFrame, done: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all items: those done before, and ``work`` on the rest."""
    return done.unionByName(work(items.join(done.select(key), key, "left_anti")), allowMissingColumns=True)


def issue_status(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row (status, items, done): empty, partial or complete."""
    both = items.select(key).join(results.select(key, F.lit(1).alias("_done")), key, "left").agg(F.count("*").alias("items"), F.count("_done").alias("done"))
    return both.select(F.when(F.col("items") == 0, "empty").when(F.col("done") < F.col("items"), "partial").otherwise("complete").alias("status"), "items", "done")
