"""Exact deduplication by progressive refinement.

One scan of the texts writes a narrow row per document: the length of its
normalised text, a hash of its first characters, and its full digest, which is
a column of the result.  Documents are grouped by length, then by prefix hash,
and only members of groups that still have two rows are grouped by full digest.
Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HOT_SHARE, join_groups, one_of_each, stored, text_hash

PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def narrow_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(doc_id, row, n, head, digest) of each row: hash of the text, length, prefix hash and SHA-256 of the normalised text."""
    rows = docs.select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("row"), normalised(F.col(text)).alias("t"))
    return rows.select("doc_id", "row", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("head"), F.unhex(F.sha2("t", 256)).alias("digest"))


def surviving_groups(narrow: DataFrame) -> DataFrame:
    """(n, head) of the groups that have two rows or more after length and prefix refinement."""
    # Partial sums first: a hot length or prefix costs one row per task.
    by_head = narrow.groupBy("n", "head").agg(F.count("*").alias("rows"))
    by_length = by_head.groupBy("n").agg(F.sum("rows").alias("length_rows")).filter("length_rows > 1")
    return by_head.join(by_length, "n", "left_semi").filter("rows > 1").select("n", "head")


def exact_groups(narrow: DataFrame) -> DataFrame:
    """One row per surviving group of equal texts: digest, keep_id, group_size (2 or more)."""
    # Equal rows of a task are one row before they move, so a hot group is no hot key of the join.
    texts = narrow.groupBy("n", "head", "digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return texts.join(surviving_groups(narrow), ["n", "head"], "left_semi").filter("group_size > 1").select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical after normalising white space; the smallest key of a
    group stays.  Null and empty texts form one group.  A key that occurs on
    several rows gives as many rows, each with the same verdict.  A null key goes
    where its group has another; a group of null keys alone has no smallest, so all
    its rows are kept, with a null keep_id.  Columns other than key and text are
    not read.  An empty table gives an empty result.
    """
    narrow = stored(narrow_rows(docs, key, text), "dedup-narrow")
    groups = stored(exact_groups(narrow), "dedup-groups")
    members = join_groups(narrow, groups, "digest", "group_size", narrow.count(), "left", hot_share)
    keep = F.coalesce("keep_id", "doc_id")
    return members.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest key.

    Of rows that repeat a key, too, only one with the same normalised text stays;
    rows with a null key stay where no other row has their text.
    """
    narrow = stored(narrow_rows(docs, key, text), "dedup-narrow")
    groups = stored(exact_groups(narrow).select("digest", "group_size"), "dedup-groups")
    # Members of groups only; one_of_each sums rows that repeat key and text before it moves them.
    members = join_groups(narrow.select("doc_id", "row", "digest"), groups, "digest", "group_size", narrow.count())
    return one_of_each(docs, members.select("doc_id", "row", "digest"), "digest", key, text)
