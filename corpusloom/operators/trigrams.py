"""Substring search by an index of three-character pieces: rare pieces first, then the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import TRIGRAM_LEAST
from .textindex import TextIndex

#: Lists that are so many times longer than the shortest aren't read: looking at the texts costs less.
LONGER = 16


def pieces(text: Column) -> Column:
    """The different runs of three characters of a lower-cased text."""
    # A lookahead matches at every sign; the first class keeps it from beginning within one that takes two code units.
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"), F.lit(1))
    return F.array_distinct(every)


class TrigramIndex(TextIndex):
    """A :class:`TextIndex` whose terms are pieces; it is updated, merged and rebuilt like one."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", text: str = "text", **options):
        super().__init__(spark, root, key, text, words=pieces, **options)

    def candidates(self, part: str) -> DataFrame | None:
        """Keys whose texts have the rarest pieces of ``part``; None where no text has them all."""
        wanted = self.spark.range(1).select(pieces(F.lit(part))).first()[0]
        if not wanted or not self.generations():
            return None
        df = self.frequencies(wanted)
        if not all(df.values()):
            return None
        rare = [p for p, n in df.items() if n <= LONGER * min(df.values())]
        rows = self.blocks(dict.fromkeys(rare, 0.0)).select("gen", F.explode("keys").alias("key"))
        gone = self._gone()
        if gone is not None:
            rows = rows.join(gone, ["key", "gen"], "left_anti")
        return rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select(F.col("key").alias(self.key))

    def containing(self, docs: DataFrame, part: str) -> DataFrame:
        """The rows of ``docs`` whose text contains ``part``, whatever the case.

        ``docs`` is what was indexed; only candidates' texts are looked at.  A part of
        fewer than three characters is in no text.
        """
        found = self.candidates(part) if len(part) >= TRIGRAM_LEAST else None
        if found is None:
            return docs.limit(0)
        return docs.join(found, self.key, "left_semi").filter(F.contains(F.lower(F.col(self.text)), F.lower(F.lit(part))))
