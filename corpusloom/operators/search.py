"""Full-text search: match predicates, an inverted index and BM25 ranking, all in DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
TRIGRAM_LEAST = 3


def trigram(c: Column, part: str) -> Column:
    """Case-insensitive substring match; parts of fewer than three characters match nothing."""
    return F.contains(F.lower(c), F.lit(part.lower())) if len(part) >= TRIGRAM_LEAST else F.lit(False)


def _phrase(words: Column, wanted: Sequence[str]) -> Column:
    if len(wanted) == 1:
        return F.array_contains(words, wanted[0])
    # Words hold no spaces, so a joined text has the phrase only at word bounds.
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {' '.join(wanted)} ")


def has_words(words: Column, wanted: Sequence[str]) -> Column:
    """All of the words occur; combine such predicates with ``&``, ``|`` and ``~``."""
    out = F.lit(True)
    for w in wanted:
        out = out & F.array_contains(words, w.lower())
    return out


def has_phrase(words: Column, phrase: str) -> Column:
    """The phrase's words occur next to each other."""
    return _phrase(words, plain_terms(phrase))


def has_prefix(words: Column, start: str) -> Column:
    return F.exists(words, lambda t: t.startswith(start.lower()))


def plain_terms(query: str) -> list[str]:
    """The words of a free-text query, quotes dropped."""
    return [w for w in re.split(r"[\W_]+", query.replace('"', "").lower()) if w]


def index_documents(docs: DataFrame, key: str, words: Column, terms: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings (term, key, tf), lengths (key, dl)); of the given terms alone, if any are given."""
    cut = docs.select(F.col(key), words.alias("_words"))
    chosen = F.col("_words") if terms is None else F.filter("_words", lambda w: w.isin(*terms))
    postings = cut.select(key, F.explode(chosen).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings, cut.select(key, F.size("_words").cast("long").alias("dl"))


def bm25(postings: DataFrame, lengths: DataFrame, terms: Sequence[str], key: str) -> DataFrame:
    """(key, score) of the documents with all terms; smaller is better, as in SQLite's FTS5.

    Only the terms' postings are read; corpus figures come as one broadcast row.
    """
    wanted = sorted(set(terms))
    if not wanted:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    weight = {t: list(terms).count(t) for t in wanted}
    hits = postings.filter(F.col("term").isin(*wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, IDF_FLOOR).otherwise(raw)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    times = F.create_map(*(F.lit(x) for t in wanted for x in (t, float(weight[t]))))[F.col("term")]
    scored = hits.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(corpus))
    return scored.groupBy(key).agg((-F.sum(part * times)).alias("score"), F.count("*").alias("_terms")).filter(F.col("_terms") == len(wanted)).drop("_terms")


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25_scan(docs: DataFrame, key: str, words: Column, terms: Sequence[str], allow: DataFrame | None = None) -> DataFrame:
    """As :func:`bm25` without an index: two scans, nothing exploded, no shuffle but one row of sums.

    ``allow`` limits the hits to its keys; the corpus figures stay those of all documents.
    """
    wanted = sorted(set(terms))
    counted = docs.select(F.col(key), words.alias("_w")).select(key, F.size("_w").alias("dl"), *(_times("_w", t).alias(f"tf{i}") for i, t in enumerate(wanted)))
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))))
    score, has = F.lit(0.0), F.lit(True)
    for i, t in enumerate(wanted):
        tf, raw = F.col(f"tf{i}"), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score - list(terms).count(t) * F.when(raw <= 0, IDF_FLOOR).otherwise(raw) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        has = has & (tf > 0)
    hits = counted.filter(has)
    if allow is not None:
        hits = hits.join(allow.select(key).distinct(), key, "left_semi")
    return hits.crossJoin(F.broadcast(corpus)).select(key, score.alias("score"))


def sparse_hits(docs: DataFrame, key: str, words: Column, query: str, k: int, allow: DataFrame | None = None, stem: Callable[[str], str] | None = None) -> DataFrame:
    """(key, score): the k best documents with all words of a free-text query, among the allowed ones.

    The allowlist is a semi join before the top-k, so a narrow scope isn't starved
    by better hits outside it; an empty one gives nothing, as does a query without
    words.  ``stem`` is put on the query's words, where ``words`` are stems.
    """
    terms = [stem(w) if stem else w for w in plain_terms(query)]
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    return bm25_scan(docs, key, words, terms, allow).orderBy("score", key).limit(k)


def document_tokens(c: Column) -> Column:
    return tokens(F.coalesce(c, F.lit("")))


def roll_up(hits: DataFrame, parent: str, score: str = "score") -> DataFrame:
    """Best hit of each parent document."""
    return hits.groupBy(parent).agg(F.min(score).alias(score))


def merge_branches(*branches: DataFrame) -> DataFrame:
    """Hits of independent indexes, by their own scores."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out
