"""Quality rules with thresholds learned from mergeable quantile sketches.

Each document's features come from its whole text.  A KLL sketch per feature
for every (language, source) pair, merged upwards to the language and to the
whole corpus, gives far-out fences; the features are then joined with the
fences of their group and filtered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textkernel import SEPARATOR, Block, arrow_map, mix, windows

WINDOW = 8
#: A group's own fences need this many rows; smaller groups use their language's, then the corpus's.
MIN_GROUP = 200
#: A fence lies beyond each of these tail quantiles, by so many times the quantile's distance from the median: the
#: quartile tells how wide the middle is, the tenth what a ratio that is mostly 0 has where it isn't.
TAILS = ((0.25, 6.0), (0.10, 2.0))
#: Group tables up to this many rows are broadcast (languages times sources, at about 200 bytes each).
BROADCAST_GROUPS = 20_000

RATIOS = ("mean_word", "symbol_share", "dup_line_share", "repeat_share")
#: Least distance from median to quartile: a group whose values are all the same still has room around them.
SPREAD = {"mean_word": 0.1, "symbol_share": 0.004, "dup_line_share": 0.02, "repeat_share": 0.02}
#: Ratios that can also be too low; of the others less is never worse.
LOW_SIDE = ("mean_word",)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
    data, n = block.data, block.n
    text, start, end = block.words()
    h = block.prefix_hash()
    word_hash = block.range_hash(h, start, end)
    n_words = np.bincount(text, minlength=n)
    chars = block.per_text(~SEPARATOR[data] & ((data & 0xC0) != 0x80))
    symbols = block.per_text(_SYMBOL[data])

    # Lines end at a newline or at the end of their text.
    newline = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate((block.bounds[:-1], newline + 1)))
    line_end = np.sort(np.concatenate((newline, block.bounds[1:])))
    # A newline at a text's very end leaves an empty last line, which sorts before the next text's first.
    seen = np.concatenate(([0], np.cumsum(~SEPARATOR[data], dtype=np.int64)))
    full = seen[line_end] > seen[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_text = np.searchsorted(block.bounds, line_start, side="right") - 1
    lines = np.bincount(line_text, minlength=n)
    own = mix(block.range_hash(h, line_start, line_end) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(own, return_index=True)
    dup_lines = lines - np.bincount(line_text[first], minlength=n)

    at, w = windows(text, word_hash, WINDOW)
    own = mix(w + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    ordered = own[order]
    same = np.zeros(len(own) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    again = at[order[same[1:] | same[:-1]]]
    step = np.zeros(len(text) + WINDOW + 1, dtype=np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    covered = np.cumsum(step)[: len(text)] > 0
    repeats = np.bincount(text[covered], minlength=n)

    ids = [batch.column(i) for i in range(batch.num_columns - 1)]
    names = batch.schema.names[: len(ids)]
    return pa.RecordBatch.from_arrays(
        [*ids, *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, dup_lines, repeats, lines))],
        names=[*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
    )


def text_features(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """Counts per document over its whole text, with its language and source."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(language).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(
        arrow_map(_measure),
        f"doc_id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long",
    )


def _ratios(f: DataFrame) -> DataFrame:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(0.0)

    return f.withColumns({"mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def _fences(sketches: dict[str, Column]) -> dict[str, Column]:
    """Cutoffs of each ratio: the farther of its tails' fences; groups of one value have ``SPREAD`` around it."""
    out = {}
    for name, s in sketches.items():
        q = lambda p, s=s: F.kll_sketch_get_quantile_double(s, F.lit(p))
        mid, least = q(0.5), F.lit(SPREAD[name])
        out[f"{name}_low"] = F.least(*(q(t) - by * F.greatest(mid - q(t), least) for t, by in TAILS))
        out[f"{name}_high"] = F.greatest(*(q(1 - t) + by * F.greatest(q(1 - t) - mid, least) for t, by in TAILS))
    return out


def thresholds(ratios: DataFrame) -> DataFrame:
    """Fences per (lang, source): rows (lang, source, rows, <feature>_low, <feature>_high).

    Sketches merge without a second look at the rows: the pair's sketches are
    merged to the language's and to the corpus's, which stand in where a pair or
    a language has fewer than ``MIN_GROUP`` rows.  Rows that fail the base rule
    are left out of the sketches, so junk does not widen the fences.
    """
    good = ratios.filter(~F.col("base_failed"))
    pair = stored(
        good.groupBy("lang", "source").agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(r).alias(r) for r in RATIOS)),
        "quality-sketches",
    )

    def merged(*by: str) -> DataFrame:
        return pair.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.kll_merge_agg_double(r).alias(r) for r in RATIOS))

    lang = merged("lang").select(F.col("lang").alias("l_lang"), F.col("rows").alias("l_rows"), *(F.col(r).alias(f"l_{r}") for r in RATIOS))
    every = merged().select(*(F.col(r).alias(f"a_{r}") for r in RATIOS))
    joined = pair.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(every))
    chosen = {r: F.when(F.col("rows") >= MIN_GROUP, F.col(r)).when(F.col("l_rows") >= MIN_GROUP, F.col(f"l_{r}")).otherwise(F.col(f"a_{r}")) for r in RATIOS}
    return joined.select("lang", "source", "rows", *(c.alias(n) for n, c in _fences(chosen).items()))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """One row per document with its counts, base_failed and kept.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated
    8-word windows.  ``kept``: the base holds and no ratio lies beyond its
    group's fences (a ratio at a fence stays).  Null text has no words and so fails the base; null language
    or source form groups of their own; a group all of whose rows fail the base
    needs no fence.  Repeated keys give a row each.  Other columns are not read.
    """
    features = text_features(docs, key, text, language, source)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ratios = stored(_ratios(features).withColumn("base_failed", base), "quality-features")
    fences = stored(thresholds(ratios), "quality-fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"}).drop("rows")
    if fences.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    bad = F.lit(False)
    for r in RATIOS:
        bad = bad | (F.col(r) > F.col(f"{r}_high"))
        if r in LOW_SIDE:
            bad = bad | (F.col(r) < F.col(f"{r}_low"))
    return ratios.join(fences, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).alias("kept"),
        "lang", "source", *RATIOS,
    )
