"""Language identification by a byte convolutional network, trained and applied in numpy.

Byte embedding, filters of several widths, max pooling over a fixed-length
window, softmax.  A text is cut into windows so that each n-gram of the widest
filter lies in exactly one; the windows' mean logits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import Block, text_blocks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 4
#: Bounds of the training sample: documents per language, windows per document.
SAMPLE_DOCS = 800
SAMPLE_WINDOWS = 4
EPOCHS = 12
#: Languages that are learned: those with the most documents. Others are never predicted.
LANGUAGES = 500
ACCEPT_ROWS = 512
MARGIN = 0.12
UNKNOWN = "und"

_STEP = WINDOW - max(WIDTHS) + 1
_SPAN = max(WIDTHS)


def cut(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, windows as rows of WINDOW bytes, zero beyond the text's end)."""
    size = np.diff(block.bounds)
    count = np.maximum(1, -(-(size - _SPAN + 1) // _STEP))
    text = np.repeat(np.arange(block.n), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = block.bounds[text] + number * _STEP
    room = block.bounds[text + 1] - start
    padded = np.concatenate((block.data, np.zeros(WINDOW + 1, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[np.minimum(start, len(block.data))]
    short = np.flatnonzero(room < WINDOW)
    rows[short] *= np.arange(WINDOW)[None, :] < room[short, None]
    return text, rows


@dataclass
class ByteConvNet:
    """embed (256, E), filters (span * E, F), bias (F), out (F, L), out_bias (L)."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(languages: list[str], seed: int = 7) -> ByteConvNet:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        w = r.normal(0, 0.3, (_SPAN * EMBED, n))
        return ByteConvNet(languages, *(x.astype(np.float32) for x in (r.normal(0, 1, (256, EMBED)), w * _mask(), np.zeros(n), r.normal(0, 0.2, (n, len(languages))), np.zeros(len(languages)))))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def _columns(self, rows: np.ndarray) -> np.ndarray:
        x = self.embed[rows].reshape(len(rows), -1)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, _SPAN * EMBED, axis=1)[:, ::EMBED])

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), dtype=np.float32)
        for i in range(0, len(rows), 64):
            part = self._columns(rows[i : i + 64])
            top = (part.reshape(-1, part.shape[2]) @ self.filters).reshape(part.shape[0], part.shape[1], -1).max(axis=1)
            out[i : i + 64] = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        return out

    def gradients(self, rows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        columns = self._columns(rows)
        response = columns @ self.filters
        at = response.argmax(axis=1)
        n = np.arange(len(rows))
        raw = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + self.bias
        top = np.maximum(raw, 0)
        d = _softmax(top @ self.out + self.out_bias)
        d[n, label] -= 1
        d /= len(rows)
        back = (d @ self.out.T) * (raw > 0)
        picked = columns[n[:, None], at]  # (rows, filters, span * E)
        filters = np.einsum("nf,nfc->cf", back, picked) * _mask()
        inner = (back[:, :, None] * self.filters.T[None]).reshape(len(rows), -1, _SPAN, EMBED)
        embed = np.zeros_like(self.embed)
        np.add.at(embed, rows[n[:, None, None], at[:, :, None] + np.arange(_SPAN)], inner)
        return [embed, filters, back.sum(axis=0), top.T @ d, d.sum(axis=0)]


def _mask() -> np.ndarray:
    """Zeros where a narrow filter has no weight."""
    return np.concatenate([np.repeat((np.arange(_SPAN * EMBED) < w * EMBED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteConvNet:
    """Adam on cross-entropy, each language weighing the same."""
    net = ByteConvNet.start(languages, seed)
    rng = np.random.default_rng(seed)
    share = np.bincount(label, minlength=len(languages))[label].astype(np.float64)
    chance = (1 / share) / (1 / share).sum()
    mean, square, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    steps = max(60, epochs * len(rows) // 128)
    for t in range(1, steps + 1):
        pick = rng.choice(len(rows), min(128, len(rows)), p=chance)
        rate = 0.01 * (1 - t / (steps + 1))
        for p, g, m, s in zip(net.params(), net.gradients(rows[pick], label[pick]), mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return net


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            text, rows = cut(block)
            first = np.searchsorted(text, np.arange(block.n))
            count = np.bincount(text, minlength=block.n)
            # Evenly spaced windows over the whole text.
            take = np.unique((first[:, None] + (np.arange(SAMPLE_WINDOWS)[None, :] * count[:, None]) // SAMPLE_WINDOWS).ravel())
            lang = batch.column(0).slice(block.first, block.n).take(pa.array(text[take]))
            yield pa.RecordBatch.from_arrays([lang, pa.array([r.tobytes() for r in rows[take]], pa.binary())], names=["lang", "bytes"])


def fit(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> ByteConvNet | None:
    """Train on (doc_id, lang, text) rows; None where no row has a language and a text.

    At most about ``per_language`` documents of each language, chosen by a hash
    of their key, and ``SAMPLE_WINDOWS`` windows of each, come to the driver; of
    more than ``LANGUAGES`` languages, those with the most documents are learned.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang]))))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(spread < share[F.col("lang")]).select("lang", "text").mapInArrow(_sample_windows, "lang string, bytes binary").toArrow()
    if not sample.num_rows:
        return None
    order = np.argsort([b.as_py() for b in sample["bytes"]], kind="stable")  # the same whatever the partitions' order
    number = {lang: i for i, lang in enumerate(languages)}
    label = np.array([number[x] for x in sample["lang"].to_pylist()])[order]
    rows = np.frombuffer(b"".join(sample["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)[order]
    return train(rows, label, languages)


def _predict(net: ByteConvNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for block in text_blocks(batch.column(1)):
                name, score = np.full(block.n, UNKNOWN, dtype=object), np.zeros(block.n)
                if net is not None:
                    text, rows = cut(block)
                    total = np.zeros((block.n, len(net.languages)))
                    np.add.at(total, text, net.logits(rows))
                    p = _softmax(total / np.bincount(text, minlength=block.n)[:, None])
                    known = letters[block.first : block.first + block.n]
                    name[known] = np.array(net.languages, dtype=object)[p.argmax(axis=1)][known]
                    score[known] = p.max(axis=1)[known]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, net: ByteConvNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, from its whole text.

    ``und`` with score 0 where the text is null or has no letter, or no network
    could be trained.  Rows that repeat a key are scored separately.  Other
    columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(net), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def _accept(net: ByteConvNet, least: float, text: int):
    predict = _predict(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ACCEPT_ROWS):  # few rows at a time, as whole rows are copied
                part = batch.slice(a, ACCEPT_ROWS)
                narrow = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(text), part.column(part.num_columns - 1)], names=["doc_id", "text", "letters"])
                keep = np.concatenate([(b.column(1).to_numpy(zero_copy_only=False) != UNKNOWN) & (b.column(2).to_numpy() >= least) for b in predict(iter([narrow]))] or [np.zeros(0, bool)])
                yield part.filter(pa.array(keep)).select(range(part.num_columns - 1))

    return run


def accepted(docs: DataFrame, net: ByteConvNet | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in a language that the network knows, with a score of ``least`` or more.

    All columns stay as they are; no row moves.  Without a network nothing is
    rejected but texts without a letter.
    """
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.filter(letters)
    own = "has letters"
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, letters).mapInArrow(_accept(net, least, docs.columns.index(text)), docs.schema)


def least_score(net: ByteConvNet | None, margin: float = MARGIN) -> float:
    """A score that a guess doesn't reach, whatever the number of languages: ``margin`` of the way from chance to certainty."""
    chance = 1 / len(net.languages) if net else 0.0
    return chance + margin * (1 - chance)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """Train on the documents that aren't held out, predict all: doc_id, held_out, lang_pred, score.

    Null languages and null texts teach nothing; see :func:`identify`.
    """
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(language).cast("string").alias("lang"))
    net = fit(named.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))
    found = identify(named, net)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
