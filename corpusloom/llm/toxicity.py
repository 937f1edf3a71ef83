"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings learns from confirmed toxic
documents and unlabelled text.  The risk on negatives is estimated from the
unlabelled sample less the class prior's share of the positives, and kept from
going below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import Block, U, mix, text_blocks

#: Bytes of the word beginnings that are features beside whole words; they stand for a stem and its endings.
STEMS = (4, 5, 6, 7)
#: Bounds of the training sample, in documents.
SAMPLE_TOXIC = 2_000
SAMPLE_UNLABELLED = 6_000
#: Distinct features of one document of the sample, those with the smallest hashes: very long ones give no more.
SAMPLE_FEATURES = 8_000
#: Bounds of the classifier, which like the sample's are documented parameters: features, and how sure their choice must be.
FEATURES = 512
LEAST_DOCS = 5
LEAST_ERRORS = 4.0
STEPS = 400
DECAY = 1e-3

_SPLIT = np.ones(256, dtype=bool)
_SPLIT[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, 32-bit feature) of each run of letters, A-Z lower-cased, and of its beginnings."""
    inside = ~_SPLIT[block.data]
    edge = np.zeros(len(block.data) + 1, dtype=bool)
    edge[block.bounds] = True
    flips = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start = np.flatnonzero((flips[:-1] == 1) | (inside & edge[:-1]))
    end = np.flatnonzero((flips[1:] == -1) | (inside & edge[1:])) + 1
    text = np.searchsorted(block.bounds, start, side="right") - 1
    h = block.prefix_hash(lower=True)
    texts, features = [text], [block.range_hash(h, start, end)]
    for n in STEMS:
        long = end - start > n
        texts.append(text[long])
        features.append(mix(block.range_hash(h, start[long], start[long] + n) + U(1)))
    return np.concatenate(texts), (np.concatenate(features) >> U(32)).astype(np.int64)


@dataclass
class Classifier:
    """Weights of chosen features, sorted; the score is the logistic function of their sum."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, block: Block) -> np.ndarray:
        z = np.full(block.n, self.bias)
        if len(self.features):
            text, feature = _features(block)
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            use = self.features[at] == feature
            pairs = np.unique(text[use] * len(self.features) + at[use])  # presence, not counts
            z += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], minlength=block.n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _counts(known: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(known), dtype=np.int64)
    out[np.searchsorted(known, value)] = count
    return out


def risk_parts(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The estimated risks on positives and on negatives, from the logits of positives and of unlabelled documents."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """Fit on the documents' distinct features by the non-negative risk estimator.

    risk = prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]) with the
    logistic loss; where the second term is negative, the step undoes it instead.
    Of all features the ``FEATURES`` that tell the samples apart best are used, in
    at least ``LEAST_DOCS`` documents and by ``LEAST_ERRORS`` standard errors.
    """
    df = [np.unique(np.concatenate(docs), return_counts=True) for docs in (toxic, unlabelled)]
    known = np.union1d(df[0][0], df[1][0])
    df_p, df_u = (_counts(known, *x) for x in df)
    p, u = df_p / len(toxic), df_u / len(unlabelled)
    # Features whose share differs most between the samples, in standard errors.
    both = (df_p + df_u) / (len(toxic) + len(unlabelled))
    error = np.sqrt(both * (1 - both) * (1 / len(toxic) + 1 / len(unlabelled))) + 1e-12
    z = np.where(df_p + df_u >= LEAST_DOCS, np.abs(p - u) / error, 0.0)
    best = np.argsort(-z, kind="stable")[:FEATURES]
    features = np.sort(known[best[z[best] > LEAST_ERRORS]])

    def matrix(docs: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(docs), len(features)), dtype=np.float32)
        for i, d in enumerate(docs):
            x[i] = np.isin(features, d, assume_unique=True)
        return x

    xp, xu = matrix(toxic), matrix(unlabelled)
    w, b = np.zeros(len(features)), float(np.log(prior / (1 - prior)))
    m, s = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    for t in range(1, STEPS + 1):
        zp, zu = xp @ w + b, xu @ w + b
        negative = risk_parts(zp, zu, prior)[1]
        gu, gp = sigmoid(zu) / len(zu), prior * sigmoid(zp) / len(zp)
        if negative >= 0:
            up, uu = -prior * sigmoid(-zp) / len(zp) - gp, gu
        else:
            up, uu = gp, -gu
        g = np.append(up @ xp + uu @ xu + DECAY * w, up.sum() + uu.sum())
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Classifier(features, w, float(b))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            text, feature = _features(block)
            pairs = np.unique((text << 32) | feature)
            first = np.searchsorted(pairs >> 32, np.arange(block.n))
            pairs = pairs[np.arange(len(pairs)) - first[pairs >> 32] < SAMPLE_FEATURES]
            ends = np.concatenate(([0], np.cumsum(np.bincount(pairs >> 32, minlength=block.n)))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs & 0xFFFFFFFF).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), found], names=["doc_id", "features"])


def _chosen(docs: DataFrame, most: int, salt: int) -> list[np.ndarray]:
    """Distinct features of the ``most`` rows with the smallest key hashes; of rows that repeat a key, by their features."""
    place = (F.xxhash64("doc_id", F.lit(salt)), F.col("doc_id"))
    ids = docs.select("doc_id").orderBy(*place).limit(most)
    sampled = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sample, f"doc_id {dict(docs.dtypes)['doc_id']}, features array<int>")
    got = sampled.orderBy(*place, F.xxhash64("features")).limit(most).toArrow().sort_by("doc_id")
    return [x.values.to_numpy().view(np.uint32).astype(np.int64) for x in got["features"]]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Classifier | None:
    """Train on (doc_id, text) and (doc_id, toxic); None where there is no toxic example or no other text.

    Positives: documents with label 1 that aren't held out.  Unlabelled: any
    documents.  Without ``prior``, the share of ones among the labels that aren't
    held out stands for it.
    """
    open_ = labels.filter(F.col("toxic").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    if prior is None:
        prior = open_.agg(F.avg("toxic")).first()[0]
    if not prior or prior >= 1:
        return None
    ones = open_.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TOXIC).distinct()
    toxic = _chosen(docs.join(F.broadcast(ones), "doc_id", "left_semi"), SAMPLE_TOXIC, 1)
    unlabelled = _chosen(docs, SAMPLE_UNLABELLED, 2)
    if not toxic or not unlabelled:
        return None
    return train(toxic, unlabelled, float(prior))


def _score(model: Classifier | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                score = np.zeros(block.n) if model is None else model.scores(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, from its whole text.

    Null and empty texts get the score of a text without any known feature.  Where
    nothing can be learnt (no label 1, or only ones) every score is 0.  Rows that
    repeat a key are scored separately, and no more of them are learnt from than the
    sample has rows; repeated labels weigh only in the prior.  Keys are of any type.
    Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    model = fit(rows, labels.select(F.col(key).cast(kind).alias("doc_id"), F.col(label).alias("toxic")))
    found = rows.mapInArrow(_score(model), f"doc_id {kind}, score double, predicted int")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
