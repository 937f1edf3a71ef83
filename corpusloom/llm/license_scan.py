"""License scans: MinHash bands over text windows retrieve templates, exact containment verifies them.

Words are runs of letters and digits, A-Z lower-cased.  Templates fall into
size classes by powers of two; a text is cut into overlapping windows of three
times the class's largest template, a third of a window apart, so that any copy
of a template lies whole in one window, also with as many words put in as it has.  The bands' number follows from the least
Jaccard similarity that a window with a match can have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .textkernel import SEPARATOR, U, Block, arrow_map, mix, text_blocks, windows

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.9999

_SPLIT = np.ones(256, dtype=bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
assert _SPLIT[SEPARATOR].all()


def band_settings(least: float, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows) with a collision probability of ``recall`` or more at Jaccard ``least``: the most rows that need at most ``most`` hashes."""
    best = None
    for rows in range(1, 5):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - least**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no band setting reaches this recall")
    return best


def _shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, in order."""
    inside = ~_SPLIT[block.data]
    edge = np.zeros(len(block.data) + 1, dtype=bool)
    edge[block.bounds] = True
    flips = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start = np.flatnonzero((flips[:-1] == 1) | (inside & edge[:-1]))
    end = np.flatnonzero((flips[1:] == -1) | (inside & edge[1:])) + 1
    text = np.searchsorted(block.bounds, start, side="right") - 1
    at, s = windows(text, block.range_hash(block.prefix_hash(lower=True), start, end), SHINGLE)
    return text[at], s


class Index:
    """Band buckets of the templates, one table per size class; small, built where it is used."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        self.names = list(templates)
        self.containment = containment
        block = next(text_blocks(pa.array(list(templates.values())), 1 << 30))
        text, h = _shingles(block)
        self.sets = [np.unique(h[text == i]) for i in range(block.n)]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs {SHINGLE} words at least")
        self.known = np.unique(h)
        self.classes = []
        for c in sorted({int(len(s)).bit_length() for s in self.sets}):
            members = [i for i, s in enumerate(self.sets) if len(s).bit_length() == c]
            top = max(len(self.sets[i]) for i in members)
            low = min(len(self.sets[i]) for i in members)
            width = 3 * top
            shared = math.ceil(containment * low)
            bands, rows = band_settings(shared / (width + low - shared))
            salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
            buckets: dict[tuple[int, int], list[int]] = {}
            for i in members:
                for b, key in enumerate(self._bands(self.sets[i], salts, bands)):
                    buckets.setdefault((b, key), []).append(i)
            self.classes.append((width, top, bands, salts, buckets, np.unique(np.concatenate([self.sets[i] for i in members]))))

    @staticmethod
    def _bands(hashes: np.ndarray, salts: np.ndarray, bands: int) -> list[int]:
        low = mix(hashes[:, None] ^ salts[None, :]).min(axis=0)
        key = np.zeros(bands, dtype=np.uint64)
        for column in low.reshape(bands, -1).T:
            key = mix(key + column)
        return key.tolist()

    def matches(self, block: Block) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first shingle of the best window) for each text and template that match."""
        text, h = _shingles(block)
        place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero(self.known[place] == h)  # a window without any template's shingle can contain none
        best: dict[tuple[int, int], tuple[float, int]] = {}
        first = np.searchsorted(text, np.arange(block.n))
        last = np.searchsorted(text, np.arange(block.n), side="right")
        for width, step, bands, salts, buckets, known in self.classes:
            near = hits[np.isin(h[hits], known)]
            own = text[near]
            number = (near - first[own]) // step
            open_ = {(int(t), int(w)) for t, n in zip(own.tolist(), number.tolist()) for w in (n - 2, n - 1, n) if w >= 0}
            for t, w in sorted(open_):
                a = int(first[t]) + w * step
                window = np.unique(h[a : min(a + width, int(last[t]))])
                found = set()
                for b, key in enumerate(self._bands(window, salts, bands)):
                    found.update(buckets.get((b, key), ()))
                for i in found:
                    share = np.isin(self.sets[i], window, assume_unique=True).mean()
                    if share >= self.containment and share > best.get((t, i), (0.0, 0))[0]:
                        best[t, i] = float(share), a - int(first[t])
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and template that it contains: doc_id, license, containment, first_word.

    containment: the share of the template's distinct 5-word shingles found in
    one window, ``containment`` or more; first_word: that window's first word (of
    several equal windows the first).  Null, empty and short texts match
    nothing.  Rows that repeat a key are scanned separately.  Other columns are
    not read; an empty table gives no rows.
    """
    chosen = dict(templates or TEMPLATES)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    index: list[Index] = []

    def scan(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        if not index:
            index.append(Index(chosen, containment))
        found = index[0].matches(block)
        at = pa.array([f[0] for f in found], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array([index[0].names[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64())],
            names=["doc_id", "license", "containment", "first_word"],
        )

    return rows.mapInArrow(arrow_map(scan), f"doc_id {dict(rows.dtypes)['doc_id']}, license string, containment double, first_word long")
