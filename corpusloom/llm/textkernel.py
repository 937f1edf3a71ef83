"""Numpy kernels over whole Arrow text columns: words, lines and shingles as 64-bit hashes.

A *block* is a run of complete texts of one Arrow batch, laid end to end in one
byte array.  Blocks hold about ``BLOCK_BYTES``; a longer text forms a block of
its own, so memory follows the longest text and not the batch.

Hashes of byte ranges come from one prefix sum per block: with a random 64-bit
value per byte and an odd base, ``(H[end] - H[start]) * base**-start`` does not
depend on where the range lies (arithmetic is modulo 2**64, where odd numbers
have inverses).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
BLOCK_TEXTS = 4096
U = np.uint64

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_MULT = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * U(2) + U(1)
_SECOND_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; grown by doubling and kept per worker."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, b in enumerate((_BASE, _UNBASE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Block:
    """Texts ``first .. first + n - 1`` of a batch; ``bounds`` has n + 1 byte offsets into ``data``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Count the set bytes of each text."""
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return c[self.bounds[1:]] - c[self.bounds[:-1]]

    def prefix_hash(self, lower: bool = False, second: bool = False) -> np.ndarray:
        """Prefix sums for :meth:`range_hash`; ``second``: of hashes that are independent of the others."""
        table = _SECOND_BYTE if second else _LOWER_BYTE if lower else _BYTE
        p, _ = _power(len(self.data) + 1)
        h = np.empty(len(self.data) + 1, dtype=np.uint64)
        h[0] = 0
        np.cumsum(table[self.data] * p[: len(self.data)], out=h[1:])
        return h

    def range_hash(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, q = _power(len(self.data) + 1)
        return mix((h[end] - h[start]) * q[start] + (end - start).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of each maximal run outside ``[\\x20\\x09-\\x0D]``, in order."""
        inside = ~SEPARATOR[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.bounds] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        text = np.searchsorted(self.bounds, start, side="right") - 1
        return text, start, end


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(i + BLOCK_TEXTS, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield Block(i, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def windows(text: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of every run of k words that lies in one text."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - k + 1
    s = h[:m] * _MULT[0]
    for j in range(1, k):
        s += h[j : j + m] * _MULT[j]
    at = np.flatnonzero(text[:m] == text[k - 1 :])
    return at, mix(s[at])


def shingles(block: Block, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, words per text): all k-word shingles of each text, repeats included.

    A text with 1 .. k - 1 words gives one shingle, its whole sequence.
    """
    text, start, end = block.words()
    h = block.range_hash(block.prefix_hash(lower), start, end)
    at, s = windows(text, h, k)
    n_words = np.bincount(text, minlength=block.n)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.searchsorted(text, short)
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = n_words[short] > j
            whole[has] += h[first[has] + j] * _MULT[32 + j]
        whole = mix(whole + n_words[short].astype(np.uint64))
        at_text = np.concatenate((text[at], short))
        return at_text, np.concatenate((s, whole)), n_words
    return text[at], s, n_words


def distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, 52-bit hash) pairs, sorted by text, then hash.

    One in-place sort of packed values: blocks hold at most ``BLOCK_TEXTS`` texts.
    """
    packed = (text.astype(np.uint64) << U(52)) | (h >> U(12))
    packed.sort()
    if len(packed):
        first = np.ones(len(packed), dtype=bool)
        np.not_equal(packed[1:], packed[:-1], out=first[1:])
        packed = packed[first]
    return (packed >> U(52)).astype(np.int64), packed & U((1 << 52) - 1)


def arrow_map(fn: Callable[[Block, pa.RecordBatch], pa.RecordBatch | list], text: str = "text") -> Callable:
    """A mapInArrow function that applies ``fn`` to each block of the ``text`` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for block in text_blocks(batch.column(at)):
                got = fn(block, batch.slice(block.first, block.n))
                for part in got if isinstance(got, list) else [got]:
                    if part.num_rows:
                        yield part

    return run
