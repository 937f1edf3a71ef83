"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of
``capacity // (k + 1) + 1 .. capacity // k`` tokens, and its bins take exactly k
pieces.  A worker needs only one open bin per class, and workers pack
independently, without a shuffle.  Documents are cut so that nearly every piece
has the exact length of its class, and what is left in open bins at a task's end
is laid end to end and cut once more, so there is little padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encode

CAPACITY = 1024
END_ID = 0
#: A cut that would leave a shorter tail isn't made.
LEAST_TAIL = 8
ROWS_OUT = 20_000

SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(length: int, capacity: int = CAPACITY, least_tail: int = LEAST_TAIL) -> list[int]:
    """Lengths into which a document of ``length`` tokens is cut."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        piece = capacity // -(-capacity // rest)  # the longest exact class length that fits
        if 0 < rest - piece < least_tail:
            piece = rest
        out.append(piece)
        rest -= piece
    return out


class Packer:
    """Open bins of one task: at most one per class, so at most about ``capacity * classes`` ids."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.capacity, self.next_id, self.open, self.rows = capacity, base, {}, []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for n in cuts(len(ids), self.capacity):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[start : start + n].copy() if k > 1 else ids[start : start + n], len(ids)))
            if len(bin_) == k:
                self._close(self.open.pop(k))
            start += n

    def finish(self) -> None:
        """Lay the open bins' pieces end to end; the last ids form sequences of powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        i = at = 0
        for size in sizes:
            pieces, room = [], size
            while room:
                doc, start, ids, n = left[i]
                take = min(room, len(ids) - at)
                pieces.append((doc, start + at, ids[at : at + take], n))
                room, at = room - take, at + take
                if at == len(ids):
                    i, at = i + 1, 0
            self._close(pieces)

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _pack(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        schema = None
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encode(path, text.as_py() or "")
                packer.add(doc.as_py(), np.append(ids, np.uint32(END_ID)).astype("<u4"))
                if len(packer.rows) >= ROWS_OUT:
                    yield packer.take(schema)
        packer.finish()
        if packer.rows:
            yield packer.take(schema)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its whole text's, then ``END_ID``; a null or empty text
    is ``END_ID`` alone.  Each id lies in exactly one piece; sequences hold at
    most ``capacity`` ids, gapless from offset 0.  Rows that repeat a key are
    packed separately.  sequence_id is unique over the table: the task's
    partition in its upper bits.  Other columns are not read; an empty table
    gives no rows.  ``capacity`` is a power of two.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pack(tokenizer, capacity), SCHEMA.format(kind=dict(rows.dtypes)["doc_id"]))
