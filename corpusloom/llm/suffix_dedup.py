"""Removal of repeated substrings by sharded suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere
else in the corpus.  Shards must bring equal strings together without moving the
corpus, so each window of ``LENGTH`` bytes is routed by its *anchor*, the k-gram
in it with the smallest hash: equal windows have equal anchors at equal offsets.
Neighbouring windows share an anchor and travel as one *context*.

1. Anchors of all texts are counted; only windows whose anchor occurs twice or
   more can repeat, and only their contexts are kept.
2. Equal contexts are counted by two 64-bit fingerprints of their bytes, and one
   of each goes on.  Different contexts are dealt to shards by anchor; each shard sorts its suffixes by Larsson-Sadakane
   refinement, takes common prefixes by Kasai's walk, and marks windows that
   share ``LENGTH`` bytes with another.  Where one anchor's contexts fill several
   shards, those are merged by binary search.
3. Marked windows go back to their documents as byte ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textkernel import U, Block, mix, text_blocks

LENGTH = 200
ANCHOR = 64
#: Anchors with more occurrences than this are split further, by the content of their windows.
HOT = 4_000
SHARD_BYTES = 1 << 20
SEGMENT = 8 << 20
#: Row ids up to this many are broadcast, at 24 bytes each; more go through a shuffle join.
BROADCAST_IDS = 500_000
#: Contexts that a task remembers as sent; then it starts anew.
SENT = 200_000

_POSITION = U((1 << 24) - 1)
_SPREAD = U(0x9E3779B97F4A7C15)


class Windows:
    """The windows of one stretch of texts (below 2**24 bytes) and their anchors."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
        self.data, self.bounds, self.length, self.anchor = data, bounds, length, anchor
        n = len(data)
        self.count = max(0, n - length + 1)
        if not self.count:
            return
        self.block = Block(0, data, bounds)
        self.prefix = self.block.prefix_hash()
        at = np.arange(n - anchor + 1)
        self.gram = self.block.range_hash(self.prefix, at, at + anchor)
        low = self._least((self.gram & ~_POSITION) | at.astype(np.uint64))
        self.at = (low & _POSITION).astype(np.int64)
        big = np.flatnonzero(np.diff(bounds) >= length)
        step = np.zeros(self.count + 1, dtype=np.int64)
        step[bounds[big]] += 1
        step[bounds[big + 1] - length + 1] -= 1
        self.valid = np.cumsum(step[:-1]) > 0

    def runs(self, keep: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last window) of maximal runs of kept windows with one anchor and one value of each ``same``."""
        new = keep.copy()
        new[1:] &= ~keep[:-1] | np.logical_or.reduce([s[1:] != s[:-1] for s in (self.at, *same)])
        first = np.flatnonzero(new)
        end = np.flatnonzero(keep & np.append(new[1:] | ~keep[1:], True))
        return first, end

    def text_of(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, start, side="right") - 1

    def samples(self) -> np.ndarray:
        """Per window, a value of its content alone: its first and last k-gram whose hash is 0 modulo 32.

        A window without one has its least k-gram by another hash instead.
        """
        width = self.length - self.anchor
        chosen = np.flatnonzero((self.gram & U(31)) == 0)
        other = self._least(mix(self.gram + _SPREAD))
        if not len(chosen):
            return other
        start = np.arange(self.count)
        after = np.searchsorted(chosen, start)
        before = np.searchsorted(chosen, start + width, side="right") - 1
        some = (after < len(chosen)) & (before >= after)
        first = self.gram[chosen[np.minimum(after, len(chosen) - 1)]]
        last = self.gram[chosen[np.maximum(before, 0)]]
        return np.where(some, mix(first * U(3) + last), other)

    def _least(self, value: np.ndarray) -> np.ndarray:
        """The least value of each window's k-grams."""
        width, size = self.length - self.anchor + 1, 1
        while 2 * size <= width:
            value = np.minimum(value[:-size], value[size:])
            size *= 2
        return np.minimum(value[: -(width - size)], value[width - size :]) if size < width else value


def _stretches(block: Block, length: int) -> Iterator[tuple[int, Windows]]:
    """(offset in the block, windows); a very long text comes in overlapping stretches."""
    n = len(block.data)
    if n <= SEGMENT or block.n > 1:
        yield 0, Windows(block.data, block.bounds, length)
        return
    for s in range(0, n - length + 1, SEGMENT):
        part = block.data[s : s + SEGMENT + length - 1]
        yield s, Windows(part, np.array([0, len(part)]), length)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                for _, w in _stretches(block, length):
                    if not w.count:
                        continue
                    first, _ = w.runs(w.valid)
                    row = pa.array(w.text_of(first) + block.first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(w.gram[w.at[first]].view(np.int64))], names=["row_id", "anchor"])

    return run


_CONTEXT = "row_id {kind}, start long, windows long, shard long, print long, second long, context binary"
_PRINT = ["shard", "print", "second"]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column of longs without null rows."""
    size = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy().view(np.uint64)


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int, int]] = set()
        for batch in batches:
            known = [_flat(batch.column(i)) for i in (2, 3)]
            for block in text_blocks(batch.column(1)):
                member = []
                for row, value in known:
                    own = (row >= block.first) & (row < block.first + block.n)
                    member.append(np.sort(mix(value[own] + (row[own] - block.first).astype(np.uint64) * _SPREAD)))
                for offset, w in _stretches(block, length):
                    if not w.count:
                        continue
                    first, last = w.runs(w.valid)
                    # Only windows whose anchor occurs twice can repeat.
                    key = mix(w.gram[w.at[first]] + w.text_of(first).astype(np.uint64) * _SPREAD)
                    step = np.zeros(w.count + 1, dtype=np.int64)
                    often = np.isin(key, member[0])
                    step[first[often]] += 1
                    step[last[often] + 1] -= 1
                    keep = np.cumsum(step[:-1]) > 0
                    if not keep.any():
                        continue
                    sub = np.zeros(w.count, np.uint64)
                    if len(member[1]):
                        start = np.arange(w.count)
                        hot = np.isin(mix(w.gram[w.at] + w.text_of(start).astype(np.uint64) * _SPREAD), member[1])
                        sub[hot] = w.samples()[hot]
                    a, b = w.runs(keep, sub)
                    shard = mix(w.gram[w.at[a]] + sub[a] * _SPREAD).view(np.int64)
                    marks = [w.block.range_hash(h, a, b + length).view(np.int64) for h in (w.prefix, w.block.prefix_hash(second=True))]
                    context = []
                    if len(sent) > SENT:
                        sent.clear()
                    for i, pair in enumerate(zip(shard.tolist(), *(m.tolist() for m in marks))):
                        if pair in sent:  # a copy within this task: its bytes went already
                            context.append(None)
                        else:
                            sent.add(pair)
                            context.append(w.data[a[i] : b[i] + length].tobytes())
                    rows = pa.array(w.text_of(a) + block.first)
                    base = block.bounds[w.text_of(a)] if offset == 0 else np.zeros(len(a), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array(a + offset - base), pa.array(b - a + 1), pa.array(shard), *map(pa.array, marks), pa.array(context, pa.binary())],
                        names=["row_id", "start", "windows", *_PRINT, "context"],
                    )

    return run


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffix array of ``data``.

    Larsson-Sadakane refinement: suffixes start in the order of their first
    seven bytes; each round sorts the groups that are still open by the rank of
    the suffix h further on, and h doubles.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        key = (key << U(8)) | padded[j : j + n]
    key = (key << U(8)) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)  # an ended suffix comes before its extensions
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)

    def number(sorted_key: np.ndarray) -> np.ndarray:
        """For each place its group's last place."""
        last = np.append(np.flatnonzero(sorted_key[1:] != sorted_key[:-1]), len(sorted_key) - 1)
        return np.repeat(last, np.diff(np.concatenate(([-1], last))))

    group = number(key[order])
    rank[order] = group
    place = np.arange(n)
    # Groups of one suffix are done.
    size = np.bincount(group, minlength=n)
    open_ = place[size[group] > 1]
    h = 7
    while len(open_):
        own = order[open_]
        after = np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + 1, 0)
        packed = (rank[own].astype(np.uint64) << U(32)) | after.astype(np.uint64)
        s = np.argsort(packed, kind="stable")
        order[open_] = own[s]
        packed = packed[s]
        # Within an old group, places stay together; each new group is numbered by its last place.
        new = open_[number(packed)]
        rank[order[open_]] = new
        size = np.bincount(new, minlength=n)
        open_ = open_[size[new] > 1]
        h *= 2
    return order


def kasai(data: np.ndarray, starts: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """lcp[i]: common prefix of suffixes order[i - 1] and order[i], up to ``most`` bytes.

    Kasai's walk in text order, where the common prefix shrinks by one byte at
    most from one suffix to the next; the pieces of ``data`` that begin at
    ``starts`` walk in step, one lane each.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(most + 9, np.uint8)))
    word = np.zeros(len(padded) - 8, dtype=np.uint64)
    for j in range(8):
        word |= padded[j : len(padded) - 8 + j].astype(np.uint64) << U(8 * j)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n, dtype=np.int64)
    ends = np.append(starts[1:], n)
    by_length = np.argsort(starts - ends, kind="stable")  # longest lanes first
    starts, length = starts[by_length], (ends - starts)[by_length]
    h = np.zeros(len(starts), dtype=np.int64)
    for j in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -j, side="left"))  # lanes longer than j
        i = starts[:live] + j
        p = before[i]
        h[:live] = np.where(p >= 0, np.maximum(h[:live] - 1, 0), 0)
        go = np.flatnonzero((p >= 0) & (h[:live] < most))
        while len(go):
            x = word[np.minimum(i[go] + h[go], len(word) - 1)] ^ word[np.minimum(p[go] + h[go], len(word) - 1)]
            low = x & (~x + U(1))  # the lowest set bit lies in the first byte that differs
            same = np.where(x == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) // 8)
            room = n - np.maximum(i[go], p[go])
            h[go] = np.minimum(np.minimum(h[go] + same, most), room)
            go = go[(same == 8) & (h[go] < most) & (h[go] < room)]
        lcp[i] = h[:live]
    return lcp[order]


class Shard:
    """Contexts laid end to end, with their windows in suffix order."""

    def __init__(self, contexts: list[bytes], length: int = LENGTH):
        self.length = length
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        size = np.array([len(c) for c in contexts])
        self.starts = np.cumsum(size) - size
        valid = np.ones(len(self.data), dtype=bool)
        for k in range(1, length):
            valid[np.cumsum(size) - k] = False
        order = suffix_array(self.data)
        lcp = kasai(self.data, self.starts, order, length)
        group = np.cumsum(lcp < length)
        usable = valid[order]
        self.order, group = order[usable], group[usable]
        self.repeated = np.zeros(len(self.data), dtype=bool)
        _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
        self.repeated[self.order[count[inverse] > 1]] = True
        self._padded = np.concatenate((self.data, np.zeros(8, np.uint8)))

    def _rows(self, at: np.ndarray) -> np.ndarray:
        """The windows at ``at`` as rows of big-endian words, which compare as bytes do."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[at]
        short = -self.length % 8
        if short:
            rows = np.concatenate((rows, np.zeros((len(at), short), np.uint8)), axis=1)
        return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)

    def merge(self, other: Shard) -> None:
        """Mark the windows that this shard and ``other`` both have, by binary search in the other's suffix order."""
        for a in range(0, len(self.order), 4096):
            mine = self.order[a : a + 4096]
            rows = self._rows(mine)
            low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(other.order), np.int64)
            while (low < high).any():
                mid = np.minimum((low + high) // 2, len(other.order) - 1)
                there = other._rows(other.order[mid])
                differs = there != rows
                where = differs.argmax(axis=1)
                n = np.arange(len(mine))
                less = differs.any(axis=1) & (there[n, where] < rows[n, where])
                go = low < high
                low = np.where(go & less, mid + 1, low)
                high = np.where(go & ~less, mid, high)
            found = low < len(other.order)
            at = other.order[np.minimum(low, len(other.order) - 1)]
            found &= (other._rows(at) == rows).all(axis=1)
            self.repeated[mine[found]] = True
            # Every equal window of the other shard, not only the first: equal ones are its own repeats, marked already.
            other.repeated[at[found]] = True

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, first, last + 1) of runs of repeated windows, relative to their context."""
        step = np.diff(np.concatenate(([0], self.repeated.astype(np.int8), [0])))
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        context = np.searchsorted(self.starts, a, side="right") - 1
        return context, a - self.starts[context], b - self.starts[context]


def _search(length: int, shard_bytes: int):
    """Over contexts sorted by shard: (shard, print, second, first, past) of their repeated windows."""

    def solve(shards: list[tuple[list[tuple[int, int, int]], Shard]]) -> pa.RecordBatch:
        for i, (_, x) in enumerate(shards):
            for _, y in shards[:i]:
                x.merge(y)
        out = []
        for keys, x in shards:
            c, a, b = x.ranges()
            out += [(*keys[i], p, q) for i, p, q in zip(c.tolist(), a.tolist(), b.tolist())]
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], names=[*_PRINT, "first", "past"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []  # whole anchor groups of two contexts or more
        group: list[tuple] = []
        parts: list = []  # shards of an anchor group that fills several
        ready_bytes = group_bytes = 0
        last = None

        def make(rows: list[tuple]):
            return [r[:3] for r in rows], Shard([r[3] for r in rows], length)

        def close() -> Iterator[pa.RecordBatch]:
            """The current anchor's contexts are complete."""
            nonlocal group, group_bytes, ready, ready_bytes, parts
            if parts:
                yield solve([*parts, *([make(group)] if group else [])])
            elif len(group) > 1:
                ready += group
                ready_bytes += group_bytes
            parts, group, group_bytes = [], [], 0
            if ready_bytes >= shard_bytes:
                yield solve([make(ready)])
                ready, ready_bytes = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] == last:  # the same context from another task
                    continue
                if last and row[0] != last[0]:
                    yield from close()
                last = row[:3]
                group.append(row)
                group_bytes += len(row[3])
                if group_bytes >= shard_bytes:
                    parts.append(make(group))
                    group, group_bytes = [], 0
        yield from close()
        if ready:
            yield solve([make(ready)])

    return run


_RESULT = "doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        firsts, pasts = batch.column(2), batch.column(3)
        out = []
        for i, text in enumerate(batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            a, b = np.array(firsts[i].as_py(), np.int64), np.array(pasts[i].as_py(), np.int64)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.append(True, a[1:] > b[:-1])
            first, past = a[new], b[np.append(new[1:], True)]
            kept, at = hashlib.sha256(), 0
            for p, q in zip(first.tolist(), past.tolist()):
                kept.update(data[at:p])
                at = q
            kept.update(data[at:])
            out.append((len(data), int((past - first).sum()), len(first), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()]))], names=names)


def removal_ranges(rows: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(row_id, first, past): byte ranges to remove; rows has row_id and text."""
    kind = dict(rows.dtypes)["row_id"]
    anchors = stored(rows.select("row_id", "text").mapInArrow(_anchors(length), f"row_id {kind}, anchor long"), "suffix-anchors")
    twice = stored(anchors.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1"), "suffix-twice")
    listed = anchors.join(twice, "anchor").groupBy("row_id").agg(F.collect_set("anchor").alias("known"), F.collect_set(F.when(F.col("times") > hot, F.col("anchor"))).alias("hot"))
    listed = stored(listed, "suffix-listed")
    ids = listed.select("row_id")
    near = rows.join(F.broadcast(ids), "row_id", "left_semi") if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows
    contexts = near.join(listed, "row_id").select("row_id", "text", "known", "hot").mapInArrow(_contexts(length), _CONTEXT.format(kind=kind))
    contexts = stored(contexts, "suffix-contexts")
    dealt = contexts.filter("context IS NOT NULL").select(*_PRINT, "context").repartition("shard").sortWithinPartitions(*_PRINT)
    partly = stored(dealt.mapInArrow(_search(length, shard_bytes), "shard long, print long, second long, first long, past long"), "suffix-marked")
    many = contexts.groupBy(*_PRINT).agg(F.count("*").alias("times"), F.first("windows").alias("past")).filter("times > 1")
    whole = stored(many.select(*_PRINT, F.lit(0).cast("long").alias("first"), "past"), "suffix-whole")
    found = partly.join(whole, _PRINT, "left_anti").unionByName(whole)
    marked = contexts.select(*_PRINT, "row_id", "start").join(stored(found, "suffix-found"), _PRINT)
    return marked.select("row_id", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("past") - 1 + length).alias("past"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; null counts as empty.  A byte is removed if a
    ``length``-byte string over it also starts elsewhere, in the same document or
    another; strings are judged on the input.  Texts shorter than ``length`` stay
    whole.  Rows that repeat a key are documents of their own, and equal ones
    remove each other.  Other columns are not read; an empty table gives an empty
    result.  Strings are compared as bytes within shards; anchors by 64-bit
    hashes, where a chance hit only costs work, and equal contexts by 128 bits
    besides their shard.  Texts that share an anchor with another are moved to
    their anchors' lists where these are too many to send round.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows are told by key and text hash; those that share both are equal and get equal ranges.
    rows = rows.withColumn("row_id", F.struct("doc_id", F.xxhash64("text").alias("text")))
    kind = dict(rows.dtypes)["doc_id"]
    ranges = removal_ranges(rows, length, shard_bytes, hot)
    spans = ranges.distinct().groupBy("row_id").agg(F.collect_list("first").alias("first"), F.collect_list("past").alias("past"))
    spans = stored(spans, "suffix-spans")
    ids = spans.select("row_id")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        touched, clean = rows.join(F.broadcast(ids), "row_id", "left_semi"), rows.join(F.broadcast(ids), "row_id", "left_anti")
    else:
        touched, clean = rows, rows.join(ids, "row_id", "left_anti")
    cut = touched.join(spans, "row_id").select("doc_id", "text", "first", "past").mapInArrow(_remove, _RESULT.format(kind=kind))
    zero = F.lit(0).cast("long")
    whole = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return cut.unionByName(whole)
