"""SentencePiece segmentations sampled without replacement, and decoding.

A text's segmentations are the paths of a lattice.  With independent Gumbel
noise on every path's log-probability, the k largest perturbed paths are a
sample of k distinct segmentations without replacement.  They are found by A*
search from the top: a region is a path's prefix with some next edges ruled out;
its mass is known exactly from the backward sums of the lattice, so the largest
perturbed value in it is one truncated Gumbel draw, which is the search's exact
bound.  Opening the best region draws its path and splits off one region for
each later edge.

A text's lattice is a chain of the lattices of its units (words with the white
space before them): no piece of the model crosses a unit's end, which is checked
when the model is read.  Texts are searched some megabytes at a time: the
lattices of the distinct units are built, every round opens one region of every
text, and nothing is kept from one batch to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import U, mix

SAMPLES = 2
#: Weight of a piece: (rank + 2) ** -SHARPNESS, so frequent pieces are likelier and every further piece costs.
SHARPNESS = 1.0
SPACE = "▁"
#: Bytes of text searched at a time; a longer text is searched alone.
BATCH_BYTES = 1_000_000
SEEN_BITS = 21

_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_SPREAD = U(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(31)
_STEP = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * U(2) + U(1)
_FIRST, _CHOICE, _REGION, _WALK = 1, 2, 3, 4  # what a draw is for


@cache
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def decode(path: str, ids: list[int]) -> str:
    """The text of piece ids, bytes of one character joined."""
    return model(path).decode(ids)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of ranges, one after the other."""
    end = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - (end - size), size)


def _bounds(size: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)))


def uniform(own: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the own value and the number alone."""
    x = mix(own + (np.atleast_1d(number).astype(np.uint64) + U(1)) * _SPREAD)
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _seeds(seed: np.ndarray, what: int, turn: int) -> np.ndarray:
    """Each text's own value for one kind of draw of one round."""
    return mix(seed + np.array([what << 32 | turn], np.uint64) * _SPREAD)


def _log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x <= 0."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(x))


class Vocabulary:
    """The model's pieces by hash, with their weights and bytes."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        m = model(path)
        n = m.get_piece_size()
        pieces = {m.id_to_piece(i): i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        if wrong := [p for p in pieces if not _UNIT.fullmatch(p)]:
            raise ValueError(f"a piece crosses the end of a unit: {wrong[0]!r}")
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes = [b""] * n
        for i in range(n):
            if m.is_byte(i):
                self.bytes[i] = bytes([int(m.id_to_piece(i)[1:-1], 16)])
                self.byte_ids[self.bytes[i][0]] = i
        for p, i in pieces.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        self.plain = np.array([bool(x) for x in self.bytes])
        self.byte_size = np.array([len(x) for x in self.bytes])
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.path = path
        self.longest = max(map(len, pieces))
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        size = np.array([len(p) for p in pieces])
        begin = np.cumsum(size) - size
        value = self.scrambled(chars)
        key = self._hash(value, begin, size)
        order = np.argsort(key)
        self.key, self.piece = key[order], np.array(list(pieces.values()), np.int32)[order]
        # Most substrings are no piece (1), and most can't grow into one (2): a table of hashed bits tells.
        cut = np.arange(len(chars)) - np.repeat(begin, size) + 1
        starts = self._hash(value, np.repeat(begin, size), cut)[cut < np.repeat(size, size)]
        slot = (self.key >> U(64 - SEEN_BITS)).astype(np.int64)
        self.seen = np.zeros(1 << SEEN_BITS, np.uint8)
        self.seen[(starts >> U(64 - SEEN_BITS)).astype(np.int64)] = 2
        self.seen[slot] |= 1
        # The sorted keys by their upper bits: the first of each slot, and how many the fullest has.
        self.first = np.full(1 << SEEN_BITS, -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.fullest = int(np.bincount(slot).max())
        self.log_weight = -sharpness * np.log(np.arange(n) + 2.0)
        self.byte_weight = -sharpness * np.log(n + 2.0)

    @staticmethod
    def scrambled(chars: np.ndarray) -> np.ndarray:
        """Of each character a scrambled value; ranges are hashed by position, up to the longest piece."""
        return mix(chars.astype(np.uint64) + _SPREAD)

    @staticmethod
    def _hash(value: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = size.astype(np.uint64)
        for j in range(int(size.max(initial=0))):
            has = size > j
            out[has] += value[start[has] + j] * _STEP[j]
        return mix(out)

    def lookup(self, key: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The piece of each key, -1 where it is none; slots hold a piece at least."""
        at = self.first[slot]
        out = np.where(self.key[at] == key, self.piece[at], -1)
        for j in range(1, self.fullest):
            other = np.flatnonzero(out < 0)
            other = other[at[other] + j < len(self.key)]
            hit = other[self.key[at[other] + j] == key[other]]
            out[hit] = self.piece[at[hit] + j]
        return out

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each row of ids, as the library decodes it.

        Pieces are bytes laid end to end, less the space in front.  Where a row has
        ids without bytes of their own, or bytes that make no characters, the
        library decodes instead.
        """
        if self.plain[ids].all():
            size = self.byte_size[ids]
            data = self.flat[_ragged(self.byte_start[ids], size)]
            at = _bounds(size)[bounds]
            some = at[:-1] < at[1:]
            first = at[:-1][some]
            front = np.zeros(len(at) - 1, dtype=bool)
            front[some] = data[first] == 0x20
            keep = np.ones(len(data), dtype=bool)
            keep[at[:-1][front]] = False
            if not ((data[first] & 0xC0) == 0x80).any() and _is_utf8(data):
                at = at - np.concatenate(([0], np.cumsum(front)))
                return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[keep].tobytes()))
        return pa.array([decode(self.path, ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])], pa.string())


def _is_utf8(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


@dataclass
class Units:
    """The units of some texts: those of text i are ``bounds[i] .. bounds[i + 1]``; equal ones have one ``kind``."""

    bounds: np.ndarray
    kind: np.ndarray
    chars: np.ndarray  # of the distinct units, end to end
    size: np.ndarray


def units_of(texts: list[bytes]) -> Units:
    """Units of texts as the model normalises them: a space in front, spaces as marks; an empty text has none."""
    try:
        joined = b"".join(texts).decode()
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.diff(_bounds((data & 0xC0) != 0x80)[_bounds(np.array([len(t) for t in texts], np.int64))])
    except UnicodeDecodeError:
        whole = [t.decode(errors="replace") for t in texts]
        joined, size = "".join(whole), np.array([len(t) for t in whole])
    size = size + (size > 0)
    end = np.cumsum(size)
    chars = np.empty(int(size.sum()), np.uint32)
    front = (end - size)[size > 0]
    inner = np.ones(len(chars), dtype=bool)
    inner[front] = False
    chars[inner] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    chars[front] = 0x20
    space, line = chars == 0x20, chars == 0x0A
    chars[space] = ord(SPACE)
    new = line.copy()
    new[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    new[front] = True
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(chars)))
    bounds = np.searchsorted(start, np.append(0, end))
    # Equal units have equal sums of scrambled characters by place; units that differ from their namesake stand alone.
    place = np.arange(len(chars)) - np.repeat(start, length)
    value = mix(chars.astype(np.uint64) * _SPREAD + mix(place.astype(np.uint64) + U(7)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    key = total[start + length] - total[start] + length.astype(np.uint64) * _STEP[0]
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    same = length == length[first[kind]]
    at = np.flatnonzero(same)
    differs = chars[_ragged(start[at], length[at])] != chars[_ragged(start[first[kind[at]]], length[at])]
    if differs.any() or not same.all():
        same[at[np.add.reduceat(differs, _bounds(length[at])[:-1]) > 0]] = False
        odd = np.flatnonzero(~same)
        kind[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate((first, odd))
    return Units(bounds, kind, chars[_ragged(start[first], length[first])], length[first])


class Lattices:
    """Lattices of units as arrays: edges by the node they leave, long pieces first, with conditional probabilities."""

    def __init__(self, v: Vocabulary, chars: np.ndarray, size: np.ndarray):
        end = np.cumsum(size)
        left = np.repeat(end, size) - np.arange(len(chars))
        # Nodes are numbered by what is left to their unit's end, then by unit, long units first.
        by_size = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by_size] = np.arange(len(size))
        longest = int(size.max(initial=0))
        count = np.searchsorted(-size[by_size], -np.arange(longest + 1), side="right")  # units with so many characters or more
        level = _bounds(count)
        total = int(level[-1])
        own = np.repeat(rank, size)
        node = level[left] + own
        value = v.scrambled(chars)
        at, running, found = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
        for n in range(1, min(v.longest, longest) + 1):
            inside = left[at] >= n
            at, running = at[inside], running[inside]
            running = running + value[at + n - 1] * _STEP[n - 1]
            key = mix(running + U(n))
            slot = (key >> U(64 - SEEN_BITS)).astype(np.int64)
            kind = v.seen[slot]
            grows, maybe = kind > 1, kind & 1 > 0
            piece = v.lookup(key[maybe], slot[maybe])
            hit = piece >= 0
            found.append((at[maybe][hit], piece[hit]))
            at, running = at[grows], running[grows]
        bare = np.ones(len(chars), dtype=bool)
        if found:
            bare[found[0][0]] = False
        bare = np.flatnonzero(bare)  # no piece for this character alone: its UTF-8 bytes
        cp = chars[bare].astype(np.int32)
        n_bytes = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        degree = np.zeros(total, np.int64)
        for at, _ in found:
            degree[node[at]] += 1
        degree[node[bare]] += 1
        self.first = _bounds(degree)
        # Long pieces first: they are mostly the likely ones.
        edges, fill = int(self.first[-1]), self.first[:-1].copy()
        self.to, self.id, weight = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        for n, (at, ids, w) in [*((n, (at, ids, v.log_weight[ids])) for n, (at, ids) in reversed([*enumerate(found, 1)])), (1, (bare, -2 - cp, v.byte_weight * n_bytes))]:
            here = node[at]
            to = fill[here]
            fill[here] += 1
            self.to[to], self.id[to], weight[to] = level[left[at] - n] + own[at], ids, w
        self.source = np.repeat(np.arange(total, dtype=np.int32), degree)
        # Backward sums, from the units' ends: all nodes with so many characters left at a time.
        beta, chance = np.zeros(total), np.empty(edges)
        for a, b in zip(level[1:-1].tolist(), level[2:].tolist()):
            e = slice(self.first[a], self.first[b])
            cut, d = self.first[a:b] - self.first[a], degree[a:b]
            x = weight[e] + beta[self.to[e]]
            top = np.maximum.reduceat(x, cut)
            x = np.exp(x - np.repeat(top, d))
            whole = np.add.reduceat(x, cut)
            chance[e] = x / np.repeat(whole, d)
            beta[a:b] = top + np.log(whole)
        self.log_p = np.minimum(weight + beta[self.to] - beta[self.source], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(chance)))
        self.cum = sums[1:] - sums[self.first[self.source]]
        self.root = level[size] + rank
        self.byte_ids = v.byte_ids

    def walk(self, start: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from each start node to its unit's end, drawn by its own value: (which start, edge), in order."""
        which, edges = [], []
        live, node, step = np.arange(len(start)), start.astype(np.int64), 0
        while len(live):
            going = self.first[node + 1] > self.first[node]
            if not going.all():
                live, node = live[going], node[going]
            u = uniform(own[live], step)
            e, last = self.first[node], self.first[node + 1] - 1
            on = np.flatnonzero((self.cum[e] <= u) & (e < last))
            while len(on):
                e[on] += 1
                more = e[on]
                on = on[(self.cum[more] <= u[on]) & (more < last[on])]
            node = self.to[e].astype(np.int64)
            which.append(live)
            edges.append(e)
            step += 1
        which, edges = np.concatenate(which or [live]), np.concatenate(edges or [live])
        order = np.argsort(which, kind="stable")
        return which[order], edges[order]

    def ids(self, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, bounds) of paths; a character without a piece gives its bytes' ids."""
        got = self.id[edges]
        if (got >= 0).all():
            return got, bounds
        bare = np.flatnonzero(got < 0)
        cp = -2 - got[bare]
        size = np.ones(len(got), np.int64)
        size[bare] += (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        to = _bounds(size)
        out = np.repeat(got, size)
        spelled = {c: np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in np.unique(cp).tolist()}
        out[_ragged(to[bare], size[bare])] = self.byte_ids[np.concatenate([spelled[c] for c in cp.tolist()])]
        return out, to[bounds]


@dataclass
class Paths:
    """One round's path of each of some texts, and the regions that leave it.

    Region j of a path has its first edges up to j and another edge than its
    next; ``g`` is a Gumbel draw of its mass, -inf before ``start`` and where it
    was opened.  ``ruled``: at ``start`` these edges (path, edge) are out too.
    """

    text: np.ndarray
    bounds: np.ndarray
    edges: np.ndarray
    unit: np.ndarray  # number of each edge's unit in its text
    value: np.ndarray  # perturbed
    start: np.ndarray
    ruled: tuple[np.ndarray, np.ndarray]
    g: np.ndarray

    def log_prob(self, lattices: Lattices) -> np.ndarray:
        return np.add.reduceat(lattices.log_p[self.edges], self.bounds[:-1])


def _regions(lattices: Lattices, seed: np.ndarray, turn: int, text, bounds, edges, unit, value, start, ruled) -> Paths:
    log_p = lattices.log_p[edges]
    before = np.empty(len(edges))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        np.cumsum(log_p[a:b], out=before[a:b])  # by text, so that a text's draws don't depend on its neighbours
    before -= log_p
    mass = before + _log1mexp(log_p)
    if len(ruled[0]):
        first = bounds[:-1] + start
        gone = np.bincount(ruled[0], np.exp(lattices.log_p[ruled[1]]), minlength=len(text)) + np.exp(log_p[first])
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(gone < 1 - 1e-12, np.log1p(-np.minimum(gone, 1.0)), -np.inf)
        mass[first] = before[first] + rest
    size = np.diff(bounds)
    place = np.arange(len(edges)) - np.repeat(bounds[:-1], size)
    g = mass - np.log(-np.log(uniform(np.repeat(_seeds(seed[text], _REGION, turn), size), place)))
    g[place < np.repeat(start, size)] = -np.inf
    return Paths(text, bounds, edges, unit, value, start, ruled, g)


def _best(rounds: list[Paths], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each of n texts the largest region: (value, round, path in it, place in its flat arrays).

    A region's value is its draw ``g``, given that it lies below its path's.
    """
    value, turn, path, place = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r, p in enumerate(rounds):
        top = np.maximum.reduceat(p.g, p.bounds[:-1])
        at = np.flatnonzero(p.g == np.repeat(top, np.diff(p.bounds)))
        own = np.searchsorted(p.bounds, at, side="right") - 1
        at = at[np.append(True, own[1:] != own[:-1])]
        with np.errstate(invalid="ignore", over="ignore"):
            v = np.where(np.isfinite(top), -np.logaddexp(-p.value, -top), -np.inf)
        better = v > value[p.text]
        to = p.text[better]
        value[to], turn[to], path[to], place[to] = v[better], r, np.flatnonzero(better), at[better]
    return value, turn, path, place


def _choose(lattices: Lattices, u: np.ndarray, edge: np.ndarray, ruled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each job another edge of the same node, none of the ``ruled`` (job, edge)."""
    node = lattices.source[edge]
    first = lattices.first[node]
    size = lattices.first[node + 1] - first
    choice = _ragged(first, size)
    job = np.repeat(np.arange(len(edge)), size)
    chance = np.exp(lattices.log_p[choice])
    out = np.isin(job << 32 | choice, ruled[0] << 32 | ruled[1])
    chance[out] = 0.0
    bounds = _bounds(size)
    got = np.empty(len(edge), np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        c = np.cumsum(chance[a:b])
        got[i] = choice[a + min(int(np.searchsorted(c, u[i] * c[-1], side="right")), int(np.flatnonzero(chance[a:b])[-1]))]
    return got


def sample_batch(v: Vocabulary, texts: list[bytes], seed: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Samples of texts: (text, number, ids, bounds of ids, log probability, perturbed value, log inclusion score), by text and number."""
    units = units_of(texts)
    lattices = Lattices(v, units.chars, units.size)
    count = np.diff(units.bounds)
    text = np.flatnonzero(count)
    rounds: list[Paths] = []
    outside = np.full(len(texts), -np.inf)
    if len(text):
        own = np.repeat(_seeds(seed, _WALK, 1), count) + np.arange(len(units.kind), dtype=np.uint64) - np.repeat(units.bounds[:-1], count).astype(np.uint64)
        which, edges = lattices.walk(lattices.root[units.kind], mix(own))
        bounds = np.searchsorted(which, units.bounds[np.append(text, len(texts))])
        value = -np.log(-np.log(uniform(_seeds(seed[text], _FIRST, 1), 0)))
        unit = which - np.repeat(units.bounds[text], np.diff(bounds))
        none = np.zeros(0, np.int64)
        rounds.append(_regions(lattices, seed, 1, text, bounds, edges, unit, value, np.zeros(len(text), np.int64), (none, none)))
        going = np.zeros(len(texts), dtype=bool)
        going[text] = True
        # Each round opens one region of every text, and walks all their new paths at once.
        for n in range(1, k + 1):
            best, turn, path, place = _best(rounds, len(texts))
            outside[going] = best[going]  # -inf: there are no more segmentations
            going &= np.isfinite(best)
            if n == k or not going.any():
                break
            text = np.flatnonzero(going)
            rounds.append(_open(lattices, units, seed, n + 1, rounds, text, best[text], turn[text], path[text], place[text]))
    # A path is in the sample if its own noise lifts it over the next value left outside.
    number = np.concatenate([np.full(len(p.text), n + 1) for n, p in enumerate(rounds)] or [np.zeros(0, np.int64)])
    owner = np.concatenate([p.text for p in rounds] or [np.zeros(0, np.int64)])
    log_prob = np.concatenate([p.log_prob(lattices) for p in rounds] or [np.zeros(0)])
    value = np.concatenate([p.value for p in rounds] or [np.zeros(0)])
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        x = log_prob - outside[owner]
        inclusion = np.minimum(np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700.0))))), 0.0)
    # The empty segmentation of an empty text is the only one.
    empty = np.flatnonzero(count == 0)
    size = np.concatenate([np.diff(p.bounds) for p in rounds] + [np.zeros(len(empty), np.int64)])
    edges = np.concatenate([p.edges for p in rounds] + [np.zeros(0, np.int64)])
    owner, number = np.append(owner, empty), np.append(number, np.ones(len(empty), np.int64))
    log_prob, value, inclusion = (np.append(c, np.zeros(len(empty))) for c in (log_prob, value, inclusion))
    order = np.lexsort((number, owner))
    begin = (np.cumsum(size) - size)[order]
    ids, bounds = lattices.ids(edges[_ragged(begin, size[order])], _bounds(size[order]))
    return owner[order], number[order], ids, bounds, log_prob[order], value[order], inclusion[order]


def _open(lattices: Lattices, units: Units, seed: np.ndarray, turn: int, rounds: list[Paths], text, value, of, path, place) -> Paths:
    """The path drawn from one region of each text, in round ``turn``."""
    edge, unit, prefix = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    ruled_job, ruled_edge = [np.arange(len(text))], []
    for r, p in enumerate(rounds):
        jobs = np.flatnonzero(of == r)
        edge[jobs], unit[jobs] = p.edges[place[jobs]], p.unit[place[jobs]]
        prefix[jobs] = place[jobs] - p.bounds[path[jobs]]
        p.g[place[jobs]] = -np.inf
        # A path's first region has further edges ruled out.
        job_of = np.full(len(p.text), -1)
        job_of[path[jobs]] = np.where(prefix[jobs] == p.start[path[jobs]], jobs, -1)
        out = job_of[p.ruled[0]] >= 0
        ruled_job.append(job_of[p.ruled[0][out]])
        ruled_edge.append(p.ruled[1][out])
    ruled = np.concatenate(ruled_job), np.concatenate([edge, *ruled_edge])
    chosen = _choose(lattices, uniform(_seeds(seed[text], _CHOICE, turn), 0), edge, ruled)
    # The rest of the unit, then the text's later units.
    later = np.diff(units.bounds)[text] - unit - 1
    begin = _bounds(later + 1)
    start = np.empty(begin[-1], np.int64)
    start[begin[:-1]] = lattices.to[chosen]
    rest = np.ones(len(start), dtype=bool)
    rest[begin[:-1]] = False
    start[rest] = lattices.root[units.kind[_ragged(units.bounds[text] + unit + 1, later)]]
    number = np.arange(len(start)) - np.repeat(begin[:-1], later + 1)
    which, walked = lattices.walk(start, mix(np.repeat(_seeds(seed[text], _WALK, turn), later + 1) + number.astype(np.uint64)))
    cut = np.searchsorted(which, begin)
    size = prefix + 1 + np.diff(cut)
    bounds = _bounds(size)
    edges, unit_of = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    for r, p in enumerate(rounds):
        jobs = np.flatnonzero(of == r)
        take, to = _ragged(p.bounds[path[jobs]], prefix[jobs]), _ragged(bounds[jobs], prefix[jobs])
        edges[to], unit_of[to] = p.edges[take], p.unit[take]
    edges[bounds[:-1] + prefix], unit_of[bounds[:-1] + prefix] = chosen, unit
    to = _ragged(bounds[:-1] + prefix + 1, np.diff(cut))
    edges[to] = walked
    unit_of[to] = number[which] + np.repeat(unit, np.diff(cut))
    return _regions(lattices, seed, turn, text, bounds, edges, unit_of, value, prefix, ruled)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BATCH_BYTES of text."""
    text = batch.column(1)
    at = text.buffers()[1]
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offset = np.frombuffer(at, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + BATCH_BYTES, side="right")) - 1)
        yield i, min(j, len(text))
        i = j


def _run(path: str, k: int, sharpness: float, seed: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path, sharpness)
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = mix(batch.column(2).to_numpy().astype(np.uint64) * _SPREAD + U(seed))
            for a, b in _batches(batch):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).slice(a, b - a)]
                owner, number, ids, bounds, *values = sample_batch(v, texts, seeds[a:b], k)
                more = [v.decoded(ids, bounds)] if decoded else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + a)), pa.array(number, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), *map(pa.array, values), *more],
                    names=["doc_id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", *["text"] * decoded],
                )

    return run


def sample_segmentations(docs: DataFrame, path: str, k: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = 0, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Up to k rows per document: doc_id, sample, ids, log_prob, perturbed, log_inclusion.

    The segmentations of one document are distinct, in the order of their
    perturbed values; a document with fewer than k segmentations gives all of
    them.  log_inclusion is the log of the probability that a segmentation lies
    above the first value left outside, for weighting without bias; 0 where all
    were taken.  Null and empty texts have one segmentation without pieces.
    Draws depend on the key (of any type, null too), the text and ``seed`` alone,
    so rows that repeat a key and its text repeat their samples.  Other columns
    are not read; an empty table gives no rows.  ``decoded`` adds the decoded
    ``text`` of the ids, in the worker that drew them.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("seed"))
    return rows.mapInArrow(_run(path, k, sharpness, seed, decoded), f"doc_id {dict(rows.dtypes)['doc_id']}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double" + ", text string" * decoded)


def decode_segmentations(samples: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``samples`` with the decoded ``text`` of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            if not len(column):
                continue
            flat, size = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            size[~column.is_valid().to_numpy(zero_copy_only=False)] = 0
            text = v.decoded(flat, _bounds(size))
            text = pa.array([None if n else x for n, x in zip(column.is_null().to_pylist(), text.to_pylist())], pa.string()) if column.null_count else text
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])

    return samples.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in samples.dtypes) + ", text string")
