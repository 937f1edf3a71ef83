"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document is a set of word shingles.  Shingles have one order for the
whole corpus, rare ones first, by a count sketch of fixed size over all
documents.  If J(x, y) >= t, the first ``n - ceil(t n) + l`` shingles of either
set share l or more.  Each document lengthens its own prefix to the l that it
expects to be cheapest; a pair is a candidate if it shares at least the smaller
of its two l.  Candidates whose parity signatures differ too much go, and the
rest are verified on their whole sets.

Documents with equal sets form one class and are joined once.  Candidates are
searched in steps, so that a large group of near copies doesn't give all its
pairs: each posting list is first compared with its first member, then with its
best connected one; at last only pairs in different components are compared, all
of them.  The first step asks for the l shared prefix shingles; the others don't
see all of a pair's lists, so there one shared shingle and the signatures decide
who is verified: counting all lists took three times the disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, extended
from .shared import one_of_each, stored, text_hash
from .textkernel import U, distinct, mix, shingles, text_blocks

BUCKET_BITS = 22
CHUNKS = 64
#: The sketch comes to the driver in so many parts, one after the other.
SKETCH_PARTS = 4
MAX_EXTRA = 8
#: Estimated cost of verifying one candidate, in posting entries read.
VERIFY_COST = 20.0
#: Involved ids up to this many are broadcast, at 8 bytes each; more go through a shuffle join.
BROADCAST_IDS = 1_000_000

#: Posting lists are split into parts of about 2 ** SPLIT_BITS classes.
SPLIT_BITS = 12
#: Keys that a task remembers, to give out repeated rows and equal sets once; then it starts anew.
SEEN_ROWS = 200_000
#: Bits of the parity signature that bounds a pair's difference from below.
SIGNATURE_BITS = 1024
#: Larger sets, where that says little, have one of so many bits besides.
WIDE_FROM, WIDE_BITS = 1_500, 1 << 14
_SUMMARY = "doc_id long, row long, n long, k1 long, k2 long, parity array<long>, wide array<long>, chunk int, counts binary"
_BUCKETS = 1 << BUCKET_BITS


def _sums(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two order-free 64-bit fingerprints) of each text."""
    size = np.bincount(text, minlength=n)
    out = []
    for salt in (U(0x51ED2701), U(0xA24BAED4)):
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + salt), dtype=np.uint64)))
        ends = np.cumsum(size)
        out.append((c[ends] - c[ends - size]).view(np.int64))
    return size.astype(np.int64), out[0], out[1]


def _parity(text: np.ndarray, h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Per text, the parity of the number of shingles that fall on each bit, as rows of 64-bit words."""
    odd = np.bincount(text * bits + (h & U(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, bits // 64)


def _signatures(text: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each text's short signature, and the wide one of large sets (else empty)."""
    short = _parity(text, h, len(size), SIGNATURE_BITS)
    large = np.flatnonzero(size > WIDE_FROM)
    wide = [_parity(np.zeros(size[i], np.int64), h[text == i], 1, WIDE_BITS)[0] for i in large]
    ends = np.concatenate(([0], np.cumsum(np.where(size > WIDE_FROM, WIDE_BITS // 64, 0)))).astype(np.int32)
    words = np.concatenate(wide) if wide else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * (SIGNATURE_BITS // 64)), pa.array(short.ravel())), pa.ListArray.from_arrays(pa.array(ends), pa.array(words))


def _summarise(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_BUCKETS, dtype=np.uint32)
        names = ["doc_id", "row", "n", "k1", "k2", "parity", "wide", "chunk", "counts"]
        for batch in batches:
            for block in text_blocks(batch.column(2)):
                text, h, _ = shingles(block, k)
                text, h = distinct(text, h)
                bucket, times = np.unique(h >> U(52 - BUCKET_BITS), return_counts=True)
                counts[bucket.astype(np.int64)] += times.astype(np.uint32)
                size, k1, k2 = _sums(text, h, block.n)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(block.first, block.n) for i in (0, 1)), pa.array(size), pa.array(k1), pa.array(k2), *_signatures(text, h, size), pa.nulls(block.n, pa.int32()), pa.nulls(block.n, pa.binary())], names=names)
        if counts.any():
            # A byte a bucket: beyond 255 in one task, a shingle is common enough to tell.
            parts = [x.astype(np.uint8).tobytes() for x in np.split(np.minimum(counts, 255), CHUNKS)]
            none = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, *[pa.nulls(CHUNKS, pa.list_(pa.int64()))] * 2, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the tasks' sketches of each chunk."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            got = np.frombuffer(counts.as_buffer(), dtype=np.uint8).astype(np.uint32)
            total[chunk] = total[chunk] + got if chunk in total else got
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<u4").tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])


def _count_sketch(summary: DataFrame) -> np.ndarray:
    """All documents' shingle counts by hash bucket: 16 MB, whatever the corpus."""
    rows = summary.filter("chunk IS NOT NULL").select("chunk", "counts")
    one = rows.repartition(min(CHUNKS, 16), "chunk").mapInArrow(_add_counts, "chunk int, counts binary").coalesce(SKETCH_PARTS)
    out = np.zeros(_BUCKETS, dtype=np.uint32)
    for r in one.toLocalIterator():  # CHUNKS rows; each partition is a job
        out[r.chunk * (_BUCKETS // CHUNKS) : (r.chunk + 1) * (_BUCKETS // CHUNKS)] = np.frombuffer(r.counts, dtype="<u4")
    return out


_PREFIX = ["token", "part", "k1", "k2", "nl"]


def _emit_prefixes(k: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        usual = int(np.median(counts))
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                text, h, _ = shingles(block, k)
                text, h = distinct(text, h)
                size, k1, k2 = _sums(text, h, block.n)
                fresh = np.zeros(block.n, dtype=bool)
                if len(seen) > SEEN_ROWS:
                    seen.clear()
                for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                    if size[i] and key not in seen:  # copies within a task are emitted once
                        seen.add(key)
                        fresh[i] = True
                use = fresh[text]
                text, h = text[use], h[use]
                if not len(text):
                    continue
                seen_count = counts[(h >> U(52 - BUCKET_BITS)).astype(np.int64)]
                level = np.minimum(seen_count, (1 << 20) - 1).astype(np.uint64)  # 20 bits of the packed value
                packed = (text.astype(np.uint64) << U(52)) | (level << U(32)) | np.arange(len(h), dtype=np.uint64)
                packed.sort()
                order = (packed & U(0xFFFFFFFF)).astype(np.int64)
                text, h, cost = text[order], h[order], np.maximum(seen_count[order].astype(np.float64) - usual, 0.0)
                n = np.where(fresh, size, 0)
                begin = np.cumsum(n) - n
                place = np.arange(len(text)) - begin[text]
                spare = n - -(-percent * n // 100)  # shingles that may be missing
                total = np.concatenate(([0.0], np.cumsum(cost)))
                best, extra = np.full(block.n, np.inf), np.ones(block.n, dtype=np.int64)
                for l in range(1, MAX_EXTRA + 1):
                    length = np.minimum(spare + l, n)
                    read = total[begin + length] - total[begin]
                    price = np.where(length == spare + l, read + VERIFY_COST * read / l + l, np.inf)
                    better = price < best
                    best[better], extra[better] = price[better], l
                take = place < (spare + extra)[text]
                t = text[take]
                # Long posting lists are split by class.
                parts = 1 + (seen_count[order][take].astype(np.int64) >> SPLIT_BITS)
                part = parts << 32 | (k1[t] & 0x7FFFFFFF) % parts
                yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(part), pa.array(k1[t]), pa.array(k2[t]), pa.array(n[t] << 8 | extra[t])], names=_PREFIX)

    return run


_STAR = ["token", "a1", "a2", "anl", "b1", "b2", "bnl", "more"]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, part and class: each list's first class (a) with every other class (b).

    ``more``: the token has three classes or more, or several parts; then each
    part's first class has a row with itself, too.  A list that is a token's only
    part and has only one class gives no row.  Rows stream; of a list only its first
    class and its latest row are held.
    """
    lead: np.ndarray | None = None  # the current list's first row: token, part, k1, k2, nl
    held: np.ndarray | None = None  # the latest distinct row, not given out yet
    place = 0  # of the held row in its list

    def give(rows: np.ndarray, leads: np.ndarray, places: np.ndarray, last: np.ndarray) -> pa.RecordBatch | None:
        several = rows[1] >> 32 > 1  # parts of the token
        more = several | (places > 1) | ~last
        out = (places > 0) | several
        a, b = leads[:, out], rows[:, out]
        columns = [pa.array(np.ascontiguousarray(c)) for c in (b[0], *a[2:], *b[2:])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(more[out])], names=_STAR) if b.shape[1] else None

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if held is not None:
            rows = np.concatenate((held, rows), axis=1)
        rows = rows[:, np.append(True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0))]
        n = rows.shape[1]
        if not n:
            continue
        first = np.append(held is None or place == 0, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
        at = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        leads = rows[:, np.maximum(at, 0)]
        if lead is not None:
            leads[:, at < 0] = lead
        places = np.where(at >= 0, np.arange(n) - at, np.arange(n) + place)
        if (part := give(rows[:, :-1], leads[:, :-1], places[:-1], first[1:])) is not None:
            yield part
        held, place, lead = rows[:, -1:], int(places[-1]), leads[:, -1:]
    if held is not None and (part := give(held, lead, np.array([place]), np.array([True]))) is not None:
        yield part


def _linked(x: Column, y: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (x + y - both)


def _close_enough(pa_: Column, pb: Column, na: Column, nb: Column, percent: int) -> Column:
    """Two sets differ in at least as many shingles as their parity signatures in bits; J >= t allows (1 - t) / (1 + t) of the sizes' sum."""
    apart = sum((F.bit_count(pa_[i].bitwiseXOR(pb[i])) for i in range(SIGNATURE_BITS // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def _verify(near: DataFrame, wide: DataFrame, classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Of near pairs of ids (a, b), those that link: compared on their whole sets, made only for documents that need it.

    wide (id, size, wide): the signatures of large sets, which rule out most pairs of them before any set is moved.
    """
    own = lambda c: wide.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    far = (100 + percent) * apart > (100 - percent) * (F.col("na") + F.col("nb"))
    near = stored(near.join(own("a"), "a", "left").join(own("b"), "b", "left").filter(~F.coalesce(far, F.lit(False))).select("a", "b"), "ngram-close")
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    ids = stored(ids.join(classes.select("id", "k1", "k2", "text_of"), "id"), "ngram-ids")
    # A class's texts all give its set; the one of its smallest key is read.
    few = ids.select(F.col("text_of.doc_id").alias("few_id"), F.col("text_of.row").alias("few_row"))
    few = F.broadcast(few) if few.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else few
    read = rows.join(few, rows.doc_id.eqNullSafe(few.few_id) & (rows.row == few.few_row), "left_semi")
    sets = read.select("row", "text").mapInArrow(_emit_sets(words), "k1 long, k2 long, tokens array<long>")
    sets = stored(sets.join(ids.select("id", "k1", "k2"), ["k1", "k2"]).select("id", "tokens"), "ngram-sets")
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return near.join(left, "a").join(right, "b").filter(_linked(F.size("ta"), F.size("tb"), both, percent)).select("a", "b").distinct()


def _open(placed: DataFrame) -> DataFrame:
    """The postings (token, part, ..) of tokens whose classes lie in several components."""
    mixed = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("token")
    return placed.join(mixed, "token", "left_semi")


def _emit_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat within a task are emitted once
        for batch in batches:
            fresh = np.array([r not in seen and not seen.add(r) for r in batch.column(0).to_pylist()], dtype=bool)
            if len(seen) > SEEN_ROWS:
                seen.clear()
            for block in text_blocks(batch.filter(pa.array(fresh)).column(1)):
                text, h, _ = shingles(block, k)
                text, h = distinct(text, h)
                size, k1, k2 = _sums(text, h, block.n)
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["k1", "k2", "tokens"])

    return run


def _components(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """(doc_id, row, n, group, smallest) per row: the text's hash, the set's size, its component (null: the empty set) and the component's smallest key."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("row"), F.col(text).alias("text"))
    summary = stored(rows.mapInArrow(_summarise(words), _SUMMARY), "ngram-summary")
    mine = summary.filter("chunk IS NULL").select("doc_id", "row", "n", "k1", "k2")
    classes = summary.filter("chunk IS NULL").filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("text_of"), F.first("n").alias("size"), F.first("parity").alias("parity"), F.first("wide").alias("wide"))
    # Keys may repeat or be null, so classes are numbered; the numbers hold as they are written.
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "ngram-classes")

    sketch = spark.sparkContext.broadcast(_count_sketch(summary))
    prefixes = rows.select("text").mapInArrow(_emit_prefixes(words, percent, sketch), ", ".join(f"{c} long" for c in _PREFIX))
    stars = prefixes.repartition("token", "part").sortWithinPartitions("token", "part", "k1", "k2").mapInArrow(_stars, ", ".join(f"{c} {'boolean' if c == 'more' else 'long'}" for c in _STAR))
    stars = stored(stars, "ngram-stars")
    sketch.destroy()
    n_of, l_of = (lambda c: F.shiftright(c, 8)), (lambda c: F.col(c).bitwiseAND(255))
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))

    # Each posting list's first class against its others.
    star = (
        stars.filter((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")))
        .filter(fits(n_of("anl"), n_of("bnl")))
        .groupBy("a1", "a2", "b1", "b2")
        .agg(F.count("*").alias("both"), F.min(F.least(l_of("anl"), l_of("bnl"))).alias("l"))
        .filter("both >= l")
    )
    wide = stored(classes.filter(F.size("wide") > 0).select("id", "size", "wide"), "ngram-wide")
    own = lambda c: classes.select(F.col("k1").alias(f"{c}1"), F.col("k2").alias(f"{c}2"), F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    near = star.join(own("a"), ["a1", "a2"]).join(own("b"), ["b1", "b2"]).filter(_close_enough(F.col("pa"), F.col("pb"), F.col("na"), F.col("nb"), percent))
    links = stored(_verify(stored(near.select("a", "b"), "ngram-near"), wide, classes, rows, words, percent), "ngram-links")
    part = connected_components(links)

    # Then the others, where they aren't connected yet. A pair that links shares l prefix shingles: either it is the
    # first class's pair in all of them and was tried, or it turns up here.
    nodes = classes.join(part, "id", "left").select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "id", F.coalesce("component", "id").alias("part"))
    placed = stars.filter("more").join(nodes, ["b1", "b2"]).select("token", "id", n_of("bnl").alias("n"), "part")
    placed = stored(_open(placed).join(classes.select("id", "parity"), "id"), "ngram-placed")
    close = lambda x, y: fits(F.col(f"{x}n"), F.col(f"{y}n")) & _close_enough(F.col(f"{x}parity"), F.col(f"{y}parity"), F.col(f"{x}n"), F.col(f"{y}n"), percent)
    pair = lambda x, y: (F.least(f"{x}id", f"{y}id").alias("a"), F.greatest(f"{x}id", f"{y}id").alias("b"))
    # A near copy's original shares more shingles than any other copy: the member with the most postings is tried next.
    weight = placed.groupBy("id").agg(F.count("*").alias("w"))
    hub = placed.join(weight, "id").groupBy("token").agg(F.max_by(F.struct("id", "n", "parity", "part"), F.struct("w", "id")).alias("hub"))
    spokes = placed.join(hub.select("token", *(F.col(f"hub.{c}").alias(f"x_{c}") for c in ("id", "n", "parity", "part"))), "token")
    spokes = spokes.filter((F.col("part") != F.col("x_part")) & close("", "x_")).select(*pair("", "x_")).distinct()
    part = extended(part, stored(_verify(stored(spokes, "ngram-near"), wide, classes, rows, words, percent), "ngram-links"))
    placed = placed.drop("part").join(part, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    placed = stored(_open(placed), "ngram-placed")

    # At last all pairs of classes in different components; of a list's largest component only those with others.
    by_part = placed.groupBy("token", "part").agg(F.count("*").alias("rows"))
    main = by_part.groupBy("token").agg(F.max_by("part", F.struct("rows", "part")).alias("main"))
    lists = stored(placed.join(main, "token").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")), "ngram-lists")
    # Sets that may link lie in the same or neighbouring bands of sizes, which split the lists.
    bands = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    outside = lists.filter("part != main").select("token", *(F.col(c).alias(f"x_{c}") for c in ("id", "n", "parity", "part")), bands.alias("band"))
    once = (F.col("part") != F.col("x_part")) & ((F.col("part") == F.col("main")) | (F.col("x_id") < F.col("id")))
    across = outside.join(lists, ["token", "band"]).filter(once & close("", "x_")).select(*pair("", "x_")).distinct()
    part = extended(part, stored(_verify(stored(across, "ngram-near"), wide, classes, rows, words, percent), "ngram-links"))

    member = stored(classes.join(part, "id", "left").select("k1", "k2", F.col("text_of.doc_id").alias("least"), F.coalesce("component", "id").alias("group")), "ngram-members")
    smallest = member.groupBy("group").agg(F.min("least").alias("smallest"))
    return mine.join(member.join(smallest, "group").select("k1", "k2", "group", "smallest"), ["k1", "k2"], "left").select("doc_id", "row", "n", "group", "smallest")


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of ``words``-word shingles over the whole text, A-Z lower-cased; a text
    of fewer words is one shingle.  component_id is the smallest key reachable
    over links.  Null texts and texts without words have the empty set and link
    with nothing.  Keys are integers; rows that repeat a key are documents of their
    own, a null key is never the smallest, and a component of null keys alone has
    none.  Other columns are not read; an empty table gives an empty result.

    Shingles are 52-bit hashes: two different shingles of one compared pair fall
    together with a chance of about 1e-10 for documents of a thousand words.
    """
    found = _components(docs, words, percent, key, text)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key; rows without words stay."""
    found = stored(_components(docs, words, percent, key, text).select("doc_id", "row", "group"), "ngram-groups")
    return one_of_each(docs, found, "group", key, text)
