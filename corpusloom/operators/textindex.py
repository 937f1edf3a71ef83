"""A stored full-text index: impact-ordered postings in blocks, statistics that updates add to, exact top-k with pruning.

Below the index's folder every update writes one generation of these tables:

* ``postings``: by bucket of terms, sorted by term and falling impact; a row is a block of up to ``BLOCK`` postings
  (keys, term frequencies, document lengths) with the greatest impact in it;
* ``forward``: a row per document with its terms, so that a document can be taken back;
* ``terms`` and ``corpus``: what the update adds to, or takes from, document frequencies, the number of documents and
  of words;
* ``gone``: documents of earlier generations that it replaces or removes.

An update makes the forward rows in the tasks that read the texts.  From there tasks turn about a million postings at a
time to lists by term, and lists are what is shuffled, never a row per posting; a frequent term's full blocks are dealt
over all slices of its bucket.

A manifest names the generations that count; it is published last, so a search sees an update whole or not at all.

An impact is BM25's factor of term frequency and length without the idf.  It depends on the mean length, which updates
move, so a block's impact is held against the mean length of its own generation: the factor grows at most as the mean
does, which keeps the bound safe.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.versions import Versions
from .search import IDF_FLOOR, K1, B, document_tokens, plain_terms

BLOCK = 1024
BUCKETS = 64
#: Postings of each term that a search's first step reads; every further step reads eight times as many.
FIRST, MORE = 4 * BLOCK, 8
#: Impacts lie between 0 and K1 + 1; their histogram has so many steps to 1.
STEPS = 64
FORMAT = 2
#: Words or postings that a task works on at once; a document with more is worked on alone.
AT_ONCE = 1 << 20
#: Postings of a slice of a bucket, which one task merges.
SLICE = 1 << 21
#: Blocks of one term that a task sorts together.
HELD = 64
TABLES = {
    "postings": "term string, most double, n int, keys array<{key}>, tfs array<int>, dls array<int>, gen int, bucket int", "forward": "key {key}, dl int, n int, terms array<string>, tfs array<int>, gen int",
    "terms": "term string, df long, gen int, bucket int", "corpus": "n long, words long, gone long, gen int", "gone": "key {key}, gen int",
}


def _impact(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _pieces(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[slice]:
    """Runs of rows with at most ``most`` items together, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_starts(sizes).astype(np.int32)), values)


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The items of a column of lists."""
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten()


def _sizes(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _counts(kind: pa.DataType, stem: Callable[[str], str] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (key, words) to a row per key with its different words, or their stems, and their numbers of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 18)(stem) if stem else None
        for batch in batches:
            every = _sizes(batch.column("words"))
            for rows in _pieces(every):
                sizes, part = every[rows], batch.slice(rows.start, rows.stop - rows.start)
                words = _flat(part.column("words")).dictionary_encode()
                code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
                if known:
                    stems = pa.array([known(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
                    code, names = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code], stems.dictionary
                wide = max(1, len(names))
                pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + code, return_counts=True)
                n = np.bincount(pairs // wide, minlength=len(sizes))
                columns = [part.column("key").cast(kind), pa.array(sizes.astype(np.int32)), pa.array(n.astype(np.int32)), _lists(n, names.take(pa.array(pairs % wide))), _lists(n, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "dl", "n", "terms", "tfs"])

    return run


def _impacts(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


_NAMES = ["bucket", "term", "most", "n", "keys", "tfs", "dls"]


def _blocks_of(code: np.ndarray, names: pa.Array, keys: pa.Array, tfs: np.ndarray, dls: np.ndarray, mean: float, size: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(rank of each block in its term, columns from ``term`` on): postings by term and falling impact, cut to blocks of ``size``."""
    impact = _impacts(tfs, dls, mean)
    order = np.lexsort((-impact, code))
    code, impact = code[order], impact[order]
    runs = np.flatnonzero(np.diff(code, prepend=-1))
    within = np.arange(len(code)) - np.repeat(runs, np.diff(runs, append=len(code)))
    begin = np.flatnonzero(within % size == 0)
    sizes = np.diff(begin, append=len(code))
    lists = [_lists(sizes, x) for x in (keys.take(pa.array(order)), pa.array(tfs[order].astype(np.int32)), pa.array(dls[order].astype(np.int32)))]
    return within[begin] // size, [names.take(pa.array(code[begin])), pa.array(impact[begin]), pa.array(sizes.astype(np.int32)), *lists]


def _inverted(mean: float, buckets: int, slices: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From forward rows to blocks of about a million postings each time, with the slice of a bucket where each goes.

    What is left of a term meets in one slice, to be merged there; full blocks are dealt over the slices.
    """

    def turned(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        n = table.column("n").to_numpy().astype(np.int64)
        terms = _flat(table.column("terms")).dictionary_encode()
        of = np.repeat(np.arange(len(n)), n)
        keys, dls = table.column("key").combine_chunks(), table.column("dl").to_numpy()
        rank, columns = _blocks_of(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary, keys.take(pa.array(of)), _flat(table.column("tfs")).to_numpy(), dls[of], mean, size)
        digest = np.array([zlib.crc32(t.encode()) for t in columns[0].to_pylist()], np.int64)
        bucket, full = digest % buckets, columns[2].to_numpy() == size
        at = bucket * slices + (digest // buckets + np.where(full, rank, 0)) % slices
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), *columns], names=["at", *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            every = batch.column("n").to_numpy().astype(np.int64)
            for rows in _pieces(every):
                more = int(every[rows].sum())
                if count and count + more > AT_ONCE:
                    yield turned(held)
                    held, count = [], 0
                held.append(batch.slice(rows.start, rows.stop - rows.start))
                count += more
        if count:
            yield turned(held)

    return run


def _blocks(mean: float, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge blocks that come by term and falling impact to blocks of ``size``; a batch's last term goes on in the next."""

    def cut(table: pa.Table) -> pa.RecordBatch:
        n = table.column("n").to_numpy().astype(np.int64)
        terms = table.column("term").combine_chunks().dictionary_encode()
        code = np.repeat(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), n)
        _, columns = _blocks_of(code, terms.dictionary, _flat(table.column("keys")), _flat(table.column("tfs")).to_numpy(), _flat(table.column("dls")).to_numpy(), mean, size)
        bucket = pa.array(np.full(len(columns[0]), table.column("bucket")[0].as_py(), np.int32))
        return pa.RecordBatch.from_arrays([bucket, *columns], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for rows in _pieces(batch.column("n").to_numpy().astype(np.int64)):
                table = pa.Table.from_batches([batch.slice(rows.start, rows.stop - rows.start)])
                table = table if left is None else pa.concat_tables([left, table])
                terms = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                last = int(np.flatnonzero(np.diff(terms, prepend=-1))[-1])
                if table.column("n").to_numpy()[last:].sum() >= HELD * size:
                    last = len(table)
                if last:
                    yield cut(table.slice(0, last))
                left = table.slice(last) if last < len(table) else None
        if left is not None:
            yield cut(left)

    return run


class TextIndex:
    """A full-text index over documents (key, text), kept below ``root``.

    ``words`` cuts a text to terms.  ``stem`` may change a term, in texts and in a
    query alike.  The number of ``buckets`` is fixed when the index is made; a bucket
    is written in as many slices as its postings need.  ``settings`` are stamped on the index: one that was made with
    others, or whose tables are missing, is made anew (:meth:`opened`).
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", text: str = "text", words: Callable[[Column], Column] = document_tokens, stem: Callable[[str], str] | None = None, buckets: int = BUCKETS, settings: dict[str, str] | None = None):
        self.spark, self.key, self.text, self.words, self.stem = spark, key, text, words, stem
        self.versions = Versions(spark, root)
        self.buckets = int(self.manifest().get("settings", {}).get("buckets", buckets))
        self.settings = {"format": str(FORMAT), "buckets": str(self.buckets), **(settings or {})}

    # ---- state ----

    def manifest(self) -> dict:
        return self.versions.latest()[1]

    def generations(self) -> list[dict]:
        return self.manifest().get("generations", [])

    def why_rebuild(self) -> str | None:
        """What keeps the index from being used as it is: a setting's name, ``tables``, or None."""
        manifest = self.manifest()
        if not manifest:
            return None
        for name, value in self.settings.items():
            if manifest["settings"].get(name) != value:
                return name
        for g in manifest["generations"]:
            if any(g["name"] not in self.versions.names(t) for t in TABLES if t != "gone"):
                return "tables"
        return None

    def reset(self) -> None:
        """Publish an index without documents; the generations before stay until :meth:`clean`."""
        number, _ = self.versions.latest()
        self.versions.publish(number + 1, {"settings": self.settings, "generations": []})

    def opened(self) -> str | None:
        """Make the index usable: a new one, or one that must be rebuilt, is published empty; the reason is returned."""
        why = self.why_rebuild()
        if why or not self.manifest():
            self.reset()
        return why

    def clean(self) -> None:
        """Delete generations that the last version doesn't name.  Not while another writer works on the index."""
        used = {g["name"] for g in self.generations()}
        for table in TABLES:
            for name in set(self.versions.names(table)) - used:
                self.versions.delete(table, name)

    # ---- writing ----

    def _emptied(self, name: str) -> Callable[[str], str]:
        """Where a generation's tables go; what a stopped update of its number left is deleted."""
        for table in TABLES:
            self.versions.delete(table, name)
        return lambda table: f"{self.versions.root}/{table}/{name}"

    def _counted(self, docs: DataFrame) -> DataFrame:
        """key, dl, n, terms, tfs of each document; its words lie in one row, so they are counted in its batch and not shuffled."""
        cut = docs.select(F.col(self.key).alias("key"), F.coalesce(self.words(F.col(self.text)), F.array().cast("array<string>")).alias("words"))
        return cut.mapInArrow(_counts(to_arrow_type(cut.schema["key"].dataType), self.stem), f"key {dict(cut.dtypes)['key']}, dl int, n int, terms array<string>, tfs array<int>")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> dict:
        """Index ``changed`` (key, text; one row a key), which replaces what its keys had, and take ``removed`` (key) back.

        Returns the new generation's entry.  No texts but those of ``changed`` are read.
        """
        number, manifest = self.versions.latest()
        old = manifest["generations"]
        gen = max([g["gen"] for g in old], default=0) + 1
        name = f"gen={gen}"
        path = self._emptied(name)
        fresh = self._counted(changed)
        fresh.write.parquet(path("forward"))
        fresh = self.spark.read.schema(fresh.schema).parquet(path("forward"))
        sums = fresh.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
        lost = self.spark.createDataFrame([(0, 0)], "gone long, lost long")
        dead = None
        if old:
            keys = fresh.select("key")
            if removed is not None:
                keys = keys.unionByName(removed.select(F.col(self.key).alias("key")))
            # The narrow rows first: which documents go, then the terms of these.
            self._live("forward").select("key", "gen", "dl").join(keys.distinct(), "key", "left_semi").write.parquet(path("gone"))
            gone = self.spark.read.schema(f"key {dict(fresh.dtypes)['key']}, gen int, dl int").parquet(path("gone"))
            lost = gone.agg(F.count("*").alias("gone"), F.coalesce(F.sum("dl"), F.lit(0)).alias("lost"))
            dead = self._read("forward").join(gone, ["key", "gen"], "left_semi").select(F.explode("terms").alias("term"))
        added = sums.crossJoin(lost).first()
        n, words = sum(g["n"] for g in old) + added.n - added.gone, sum(g["words"] for g in old) + added.words - added.lost
        mean = words / n if n and words else 1.0
        self._write_postings(fresh, path, mean, added.postings)
        self._write_terms(path, dead)
        entry = {"gen": gen, "name": name, "key": dict(fresh.dtypes)["key"], "n": added.n - added.gone, "words": added.words - added.lost, "gone": added.gone, "mean": mean}
        self._write_corpus(entry, path)
        self.versions.publish(number + 1, {"settings": manifest["settings"], "generations": [*old, entry]})
        return entry

    def _write_corpus(self, entry: dict, path: Callable[[str], str]) -> None:
        self.spark.createDataFrame([(entry["n"], entry["words"], entry["gone"])], "n long, words long, gone long").coalesce(1).write.parquet(path("corpus"))

    def _write_terms(self, path: Callable[[str], str], dead: DataFrame | None = None) -> None:
        """What the generation's postings add to document frequencies, less the terms of ``dead``."""
        both = self.spark.read.schema("term string, n int").parquet(path("postings")).groupBy("term").agg(F.sum("n").alias("df"))
        if dead is not None:
            both = both.unionByName(dead.groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0")
        both.withColumn("bucket", _bucket(F.col("term"), self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path("terms"))

    def _write_postings(self, rows: DataFrame, path: Callable[[str], str], mean: float, postings: int) -> None:
        kind = dict(rows.dtypes)["key"]
        slices = max(1, -(-postings // (self.buckets * SLICE)))
        schema = f"bucket int, term string, most double, n int, keys array<{kind}>, tfs array<int>, dls array<int>"
        order = ["bucket", "term", F.desc("most")]
        placed = rows.mapInArrow(_inverted(mean, self.buckets, slices, BLOCK), f"at int, {schema}")
        met = placed.repartitionById(self.buckets * slices, "at").drop("at").sortWithinPartitions(*order)
        met.mapInArrow(_blocks(mean, BLOCK), schema).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path("postings"))

    def merged(self) -> dict:
        """Rewrite the live documents of all generations as one, from the stored terms; no text is read."""
        number, manifest = self.versions.latest()
        old = manifest["generations"]
        gen = max([g["gen"] for g in old], default=0) + 1
        name = f"gen={gen}"
        path = self._emptied(name)
        rows = self._live("forward").drop("gen")
        rows.write.parquet(path("forward"))
        rows = self.spark.read.schema(rows.schema).parquet(path("forward"))
        n, words = (sum(g[c] for g in old) for c in ("n", "words"))
        mean = words / n if n and words else 1.0
        self._write_postings(rows, path, mean, rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        self._write_terms(path)
        entry = {"gen": gen, "name": name, "key": dict(rows.dtypes)["key"], "n": n, "words": words, "gone": 0, "mean": mean}
        self._write_corpus(entry, path)
        self.versions.publish(number + 1, {"settings": manifest["settings"], "generations": [entry]})
        return entry

    # ---- reading ----

    def _read(self, table: str) -> DataFrame:
        """The rows of one table in all generations, with ``gen``."""
        parts = [f"{self.versions.root}/{table}/{g['name']}" for g in self.generations()]
        schema = TABLES[table].format(key=self.generations()[0]["key"])
        return self.spark.read.schema(schema).option("basePath", f"{self.versions.root}/{table}").parquet(*parts)

    def _live(self, table: str) -> DataFrame:
        """The rows of documents that no later generation has replaced or removed."""
        rows, gone = self._read(table), self._gone()
        return rows if gone is None else rows.join(gone, ["key", "gen"], "left_anti")

    def _gone(self) -> DataFrame | None:
        """(key, gen) of documents that don't count any more; ``gen`` is the one they lie in."""
        some = [f"{self.versions.root}/gone/{g['name']}" for g in self.generations() if g["gone"]]
        return self.spark.read.schema(TABLES["gone"].format(key=self.generations()[0]["key"])).parquet(*some) if some else None

    def keys(self) -> DataFrame:
        """The keys of the documents that the index holds."""
        return self._live("forward").select(F.col("key").alias(self.key)).distinct() if self.generations() else self._none().select(self.key)

    def corpus(self) -> tuple[int, float]:
        """Number of documents and their mean length, from the generations' sums."""
        n, words = (sum(g[c] for g in self.generations()) for c in ("n", "words"))
        return n, (words / n if n else 0.0)

    def frequencies(self, terms: Sequence[str]) -> dict[str, int]:
        """Document frequency of each term; only the terms' buckets are read."""
        if not self.generations() or not terms:
            return {t: 0 for t in terms}
        found = self._of("terms", terms).groupBy("term").agg(F.sum("df").alias("df"))
        return {t: 0 for t in terms} | {r.term: r.df for r in found.collect()}  # at most as many rows as terms

    def all_frequencies(self) -> DataFrame:
        """(term, df) of every term."""
        return self._read("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df != 0")

    def _of(self, table: str, terms: Sequence[str]) -> DataFrame:
        wanted = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self._read(table).filter(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms)))

    def query_terms(self, query: str) -> list[str]:
        return [self.stem(w) if self.stem else w for w in plain_terms(query)]

    def blocks(self, least: dict[str, float]) -> DataFrame:
        """Posting blocks of the terms with impacts of at least ``least``; both conditions prune files and row groups."""
        wanted = sorted({zlib.crc32(t.encode()) % self.buckets for t in least})
        some = reduce(lambda a, b: a | b, ((F.col("term") == t) & (F.col("most") >= x) for t, x in sorted(least.items())))
        return self._read("postings").filter(F.col("bucket").isin(wanted) & some)

    def _scored(self, least: dict[str, float], weight: dict[str, float], mean: float) -> DataFrame:
        """(key, score) of the documents that have all terms in the blocks read; smaller is better."""
        terms = sorted(weight)
        each = self.blocks(least).select("gen", "term", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p")).select("gen", "term", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        gone = self._gone()
        if gone is not None:
            each = each.join(gone, ["key", "gen"], "left_anti")
        part = _impact(F.col("tf"), F.col("dl"), mean)
        if len(terms) == 1:
            return each.select(F.col("key").alias(self.key), (-part * weight[terms[0]]).alias("score"))
        parts = each.groupBy("key").agg(*(F.max(F.when(F.col("term") == t, part)).alias(f"p{i}") for i, t in enumerate(terms)))
        score, has = F.lit(0.0), F.lit(True)
        for i, t in enumerate(terms):  # one order of addition, so equal documents have equal scores
            score, has = score - F.col(f"p{i}") * weight[t], has & F.col(f"p{i}").isNotNull()
        return parts.filter(has).select(F.col("key").alias(self.key), score.alias("score"))

    def _weights(self, terms: Sequence[str]) -> tuple[dict[str, float], float] | None:
        """Each term's idf times its number of times in the query, and the mean length; None if a term is nowhere."""
        n, mean = self.corpus()
        df = self.frequencies(sorted(set(terms)))
        if not terms or not all(df.values()):
            return None
        import math

        idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        return {t: (x if x > 0 else IDF_FLOOR) * list(terms).count(t) for t, x in idf.items()}, mean

    def _none(self) -> DataFrame:
        kind = self.generations()[0]["key"] if self.generations() else "long"
        return self.spark.createDataFrame([], f"`{self.key}` {kind}, score double")

    def matches(self, query: str) -> DataFrame:
        """(key, score) of all documents that have every word of the query."""
        found = self._weights(self.query_terms(query)) if self.generations() else None
        return self._none() if found is None else self._scored({t: 0.0 for t in found[0]}, *found)

    def top(self, query: str, k: int, allow: DataFrame | None = None) -> DataFrame:
        """(key, score): the k best of :meth:`matches`, in order, among the keys of ``allow`` if given.

        Blocks are read by falling impact: first a few thousand postings of each term,
        then eight times as many, until k documents are found; then just those blocks
        whose impact, with the greatest of the other terms, can reach the k-th score.
        """
        found = self._weights(self.query_terms(query)) if self.generations() else None
        if found is None or k < 1:
            return self._none()
        weight, mean = found
        among = lambda hits: hits if allow is None else hits.join(allow.select(self.key).distinct(), self.key, "left_semi")
        best = lambda hits: hits.orderBy("score", self.key).limit(k)
        histogram: dict[str, list[tuple[float, int]]] = {t: [] for t in weight}
        step = F.floor(F.col("most") * STEPS).alias("step")
        for r in self.blocks({t: 0.0 for t in weight}).groupBy("term", step).agg(F.sum("n").alias("n")).collect():  # at most STEPS * (K1 + 1) rows a term
            histogram[r.term].append((r.step, r.n))
        size = FIRST
        while True:
            least = {t: _least(rows, size) for t, rows in histogram.items()}
            if not any(least.values()):
                return best(among(self._scored(least, weight, mean)))
            top = best(among(self._scored(least, weight, mean))).agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
            if top.n >= k:
                break
            size *= MORE
        # Impacts of a generation with a smaller mean are at most so much greater now.
        grown = max(1.0, *(mean / g["mean"] for g in self.generations()))
        most = {t: w * grown * (max(s for s, _ in histogram[t]) + 1) / STEPS for t, w in weight.items()}
        reach = {t: (-top.worst - sum(most.values()) + most[t]) / (weight[t] * grown) - 1e-9 for t in weight}
        return best(among(self._scored({t: max(0.0, x) for t, x in reach.items()}, weight, mean)))


def _least(rows: list[tuple[int, int]], size: int) -> float:
    """The impact from which on there are ``size`` postings at least, or 0."""
    seen = 0
    for step, n in sorted(rows, reverse=True):
        seen += n
        if seen >= size:
            return step / STEPS
    return 0.0
