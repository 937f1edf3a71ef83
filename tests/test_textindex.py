"""The stored text index against recounts, scans and plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search, textindex
from corpusloom.operators.textindex import TextIndex

WORDS = "river bridge stone boat song rain harvest road market lantern the of and".split()


def texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 60, 50, 40], k=rng.randrange(1, 60))) for _ in range(n)]


def plain(docs, query, k=None):
    """(key, score) of documents with all of the query's words."""
    terms = query.lower().split()
    cut = {d: t.split() for d, t in docs.items()}
    n, mean = len(cut), sum(map(len, cut.values())) / max(1, len(cut))
    df = {t: sum(t in w for w in cut.values()) for t in terms}
    out = []
    for d, w in cut.items():
        if all(t in w for t in terms):
            score = 0.0
            for t in sorted(set(terms)):
                idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                tf = w.count(t)
                score -= (idf if idf > 0 else 1e-6) * terms.count(t) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            out.append((d, score))
    return sorted(out, key=lambda r: (r[1], r[0]))[:k]


def table(spark, docs):
    return spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string")


def check(index, docs, queries=("bridge", "the of", "river stone", "the", "of the the")):
    n, mean = index.corpus()
    assert n == len(docs) and mean == pytest.approx(sum(len(t.split()) for t in docs.values()) / max(1, len(docs)))
    counted = {}
    for t in docs.values():
        for w in set(t.split()):
            counted[w] = counted.get(w, 0) + 1
    assert {r.term: r.df for r in index.all_frequencies().collect()} == counted
    for q in queries:
        want = plain(docs, q)
        got = sorted(map(tuple, index.matches(q).collect()), key=lambda r: r[0])
        assert [g[0] for g in got] == sorted(d for d, _ in want)
        assert dict(got) == pytest.approx(dict(want))
        top = [tuple(r) for r in index.top(q, 5).collect()]
        assert [t[1] for t in top] == pytest.approx([s for _, s in want[:5]])
        assert all(dict(want)[d] == pytest.approx(s) for d, s in top)


@pytest.fixture(scope="module")
def small():
    old = textindex.BLOCK, textindex.FIRST
    textindex.BLOCK, textindex.FIRST = 8, 16
    yield
    textindex.BLOCK, textindex.FIRST = old


def test_updates_equal_a_recount(spark, tmp_path, small):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.opened() is None and index.why_rebuild() is None
    docs = dict(enumerate(texts(300))) | {900: "", 901: "the"}
    index.update(table(spark, docs))
    check(index, docs)
    changed = {i: t for i, t in zip(range(0, 60), texts(60, 1))} | {i: t for i, t in zip(range(1000, 1040), texts(40, 2))}
    gone = [100, 101, 900, 5000]
    index.update(table(spark, changed), spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    docs = {d: t for d, t in (docs | changed).items() if d not in gone}
    check(index, docs)
    index.update(table(spark, docs).limit(0), spark.createDataFrame([(200,)], "doc_id long"))  # a removal alone
    del docs[200]
    check(index, docs, ["the of"])
    index.update(table(spark, {3: "lantern " * 40, 1000: docs[1000]}))  # changed again; written again as it was
    docs[3] = "lantern " * 40
    check(index, docs, ["lantern", "the lantern"])
    before = index.generations()
    index.merged()
    assert len(before) == 4 and len(index.generations()) == 1
    check(index, docs, ["lantern", "the of"])
    index.clean()
    assert index.versions.names("postings") == [index.generations()[0]["name"]]
    check(index, docs, ["the of"])


def test_scope_and_none(spark, tmp_path, small):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.opened()
    assert index.top("the", 3).collect() == [] and index.matches("the").collect() == []
    docs = dict(enumerate(texts(200, 5)))
    index.update(table(spark, docs))
    allow = spark.createDataFrame([(d,) for d in (3, 3, 50, 77, 150)], "doc_id long")
    want = [r for r in plain(docs, "the") if r[0] in (3, 50, 77, 150)]
    assert [r.doc_id for r in index.top("the", 10, allow).collect()] == [d for d, _ in want]
    assert index.top("the", 10, allow.limit(0)).collect() == []
    assert index.top('"" --', 10).collect() == [] and index.top("nowhere", 10).collect() == [] and index.top("the nowhere", 10).collect() == []


def leaves(df):
    """Numbers of files and bytes that a plan's scans read."""
    df.collect()
    found, plan = [], df._jdf.queryExecution().executedPlan()
    each = plan.collectLeaves().iterator()
    while each.hasNext():
        m = each.next().metrics()
        found.append((m.get("numFiles").get().value(), m.get("filesSize").get().value(), m.get("numOutputRows").get().value()))
    return found


def test_a_search_reads_its_terms_alone(spark, tmp_path, small):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=16)
    index.opened()
    index.update(table(spark, dict(enumerate(texts(2000, 7)))))
    files = index.spark.read.parquet(str(tmp_path / "i" / "postings")).inputFiles()
    [(n, size, _)] = leaves(index.blocks({"bridge": 0.0}))
    assert n <= 2 and n < len(files) / 4 and size > 0  # the term's bucket, which a range bound may cut once
    [(_, _, every)] = leaves(index.blocks({"the": 0.0}))
    [(_, _, some)] = leaves(index.blocks({"the": 1.9}))
    assert some <= every
    # Of the blocks that are read, those that can't reach the k-th score are left out.
    reads = []
    scored = TextIndex._scored
    try:
        TextIndex._scored = lambda self, least, *a: reads.append(self.blocks(least).count()) or scored(self, least, *a)
        index.top("the", 3).collect()
    finally:
        TextIndex._scored = scored
    assert reads[-1] < index.blocks({"the": 0.0}).count() / 10


def test_rebuild_reasons(spark, tmp_path):
    make = lambda **s: TextIndex(spark, str(tmp_path / "i"), buckets=4, settings={"model": "m1", "dimension": "64", "prefix": "doc: ", **s})
    index = make()
    assert index.why_rebuild() is None and index.opened() is None  # there is none yet
    index.update(table(spark, {1: "the river"}))
    assert make().opened() is None and make().corpus()[0] == 1
    for name, value in (("model", "m2"), ("dimension", "128"), ("prefix", "")):
        other = make(**{name: value})
        assert other.why_rebuild() == name
    assert make(model="m2").opened() == "model" and make(model="m2").corpus() == (0, 0.0)
    index = make(model="m2")
    index.update(table(spark, {1: "the river", 2: "of"}))
    index.versions.delete("terms")
    assert make(model="m2").why_rebuild() == "tables" and make(model="m2").opened() == "tables" and make(model="m2").generations() == []
    index = make(model="m2")
    index.update(table(spark, {7: "song"}))
    index.reset()  # asked for
    assert index.generations() == [] and index.why_rebuild() is None


def test_a_stopped_update_leaves_the_version_before(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.opened()
    index.update(table(spark, {1: "the river", 2: "of"}))
    monkeypatch.setattr(TextIndex, "_write_postings", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.update(table(spark, {1: "stone", 3: "road"}))
    monkeypatch.undo()
    check(index, {1: "the river", 2: "of"}, ["river"])
    index.update(table(spark, {1: "stone", 3: "road"}))
    check(index, {1: "stone", 2: "of", 3: "road"}, ["stone", "road"])


def test_two_writers(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    index.opened()
    with pytest.raises(FileExistsError):
        index.versions.publish(1, {})


def test_lists_are_shuffled_not_postings(spark):
    """A term's postings of a task are one row, or full blocks; before, each posting was a row of the shuffle."""
    docs = texts(400, 3)
    batch = pa.RecordBatch.from_pydict({"key": list(range(400)), "words": [t.split() for t in docs]})
    rows = list(textindex._counts(pa.int64())(iter([batch])))
    postings = sum(len(set(t.split())) for t in docs)
    assert sum(b.column("n").to_numpy().sum() for b in rows) == postings
    (out,) = textindex._inverted(30.0, 4, 3, 64)(iter(rows))
    assert len(out) <= len(WORDS) + postings / 64 and sum(out.column("n").to_pylist()) == postings
    assert {a // 3 for a in out.column("at").to_pylist()} <= set(out.column("bucket").to_pylist())
    the = [r for r in out.to_pylist() if r["term"] == "the"]
    assert len({r["at"] for r in the}) == 3  # a frequent term's full blocks are dealt over its bucket's slices
    assert [r["most"] for r in the] == sorted((r["most"] for r in the), reverse=True)
    # Merged in one task: whole again, cut to blocks, by falling impact.
    merged = [r for b in textindex._blocks(30.0, 64)(iter([pa.RecordBatch.from_pylist(the[:2]).drop_columns("at"), pa.RecordBatch.from_pylist(the[2:]).drop_columns("at")])) for r in b.to_pylist()]
    assert sorted(k for r in merged for k in r["keys"]) == [i for i, t in enumerate(docs) if "the" in t.split()] and [r["n"] for r in merged[:-1]] == [64] * (len(merged) - 1)


def test_pieces_are_bounded():
    got = [(s.start, s.stop) for s in textindex._pieces(np.array([3, 0, 9, 1, 1, 5]), 4)]
    assert got == [(0, 2), (2, 3), (3, 5), (5, 6)] and list(textindex._pieces(np.array([], int))) == []


def test_many_slices_equal_a_recount(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(textindex, "SLICE", 200)
    index = TextIndex(spark, str(tmp_path / "i"), buckets=2)
    index.opened()
    docs = dict(enumerate(texts(300, 11)))
    index.update(table(spark, docs))
    changed = dict(zip(range(50, 90), texts(40, 12)))
    index.update(table(spark, changed), spark.createDataFrame([(3,)], "doc_id long"))
    check(index, {d: t for d, t in (docs | changed).items() if d != 3}, ["the of", "lantern"])
