"""The vector index against brute force; the trigram index against contains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vectorindex
from corpusloom.operators.trigrams import TrigramIndex, pieces
from corpusloom.operators.vectorindex import VectorIndex


def clustered(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, dims)) * 10
    return heads[rng.integers(0, 12, n)] + rng.normal(size=(n, dims))


def plain(points, keys, q, k):
    d = np.sqrt(((points - q) ** 2).sum(1))
    return [(int(keys[i]), float(d[i])) for i in np.lexsort((keys, d))[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    vectorindex.SLICE = 40
    points = clustered(600, 6)
    points[100:250] = points[100]  # a cell of copies
    keys = np.arange(600) * 7 % 601
    rows = [(int(k), p.tolist()) for k, p in zip(keys, points)]
    df = spark.createDataFrame([*rows, (5000, None), (5001, [1.0]), (5002, [None] * 6)], "vec_id long, embedding array<double>")
    made = VectorIndex(spark, str(tmp_path_factory.mktemp("v")))
    made.build(df, 6, cells=20)
    vectorindex.SLICE = 8192
    return made, points, keys


def test_cells(index):
    made, points, keys = index
    cells = {r.cell: r for r in made.cells().collect()}
    rows = made.vectors().collect()
    assert sorted(r.key for r in rows) == sorted(keys.tolist()) and sum(c.n for c in cells.values()) == 600
    for r in rows:
        away = {c: np.sqrt(((np.array(r.vector) - np.array(x.centre)) ** 2).sum()) for c, x in cells.items()}
        assert away[r.cell] <= min(away.values()) + 1e-6 and away[r.cell] <= cells[r.cell].radius + 1e-9
    assert max(r.slice for r in rows) > 0 and all(r.slice < cells[r.cell].slices for r in rows)


def test_nearest(spark, index):
    made, points, keys = index
    allow = spark.createDataFrame([(int(k),) for k in keys[::9]], "vec_id long")
    for q in (points[0], points[100], np.zeros(6), np.full(6, 100.0)):
        for k in (1, 10, 200, 10_000):
            got = [(r.vec_id, r.distance) for r in made.nearest(q, k).collect()]
            want = plain(points, keys, q, k)
            assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
        got = [r.vec_id for r in made.nearest(q, 5, allow).collect()]
        assert got == [w[0] for w in plain(points[::9], keys[::9], q, 5)]
    assert made.nearest(points[0], 5, allow.limit(0)).collect() == []


def test_far_cells_are_not_read(index):
    made, points, _ = index
    found = made.nearest(points[0], 3)
    found.collect()
    scans = found._jdf.queryExecution().executedPlan().collectLeaves().iterator()
    read = scans.next().metrics().get("numFiles").get().value()
    assert 0 < read < len(made.vectors().inputFiles()) / 2


def test_nearest_each(spark, index):
    made, points, keys = index
    ask = [(f"q{i}", points[i].tolist()) for i in range(0, 600, 60)] + [("far", [50.0] * 6), ("other size", [1.0])]
    df = spark.createDataFrame(ask, "q string, embedding array<double>")
    got = {}
    for r in made.nearest_each(df, 10, "q").collect():
        got.setdefault(r.q, []).append((r["rank"], r.neighbour, r.distance))
    assert set(got) == {a for a, _ in ask} - {"other size"}
    for name, p in ask[:-1]:
        want = plain(points, keys, np.array(p), 10)
        assert [g[1] for g in sorted(got[name])] == [w[0] for w in want] and [g[0] for g in sorted(got[name])] == list(range(1, 11))
        assert np.allclose([g[2] for g in sorted(got[name])], [w[1] for w in want])
    met = {r.q: r.met / r.cells for r in made.cells_met(df, 10, "q").collect()}
    assert max(v for k, v in met.items() if k != "far") < 0.5
    more = made.nearest_each(df, 700, "q").groupBy("q").count().collect()
    assert {r["count"] for r in more} == {600}  # all there are


def test_empty(spark, tmp_path):
    made = VectorIndex(spark, str(tmp_path / "v"))
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    made.build(df, 3)
    assert made.nearest([0.0] * 3, 5).collect() == []
    assert made.nearest_each(spark.createDataFrame([(1, [0.0] * 3)], "q long, embedding array<double>"), 5, "q").collect() == []


TEXTS = ["Hello World", "hello", "", None, "the wörld of ÉTÉ été", "ab", "abc", "xABCx", "a😀b😀c", "hel lo", "x" * 5000 + "end"]


def test_pieces(spark):
    rows = spark.createDataFrame([("abcab",), ("ab",), (None,), ("A😀bC",)], "t string").select(pieces(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["abc", "bca", "cab"], [], [], ["a😀b", "😀bc"]]


def test_trigram_index(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = TrigramIndex(spark, str(tmp_path / "t"), buckets=8)
    index.opened()
    assert index.containing(docs, "abc").collect() == []
    index.update(docs)
    for part in ("abc", "ABC", "lo wo", "ello", "été", "😀b😀", "xxx", "xend", "zzz", "hel", "ab", "", "worlds"):
        want = [i for i, t in enumerate(TEXTS) if len(part) >= 3 and t is not None and part.lower() in t.lower()]
        assert sorted(r.doc_id for r in index.containing(docs, part).collect()) == want, part
    index.update(spark.createDataFrame([(0, "nothing")], docs.schema), spark.createDataFrame([(1,)], "doc_id long"))
    now = docs.filter("doc_id NOT IN (0, 1)").unionByName(spark.createDataFrame([(0, "nothing")], docs.schema))
    assert [r.doc_id for r in index.containing(now, "hello").collect()] == [] and [r.doc_id for r in index.containing(now, "NOTH").collect()] == [0]
