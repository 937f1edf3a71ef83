"""Replay, line numbers, global numbers and deep pages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import listing, merge
from corpusloom.sources import lines, replay


@pytest.fixture(scope="module")
def cache(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cache")
    for i in range(7):
        (folder / f"{hashlib.sha1(str(i).encode()).hexdigest()}.json").write_text(f'{{"page": {i}}}')
    (folder / "_tmp").write_text("x")
    return folder


def test_replay_goes_on_after_any_answer(spark, cache):
    names = sorted(p.name for p in cache.iterdir() if p.name != "_tmp")
    every = [tuple(r) for r in replay.answers(spark, str(cache)).collect()]
    assert [r[0] for r in every] == names and all(r[1] == r[0].split(".")[0] for r in every)
    assert {r[2] for r in every} == {f'{{"page": {i}}}' for i in range(7)}
    for i, name in enumerate(names):
        assert [tuple(r) for r in replay.answers(spark, str(cache), after=name).collect()] == every[i + 1 :]
    assert [r.name for r in replay.answers(spark, f"file://{cache}", after=names[1], until=names[3]).collect()] == names[2:4]


def test_replay_stream(spark, cache, tmp_path, monkeypatch):
    names = sorted(p.name for p in cache.iterdir() if p.name != "_tmp")
    out = str(tmp_path / "out")

    def run(until):
        stream = replay.answers(spark, str(cache), stream=True, until=until)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for until in (names[0], names[3], names[3], names[-1]):
        run(until)
        got = sorted(r.name for r in spark.read.parquet(out).collect())
        assert got == [n for n in names if n <= until]


@pytest.fixture()
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_lines_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(3)
    texts = {}
    for name, n in (("a.jsonl", 120), ("b.jsonl", 1), ("c.jsonl", 77), ("empty.jsonl", 0)):
        rows = [rng.choice(['{"k": %d}' % i, '{"k": %d, "v": "%s"}' % (i, "x" * rng.randrange(60)), "oops", "", '{"k": ']) for i in range(n)]
        texts[name] = rows
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    numbered = lines.numbered_lines(spark, str(tmp_path))
    got = {}
    for r in numbered.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
    assert got == {n: dict(enumerate(rows, 1)) for n, rows in texts.items() if rows}
    assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 2
    good = lambda r: r.startswith("{") and r.endswith("}")
    for done in (0, 1, 50, 119, 120, 500):
        rest = lines.json_lines_after(spark, str(tmp_path / "a.jsonl"), "k long, v string", done)
        want = [(i, None if not good(r) else int(r.split(": ")[1].split(",")[0].rstrip("}")), not good(r)) for i, r in enumerate(texts["a.jsonl"], 1) if i > done and r]
        assert sorted((r.line, r.record.k if r.record else None, r.bad) for r in rest.collect()) == want
    both = lines.json_lines_after(spark, str(tmp_path), "k long, v string", {"a.jsonl": 100, "c.jsonl": 77})
    told = {r.file.rsplit("/", 1)[1]: (r.records, r.bad) for r in lines.progress(both).collect()}
    count = lambda rows: (sum(map(good, rows)), sum(bool(r) and not good(r) for r in rows))
    assert told == {n: c for n, c in {"a.jsonl": count(texts["a.jsonl"][100:]), "b.jsonl": count(texts["b.jsonl"])}.items() if c != (0, 0)}


def test_lines_of_a_compressed_file(spark, tmp_path):
    import gzip

    (tmp_path / "z.json.gz").write_bytes(gzip.compress(b'{"k": 1}\n{"k": 2}\nbad\n{"k": 4}\n'))
    rest = lines.json_lines_after(spark, str(tmp_path), "k long", 1)
    assert sorted((r.line, r.bad, r.record and r.record.k) for r in rest.collect()) == [(2, False, 2), (3, True, None), (4, False, 4)]


def test_numbers_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    numbered = merge.number_all(df, [F.desc("a"), "b"])
    got = sorted((r.id, r.a, r.b) for r in numbered.collect())
    assert got == [(i, a, b) for i, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)]
    assert sorted(numbered.collect()) == sorted(numbered.collect())
    assert "Window" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert merge.number_all(df.limit(0), ["a"]).count() == 0
    assert [r.id for r in merge.number_all(df.filter("a = 3").limit(3), ["b"], start=10).orderBy("id").collect()] == [10, 11, 12]


@pytest.mark.parametrize("order", [[("d", True), ("k", True)], [("d", False), ("k", True)], [("s", False), ("d", True), ("k", False)]])
def test_deep_pages(spark, monkeypatch, order):
    monkeypatch.setattr(listing, "RANGE_ROWS", 60)
    monkeypatch.setattr(listing, "CUTS", 8)
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1.5, 2.5] if i % 3 else [rng.random()]), rng.choice([None, "a", "b"])) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, d double, s string")
    keys = [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in order]
    every = [r.k for r in df.orderBy(*keys).collect()]
    for offset in (0, 1, 59, 450, 451, 899, 900, 5000):
        got = listing.deep_page(df, order, 20, offset)
        assert [r.k for r in got.collect()] == every[offset : offset + 20], offset
        assert all(r.total == 900 for r in got.collect())
    plan = listing.deep_page(df, order, 20, 450)
    assert plan.drop("total").count() == 20


def test_deep_page_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(listing, "RANGE_ROWS", 10)
    df = spark.range(100).select(F.lit(1).alias("k"))
    assert listing.deep_page(df, [("k", True)], 5, 50).count() == 5 and listing.deep_page(df.limit(0), [("k", True)], 5, 0).count() == 0
