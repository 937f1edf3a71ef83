"""Merges that touch buckets, versions that are whole, watermarks that go with the rows."""

import datetime

import pytest

from corpusloom.operators.merge import upsert
from corpusloom.sources.keyed import KeyedTable
from corpusloom.streaming import incremental

SCHEMA = "k long, v string, n long"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def put(table, spark, rows, state=None):
    return table.merge(spark.createDataFrame(rows, SCHEMA), lambda old, new: upsert(old, new, ["k"], "n"), state)


def files(table, version=None):
    return {b: sorted(table.versions.names(f)) for b, f in table.folders(version).items()}


def test_untouched_files_stay(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    assert table.read() is None and table.number == 0
    put(table, spark, [(k, "a", 1) for k in range(200)], {"at": 1})
    before = dict(table.folders())
    touched = put(table, spark, [(3, "b", 2), (3, "c", 3), (1000, "d", 1)])
    after = table.folders()
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    want = [(k, "c" if k == 3 else "a", 3 if k == 3 else 1) for k in range(200)] + [(1000, "d", 1)]
    assert rows_of(table.read()) == want and table.state == {"at": 1}
    assert rows_of(table.read(version=1)) == [(k, "a", 1) for k in range(200)]  # the version before
    assert rows_of(table.lookup(spark.createDataFrame([(3,), (7,), (5000,)], "k long"))) == [(3, "c", 3), (7, "a", 1)]
    table.merge(spark.createDataFrame([(3, None, 0)], SCHEMA), lambda old, new: old.join(new.select("k"), "k", "left_anti"))  # rows may go
    assert rows_of(table.read()) == [r for r in want if r[0] != 3]
    reopened = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)  # the number is the table's own
    assert reopened.buckets == 16 and put(reopened, spark, []) == [] and reopened.number == 3
    table.clean(keep=1)
    assert rows_of(table.read()) == [r for r in want if r[0] != 3] and table.versions.numbers() == [3]


def test_a_stopped_merge_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    put(table, spark, [(1, "a", 1), (2, "a", 1)])
    monkeypatch.setattr(type(table.versions), "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        put(table, spark, [(1, "b", 2)])
    monkeypatch.undo()
    assert rows_of(table.read()) == [(1, "a", 1), (2, "a", 1)] and table.number == 1
    put(table, spark, [(1, "b", 2)])
    table.clean(keep=1)
    assert rows_of(table.read()) == [(1, "b", 2), (2, "a", 1)]
    held = {f.split("/")[1] for f in table.folders().values()}
    assert set(table.versions.names("data")) == held  # what the stopped merge wrote is gone


def test_new_columns_and_empty_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    put(table, spark, [(k, "a", 1) for k in range(10)])
    more = spark.createDataFrame([(1, "b", 2, 9.5)], f"{SCHEMA}, x double")
    table.merge(more, lambda old, new: upsert(old, new, ["k"], "n"))
    assert [r.x for r in table.read().orderBy("k").collect()] == [None, 9.5] + [None] * 8
    table.merge(table.read(), lambda old, new: old.limit(0))
    assert table.read().count() == 0 and table.folders() == {}


def ingest(spark, tmp, **options):
    incremental.ingest(spark, f"{tmp}/in", "k long, v string, n long, d string", f"{tmp}/out", f"{tmp}/check", ["k"], "n", buckets=4, **options)


def arrive(spark, tmp, rows):
    spark.createDataFrame(rows, "k long, v string, n long, d string").coalesce(1).write.mode("append").parquet(f"{tmp}/in")


def test_crash_between_data_and_state(spark, tmp_path, monkeypatch):
    mark = incremental.date_mark("d")
    arrive(spark, tmp_path, [(1, "a", 1, "2024-01-05"), (2, "a", 1, "2024-01-03")])
    ingest(spark, tmp_path, mark=mark)
    assert incremental.state_of(spark, f"{tmp_path}/out") == {"batch": 0, "mark": {"date": "2024-01-05"}}
    arrive(spark, tmp_path, [(2, "b", 2, "2024-02-01")])
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "clean", lambda *a, **k: 1 / 0)  # published, then the batch fails before its commit
        with pytest.raises(Exception, match="ZeroDivision|division"):
            ingest(spark, tmp_path, mark=mark)
    number = KeyedTable(spark, f"{tmp_path}/out", ["k"]).number
    ingest(spark, tmp_path, mark=lambda *a: 1 / 0)  # sent again: nothing is merged or marked
    assert KeyedTable(spark, f"{tmp_path}/out", ["k"]).number == number
    assert incremental.state_of(spark, f"{tmp_path}/out") == {"batch": 1, "mark": {"date": "2024-02-01"}}
    assert [tuple(r)[:2] for r in incremental.current(spark, f"{tmp_path}/out").orderBy("k").collect()] == [(1, "a"), (2, "b")]
    arrive(spark, tmp_path, [(3, "c", 1, "2023-12-31")])
    with monkeypatch.context() as m:
        m.setattr("corpusloom.sources.versions.Versions.publish", lambda *a: 1 / 0)  # written, not published
        with pytest.raises(Exception, match="ZeroDivision|division"):
            ingest(spark, tmp_path, mark=mark)
    assert incremental.current(spark, f"{tmp_path}/out").count() == 2 and incremental.state_of(spark, f"{tmp_path}/out")["batch"] == 1
    ingest(spark, tmp_path, mark=mark)
    assert incremental.current(spark, f"{tmp_path}/out").count() == 3
    assert incremental.state_of(spark, f"{tmp_path}/out") == {"batch": 2, "mark": {"date": "2024-02-01"}}  # it doesn't go back


def test_marks(spark):
    batch = spark.createDataFrame([("2024-05-10",), (None,)], "d string")
    none = batch.filter("d > '3'")
    assert incremental.date_mark("d")({"date": "2024-06-01"}, batch) == {"date": "2024-06-01"}
    assert incremental.date_mark("d")({}, batch) == {"date": "2024-05-10"} and incremental.date_mark("d")({}, none) == {"date": None}
    assert incremental.date_mark("d", replay=True)({"date": "2020-01-01"}, batch) == {"date": "2020-01-01"}
    day = datetime.date
    at = lambda today, old, rows=batch: incremental.quarter_mark("d", today)(old, rows)
    assert at(day(2024, 9, 1), {}) == {"year": 2024, "quarter": 2}
    assert at(day(2024, 5, 20), {}) == {"year": 2024, "quarter": 1}  # its own quarter isn't over
    assert at(day(2024, 2, 1), {"year": 2023, "quarter": 2}) == {"year": 2023, "quarter": 4}
    assert at(day(2024, 2, 1), {"year": 2030, "quarter": 1}, none) == {"year": 2023, "quarter": 4}  # a mark from the future
    assert at(day(2024, 2, 1), {"year": 2023, "quarter": 1}, none) == {"year": 2023, "quarter": 1} and at(day(2024, 2, 1), {}, none) == {}
