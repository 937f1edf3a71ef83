"""Python functions hold a bounded number of values at a time, and written fixtures are files of a bounded size."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import arrow, chunking, markup, vector
from corpusloom.plans import functions


def test_runs():
    assert list(arrow.runs(0)) == [] and list(arrow.runs(300)) == [(0, 128), (128, 128), (256, 44)]
    assert list(arrow.runs(4, 2)) == [(0, 2), (2, 2)]


def test_texts_of_a_batch_are_no_objects_together(spark):
    """Chunks leave in batches of few documents, where one batch came in; before, all of a batch's chunks left at once."""
    sizes = lambda parts: (pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"]) for b in parts)
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    cut = chunking.chunks(docs)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and sum(r.n for r in cut.mapInArrow(sizes, "n long").collect()) == 1000
    got = docs.select("doc_id", markup.html_to_text(F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("<b>"), "text"))).alias("x")).collect()
    assert [r.x for r in got] == [None if i % 7 == 0 else f"text {i}" for i in range(1000)]
    assert [r.x for r in spark.createDataFrame([(b"\xef\xbb\xbfa",), (b"\xe9",), (None,)], "b binary").select(markup.decode_text("b").alias("x")).collect()] == ["a", "é", None]


def test_xml_files_have_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(functions, "RECORDS", 10)
    rows = spark.range(0, 95, 1, 2)
    path = functions._lines(rows, "harvest", F.concat(F.lit("<record>"), "id", F.lit("</record>")), root="r")
    files = spark.read.text(path, wholetext=True).collect()
    assert len(files) == 10 and all(f.value.startswith("<r>") and f.value.rstrip().endswith("</r>") and f.value.count("<record>") <= 10 for f in files)
    assert sum(f.value.count("<record>") for f in files) == 95


def test_few_bytes_are_spread_over_cores(spark, tmp_path):
    """One small file is one partition; before, Python's work on it was one task."""
    spark.range(500).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1
    dealt = arrow.spread(one)
    assert dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and dealt.count() == 500


def test_embedding_computes_its_tokens_once(spark):
    """Before, the expression of the tokens stood in the plan, and was computed, for each place and each norm."""
    made = vector.hashed_embedding(F.split("t", " "), 8)
    df = spark.createDataFrame([("a b c a",), ("",), (None,)], "t string").select(made.alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    a, b, c = (r.v for r in df.collect())
    assert abs(sum(x * x for x in a) - 1) < 1e-6 and len(b) == 8 and c == [0.0] * 8
