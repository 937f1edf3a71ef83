import os
import re

import pytest

import corpus_pipeline
from corpusloom.llm import queries


def test_stages(spark, docs, text, tmp_path):
    base = text(200, 1)
    near = base.split()
    near[50] = "changed"
    texts = [base, base.replace(" ", "\t ", 3), " ".join(near), text(200, 2), None, "12 34", text(30, 3) + " password=b7db7aa4a5fcc78305 " + text(30, 4)]
    table = docs(texts)
    by = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "secret_scan", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    one = by["language_id"](spark, table, "")
    assert ids(one) == [0, 1, 2, 3, 6] and one.columns == table.columns
    two = by["exact_dedup"](spark, one, "")
    assert ids(two) == [0, 2, 3, 6] and two.columns == table.columns
    three = by["ngram_jaccard_join"](spark, two, "")
    assert ids(three) == [0, 3, 6] and three.columns == table.columns
    four = by["secret_scan"](spark, three, "")
    assert four.columns == table.columns
    masked = {r.doc_id: r for r in four.collect()}
    assert masked[0].text == base and "password=[SECRET] " in masked[6].text and masked[6].n_chars == len(masked[6].text)
    pieces = by["packing"](spark, four, "").collect()
    assert {r.doc_id for r in pieces} == {0, 3, 6}
    table.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == {0, 3, 6} and whole.columns == list(pieces[0].asDict())
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in pieces)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_names():
    want = {"1": "secret", "2": "exact", "3": "quality", "4": "license", "5": "language", "6": "segment", "7": "packing", "8": "toxicity", "9": "suffix", "10": "ngram", "11": "centroid", "12": "conversation", "13": "chat"}
    for name in queries.QUERIES:
        m = re.fullmatch(r"op(\d+)_(\w+)", name)
        assert m and m[2].startswith(want.pop(m[1]))
    assert not want


def test_exact_dedup_oracle(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = con.execute(queries.ORACLE_SQL["op2_exact_dedup"])
    columns = [c[0] for c in got.description]
    df = queries.QUERIES["op2_exact_dedup"](spark, sf)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(got.fetchall())
