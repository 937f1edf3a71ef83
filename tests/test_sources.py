import gzip

from pyspark.sql import functions as F

from corpusloom.sources import catalog, readers
from corpusloom.streaming import incremental


def put(path, text, zipped=False):
    (gzip.open(path, "wt", encoding="utf-8") if zipped else open(path, "w", encoding="utf-8")).write(text)
    return str(path)


def test_delimited(spark, tmp_path):
    df = readers.delimited(spark, put(tmp_path / "a.csv", 'Case Name,2nd-Col\n"A, b",1\nshort\n'))
    assert df.columns == ["case_name", "c_2nd_col"] and ("A, b", "1") in map(tuple, df.collect())


def test_places(spark, tmp_path):
    line = "1\tX\tX\t\t1.5\t2.5\tP\tPPL\tCL\t\t\t\t\t\t100\t-9999\t7\tAmerica/Santiago\t2020-01-01\n"
    rows = readers.places(spark, put(tmp_path / "p.txt", line + line.replace("1.5", "north"))).collect()
    assert len(rows) == 1 and rows[0].elevation is None and rows[0].dem == 7 and rows[0].population == 100


def test_stations_and_observations(spark, tmp_path):
    line = "ACW00011604  17.1167  -61.7833   10.1    ST JOHNS COOLIDGE FLD                       \n"
    rows = readers.stations(spark, put(tmp_path / "s.txt", line + line.replace(" 17.1167", "    none") + "short\n")).collect()
    assert [(r.station_id, r.latitude, r.country_code) for r in rows] == [("ACW00011604", 17.1167, "AC"), ("ACW00011604", None, "AC")]
    obs = readers.observations(spark, put(tmp_path / "o.csv.gz", "A,20200101,TMAX,251,,,S,\nA,20200101,SNOW,3,,,S,\nA,20200101,WT01,1,,,S,\nA,20200101,PRCP,x,,,S,\n", True))
    assert sorted((r.element, r.value) for r in obs.collect()) == [("SNOW", 3.0), ("TMAX", 25.1)]


def test_filing_index(spark, tmp_path):
    text = "Company Name   Form Type   CIK  Date Filed  File Name\n-------\nACME CORP   10-K   1234   2024-01-05   edgar/data/1234/0001-24-000001.txt\nOTHER LTD   4   77   2024-01-05   edgar/data/77/x.txt\n"
    rows = readers.filing_index(spark, put(tmp_path / "c.idx", text)).collect()
    assert [(r.company_name, r.form_type, r.cik, r.accession_number) for r in rows] == [("ACME CORP", "10-K", "1234", "0001-24-000001")]


def test_json_lines(spark, tmp_path):
    df = readers.json_lines(spark, put(tmp_path / "a.jsonl", '{"code": "1", "tags": ["a", "b"], "n": {"x": 1}}\nnot json\n{"code": "2"}\n'), "code string, tags array<string>, n struct<x: int>")
    rows = sorted(map(tuple, readers.flat_strings(df).collect()))
    assert rows == [("1", "a, b", '{"x":1}'), ("2", "", "")]


def test_xml(spark, tmp_path):
    wiki = """<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><id>5</id><timestamp>t</timestamp><text bytes="3">abc</text></revision></page>
<page><title>B</title><ns>0</ns><id>2</id><revision><id>6</id><timestamp>t</timestamp><text bytes="3">#REDIRECT [[A]]</text></revision></page>
<page><title>Talk:A</title><ns>1</ns><id>3</id><revision><id>7</id><timestamp>t</timestamp><text bytes="1">x</text></revision></page></mediawiki>"""
    rows = readers.wiki_pages(spark, put(tmp_path / "w.xml", wiki)).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.is_redirect, r.target) for r in rows] == [(1, "abc", False, None), (2, "#REDIRECT [[A]]", True, "A")]
    posts = '<posts>\n<row Id="1" PostTypeId="1" Title="T" Body="&lt;p&gt;hi&lt;/p&gt;" Score="3" />\n<row Id="2" PostTypeId="2" ParentId="1" Body="b" Score="0" />\n</posts>'
    rows = readers.forum_posts(spark, put(tmp_path / "p.xml", posts), "s").orderBy("post_id").collect()
    assert [(r.post_id, r.title, r.body, r.parent_id) for r in rows] == [(1, "T", "hi", None), (2, None, "b", 1)]


def test_harvest(spark, tmp_path):
    def record(i, abstract="An abstract.", status=""):
        return f"""<record><header{status}><identifier>oai:{i}</identifier><datestamp>2024-01-22</datestamp></header><metadata><arXiv><id>{i}</id><created>2024-01-22</created>
<authors><author><keyname>Smith</keyname><forenames>Alice</forenames></author><author></author></authors><title>A  T</title><categories>cs.CL cs.LG</categories><abstract>{abstract}</abstract></arXiv></metadata></record>"""

    text = f"<OAI-PMH><ListRecords>{record('1')}{record('2', '')}{record('3', status=' status=\"deleted\"')}</ListRecords></OAI-PMH>"
    rows = readers.harvested_papers(spark, put(tmp_path / "o.xml", text)).collect()
    assert [(r.id, r.title, r.primary_category) for r in rows] == [("1", "A T", "cs.CL")]
    assert [a.display_name for a in rows[0].authors] == ["Alice Smith"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhi")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    assert sorted(r.text for r in readers.text_files(spark, str(tmp_path), "*.txt").collect()) == ["café", "hi"]


def test_links(spark):
    df = spark.createDataFrame([("x [a](https://github.com/o/r) https://github.com/topics/ml", "l1", 1), ("https://github.com/o/r.git https://github.com/p/q)", "l2", 2)], "t string, s string, o long")
    assert sorted(map(tuple, readers.repository_links(df, "t", "s", "o").collect())) == [("o/r", "l1"), ("p/q", "l2")]


def test_catalog(spark):
    df = catalog.sources(spark)
    assert df.count() == df.select("id").distinct().count()
    assert catalog.markdown_block(df).first().block.startswith("- **arXiv papers** (`arxiv`)")


def test_ingest(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n long").write.mode("append").parquet(source)
    run = lambda: incremental.ingest(spark, source, "k long, v string, n long", target, checkpoint, ["k"], "n")
    run()
    run()  # nothing new
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k long, v string, n long").write.mode("append").parquet(source)
    run()
    assert sorted((r.k, r.v) for r in incremental.current(spark, target).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(50).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7200).alias("ts"), (F.col("id") % 2).cast("string").alias("kind"), F.col("id").cast("double").alias("value"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = incremental.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "kind", "value")
    got = incremental.run_available(stream, "counts", "complete")
    want = incremental.windowed_counts(df, "ts", "kind", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quarters(spark):
    df = spark.createDataFrame([(1, "2023-05-01", "2024-04-02", "2023-09-30"), (2, "2024-01-01", "2024-01-01", None), (3, "2024-01-01", "2024-02-01", "2024-03-31"), (4, None, "2024-01-01", None)], "k int, a string, b string, d string")
    dates = df.select("k", *(F.col(c).cast("date").alias(c) for c in "abd"))
    got = incremental.quarters_after(dates, "a", "b", "d").orderBy("k", "year", "quarter").select("k", "year", "quarter").collect()
    assert [tuple(r) for r in got] == [(1, 2023, 4), (1, 2024, 1), (1, 2024, 2), (2, 2024, 1)]
