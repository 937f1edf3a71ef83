from pyspark.sql import functions as F

from corpusloom.functions import documents as D


def one(spark, column, s):
    return spark.createDataFrame([(s,)], "s string").select(column.alias("x")).first().x


def test_book_body(spark):
    raw = "Header\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nOne **two**.\n\n\n\nA Project Gutenberg line\nThree.\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nLicense"
    assert one(spark, D.book_body(F.col("s")), raw) == "One two.\n\nThree."
    assert one(spark, D.book_body(F.col("s")), "no banner") == "no banner"


def test_filing_body(spark):
    raw = "<SEC-HEADER>x</SEC-HEADER><DOCUMENT>\n<TYPE>EX-1\n<TEXT>exhibit</TEXT></DOCUMENT><DOCUMENT>\n<TYPE>10-K\n<TEXT><html><style>s</style><div style='display:none'>hid</div><p>Main&amp;text</p></html></TEXT></DOCUMENT>"
    assert one(spark, D.filing_body(F.col("s"), F.lit("10-K")), raw) == "Main&text"
    assert one(spark, D.filing_body(F.col("s"), F.lit("8-K")), raw) == "exhibit"


def test_sectioned(spark):
    assert one(spark, D.sectioned({"Abstract": F.col("s"), "Action": F.lit(" "), "Notes": F.lit("n")}), "a") == "## Abstract\n\na\n\n## Notes\n\nn"


def test_profile(spark):
    raw = '{"Economy": {"GDP": {"text": "1", "note": "est"}}, "Introduction": {"Background": {"text": "old"}}, "Zed": ["a", {"k": 2}]}'
    want = "## Introduction\n\nBackground: old\n\n## Economy\n\nGDP: 1\nGDP > note: est\n\n## Zed\n\n[0]: a\n[1] > k: 2"
    assert one(spark, D.profile_to_markdown("s"), raw) == want
    assert one(spark, D.profile_to_markdown("s"), "broken") is None
    assert one(spark, D.unwrap_json("s"), '{"a": {"text": 1}, "b": {"text": 2, "c": 3}}') == '{"a": 1, "b": {"value": 2, "c": 3}}'


def test_underlined(spark):
    raw = "Title\n*****\n\nPart\n====\n\nA **bold** and *it*.\n* item\nSmall\n-----\nend\n=========="
    cases = {1: raw, 2: "Top\n***", 3: None, 4: "abc\n===\n===\n===\nx", 5: "a * b * c ** d\n  Wide  \n~~~~~~~\n", 6: "ab\n==\n\n===\nabcd\n==="}
    df = spark.createDataFrame(list(cases.items()), "k int, t string")
    got = {r.k: r.markdown for r in D.underlined_markdown(df, "k", "t").collect()}
    assert got == {1: "## Part\n\nA bold and it.\n* item\n### Small\nend\n==========", 2: "", 3: "", 4: "## abc\n## ===\nx", 5: "a * b * c ** d\n#### Wide", 6: "ab\n==\n\n===\nabcd\n==="}
