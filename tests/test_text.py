import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import chunking, markup
from corpusloom.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a\n  b", "a\nb"), ("a\r\nb\rc", "a\nb\nc"), ("  a \t b  ", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("", ""), (" a ", "a")],
)
def test_normalize_whitespace(spark, raw, want):
    assert one(spark, T.normalize_whitespace(F.col("s")), s=raw) == want
    assert one(spark, T.normalize_whitespace(F.col("s")), s=want) == want


def test_strip_markdown(spark):
    raw = "# Head\n> quoted\n**bold** and *it* and `code` [link](u) ![pic](v)\n---\n```x\ny```"
    assert one(spark, T.strip_markdown(F.col("s")), s=raw) == "Head\nquoted\nbold and it and code link pic\n"


def test_strip_markdown_marks_in_marks(spark):
    cases = {
        "a ```x\n`y` b``` c": "a   c", "a ```open": "a ```open", "```a``````b``` c": "   c", "[![alt](i.png)](u) x": "alt x", "`[a](b)` [`c`](d)": "a c",
        "**_a_** __*b*__ ***c***": "a b c", "snake_case_name and 2*3*4": "snakecasename and 234", "** a **": " a ", "a * b\n* c": "a * b\n* c", "#x\n## y\n###### z": "#x\ny\nz",
        "> q\n>r\n> # s": "q\nr\n# s", "---\n***\nx---": "\n\nx---", "": "", "**" + "x" * 100_000 + "**": "x" * 100_000,
    }
    for raw, want in cases.items():
        assert one(spark, T.strip_markdown(F.col("s")), s=raw) == want, raw[:40]


def test_hashes(spark):
    assert one(spark, T.content_hash(F.col("a"), F.col("b")), a="x", b=None) == hashlib.sha256(b"x\0\0").hexdigest()[:32]
    assert one(spark, T.plain_hash(F.col("a")), a="x") == hashlib.sha256(b"x").hexdigest()[:32]
    pairs = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, T.cache_key(pairs), a="") == hashlib.sha1(b"a=1&b=2").hexdigest()


def test_edge_fingerprint(spark):
    for body in (b"abc", b"a" * 5000 + b"b" * 5000):
        want = f"{len(body)}-{hashlib.sha256(body if len(body) <= 8192 else body[:4096] + body[-4096:]).hexdigest()[:16]}"
        assert spark.createDataFrame([(body,)], "c binary").select(T.edge_fingerprint(F.col("c"))).first()[0] == want


def test_small_functions(spark):
    assert one(spark, F.to_json(T.name_parts(F.col("s"))), s=" Ada  King Lovelace ") == '{"keyname":"Lovelace","forenames":"Ada King"}'
    assert one(spark, F.to_json(T.name_parts(F.col("s"))), s="Plato") == '{"keyname":"Plato"}'
    assert one(spark, T.short_id(F.col("s")), s="https://x/W12") == "W12"
    assert one(spark, T.slugify(F.col("s")), s=" The  First, Book! ") == "the-first-book"
    assert one(spark, T.strip_think(F.col("s")), s="<think>a\nb</think> c") == "c"
    assert one(spark, T.intro(F.col("s")), s="a\n## b\n# c\nd") == "a\n## b"
    assert one(spark, T.template_date(F.col("s")), s="x {{date|March 5, 2024}} y") == "2024-03-05"
    assert one(spark, T.template_date(F.col("s")), s="none") is None
    assert one(spark, T.mirror_path(F.col("s")), s="12345") == "1/2/3/4/12345"
    assert one(spark, T.mirror_path(F.col("s")), s="7") == "0/7"
    assert one(spark, T.number_or_null(F.col("s")), s=".") is None
    assert one(spark, T.redirect_target(F.col("s")), s=" #redirect [[ Animal#x|y]]") == "Animal"
    assert one(spark, T.redirect_target(F.col("s")), s="text #REDIRECT [[A]]") is None
    assert one(spark, F.to_json(T.json_strings(F.col("s"))), s='["a", " ", "b"]') == '["a","b"]'
    assert one(spark, F.to_json(T.json_strings(F.col("s"))), s="oops") == "[]"
    assert one(spark, F.to_json(T.categories(F.col("s"))), s="[[category: big_cats|x]] [[Category:Big cats]]") == '["Big cats"]'


def test_place_sentence(spark):
    c = T.place_sentence(F.col("n"), F.lit("city"), F.lit("Chile"), F.lit(1.5), F.lit(-2.0), F.lit(12345), F.lit(""))
    assert one(spark, c, n="Arica") == "Arica is a city, in Chile, located at 1.5, -2.0, with a population of 12,345."


def test_markup():
    assert markup.html_text("plain") == "plain"
    assert markup.html_text("<b>a</b>&amp;<i>b</i>").split() == ["a", "&", "b"]
    md = markup.html_markdown("<h2>T</h2><p>a <b>b</b> <a href='/u'>l</a> <a href='#x'>m</a></p><ul><li>x</li></ul><script>no</script>")
    assert md == "## T\n\na **b** [l](/u) m\n\n- x\n"
    wiki = "Lead '''bold''' {{t|{{u}}}}<ref>r</ref>\n== One ==\n[[a|b]] [[File:x.png|thumb]]\n== References ==\nz"
    assert markup.wiki_markdown(wiki) == "## Introduction\n\nLead bold\n\n## One\n\nb"
    assert markup.wiki_markdown("#REDIRECT [[x]]") == "" == markup.wiki_markdown(None)


def test_chunks():
    p = chunking.Profile(400, 500, 40)
    assert chunking.chunk_text("", p) == []
    assert all(len(c) <= 500 for c in chunking.chunk_text("x" * 5000, p))
    got = chunking.chunk_text("The quick brown fox jumps over the lazy dog. " * 60, p)
    assert got and all(c[0].isupper() or c[0] == "." for c in got)
    got = chunking.chunk_markdown("lead\n## Geography\nhills\n### Deep\nriver\n## Economy\n```\n## no\n```", chunking.DENSE, "Lead")
    assert [s for s, _ in got] == ["Lead", "Geography", "Geography", "Economy"]
    assert "## no" in got[-1][1]
    assert chunking.chunk_pages("a\f\fb", p) == [("p. 1", "a"), ("p. 3", "b")]
    with pytest.raises(ValueError):
        chunking.Profile(10, 5, 0)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60))
def test_chunk_properties(text, size):
    p = chunking.Profile(size, size + 5, size // 4)
    got = chunking.chunk_text(text, p)
    assert all(0 < len(c) <= p.cap for c in got)
    kept = "".join(chunking.tidy(text).split())
    assert not kept or got  # no document with text is lost
    assert set("".join(got)) - set(" \n") == set(kept)


def test_chunk_frame(spark):
    df = spark.createDataFrame([(1, "a. " * 900, "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, label string")
    rows = chunking.chunks(df, "text", chunking.WIKI, section="label").collect()
    assert {r.doc_id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].section == "s"
