"""Archives, library records and rendered papers."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.sources import archives, xmlrows


def test_members_and_manual_pages(spark, tmp_path):
    with tarfile.open(tmp_path / "docs.tar.bz2", "w:bz2") as t:
        for name, text in (("docs-3/library/os.txt", "\n  os — tools\n\ntext"), ("docs-3/about.txt", "About"), ("docs-3/image.png", "x"), ("docs-3/empty.txt", "")):
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    rows = archives.manual_pages(archives.files(spark, str(tmp_path), "*.tar.bz2")).collect()
    assert {(r.doc_path, r.section, r.title) for r in rows} == {("library/os", "library", "os — tools"), ("about", "root", "About"), ("empty", "root", "")}
    with zipfile.ZipFile(tmp_path / "bills.zip", "w") as z:
        z.writestr("a/b.xml", "<x/>")
        z.writestr("c.txt", "t")
    got = archives.members(archives.files(spark, str(tmp_path), "*.zip"), ".xml").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("a/b.xml", b"<x/>")]


def record(*fields):
    body, directory = b"", b""
    for tag, value in fields:
        data = value.encode() + b"\x1e"
        directory += f"{tag}{len(data):04d}{len(body):05d}".encode()
        body += data
    base = 24 + len(directory) + 1
    return f"{base + len(body) + 1:05d}nam a22{base:05d} a 4500".encode() + directory + b"\x1e" + body + b"\x1d"


def test_library_books(spark, tmp_path):
    a, b = "10\x1fa", "\x1fb"
    fixed = "x" * 35 + "eng d"
    data = b"".join([
        record(("001", "1"), ("008", fixed), ("010", "  \x1fan1"), ("100", "1 \x1faDoe, J."), ("245", f"{a}Rivers :{b}of the north"), ("264", " 1\x1fbPress\x1fc1999"), ("650", " 0\x1faWater\x1fxHistory"), ("650", " 0\x1faMaps"), ("520", "  \x1faÜber")),
        record(("010", "  \x1fan1"), ("245", f"{a}Second of its number")),
        record(("010", "  \x1fan2"), ("041", "1 \x1fager"), ("245", f"{a}Flüsse")),
        b"broken\x1d",
        record(("010", "  \x1fan3"), ("110", "2 \x1faOffice"), ("245", f"{a}Report"), ("260", "  \x1fbHouse\x1fc2001")),
    ])
    (tmp_path / "books.mrc").write_bytes(data)
    got = {r.lccn: r for r in archives.library_books(archives.files(spark, str(tmp_path))).collect()}
    assert got.keys() == {"n1", "n3"}
    r = got["n1"]
    assert (r.title, r.author, r.published, r.publisher, r.subject, r.summary, r.language) == ("Rivers : of the north", "Doe, J.", "1999", "Press", "Water; Maps", "Über", "eng")
    assert (got["n3"].author, got["n3"].published, got["n3"].language) == ("Office", "2001", "")


def test_book_files(spark, tmp_path):
    for name in ("1/2/12-0.txt", "1/2/old/12-0.txt", "3/3-0.txt", "3/3-8.txt", "4/x-0.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text")
    catalog = spark.createDataFrame([(12, "Twelve")], "id long, title string")
    got = archives.book_files(spark, str(tmp_path), catalog).collect()
    assert sorted((r.id, r.title, r.size_bytes) for r in got) == [(3, None, 4), (12, "Twelve", 4)]


def test_acts(spark):
    xml = '<Statute xmlns:lims="http://l" lims:lastAmendedDate="2020-01-01" in-force="yes"><Identification><LongTitle>An Act about <I>x</I></LongTitle><ShortTitle>X Act</ShortTitle><Chapter><ConsolidatedNumber>A-1</ConsolidatedNumber></Chapter></Identification></Statute>'
    (r,) = xmlrows.acts(spark.createDataFrame([(7, xml), (8, "<broken")], "id long, xml string"), ["id"], "xml").collect()
    assert tuple(r) == (7, "statute", "A-1", "X Act", "An Act about x", "yes", "2020-01-01")


def test_nested_divisions_keep_their_paragraphs(spark):
    xml = '<R><D TYPE="SECTION" N="1"><HEAD>a</HEAD><P>one</P><D TYPE="SECTION" N="2"><P>two</P></D><P>three</P></D></R>'
    got = xmlrows.regulation_sections(spark.createDataFrame([(1, xml)], "id long, xml string"), ["id"], "xml").collect()
    assert [(r.section, r.content) for r in got] == [("1", "one\nthree"), ("2", "two")]


def test_book_contents(spark):
    xml = """<c:collection xmlns:c="http://c" xmlns:md="http://md"><c:metadata><md:title>Book</md:title><md:slug>book</md:slug><md:license url="http://by"/></c:metadata><c:content>
      <c:module document="m0"/><c:subcollection><md:title>First</md:title><c:content><c:module document="m1"/><c:subcollection><c:content><c:module document="m2"/></c:content></c:subcollection></c:content></c:subcollection>
      <c:subcollection><c:metadata><md:title>Second</md:title></c:metadata><c:content><c:module document="m3"/><c:module/></c:content></c:subcollection></c:content></c:collection>"""
    rows = xmlrows.book_contents(spark.createDataFrame([("b", xml)], "book string, xml string"), ["book"], "xml").orderBy("place").collect()
    assert [(r.chapter_number, r.chapter_title, r.module_id) for r in rows] == [(None, None, "m0"), (1, "First", "m1"), (1, "First", "m2"), (2, "Second", "m3")]
    assert (rows[0].book_title, rows[0].slug, rows[0].license, rows[0].uuid) == ("Book", "book", "http://by", "")


def test_tokens_and_broken_documents(spark):
    rows = ['<a x="1>2"><!-- <b> --><b>t &lt;u&gt; &amp;amp;</b><![CDATA[<raw>]]><c/></a>', "<a><b></a></b>", "<a>", "</a>", "<a/><b/>", "x<a/>", "text", "", None, '<?xml version="1.0"?>\n<r/>\n', "<broken"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, xml string")
    got = {}
    for r in xmlrows.tokens(df, ["id"], "xml").orderBy("doc", "pos").collect():
        got.setdefault(r.id, []).append((r.text, "/".join(x.name for x in r.path)))
    assert {k: [x for x in v if x[1]] for k, v in got.items()} == {0: [(None, "a"), (None, "a/b"), ("t <u> &amp;", "a/b"), ("<raw>", "a"), (None, "a/c")], 9: [(None, "r")]}
    assert xmlrows.acts(df.filter("id IN (4, 6, 7, 8)"), ["id"], "xml").count() == 0


def test_code_sections(spark):
    xml = '<u:doc xmlns:u="x"><u:section><u:num>§ 1</u:num><u:heading>One <i>a</i></u:heading><p>  Text </p><u:section><u:num>§ 2</u:num>in</u:section><u:num>no</u:num></u:section><u:section> </u:section></u:doc>'
    got = xmlrows.code_sections(spark.createDataFrame([(1, xml), (1, xml)], "id long, xml string"), ["id"], "xml").collect()
    assert [tuple(r) for r in got] == [(1, "§ 1", "One a", "§ 1One a Text § 2inno"), (1, "§ 2", "", "§ 2in")] * 2


def test_paper_markdown():
    p = markup.paper_markdown
    page = '<html><body><nav>menu</nav><article class="ltx_document"><h1 class="ltx_title_document">Name</h1><div class="ltx_authors">Ann</div>{}</article></body></html>'
    cases = {
        '<h6 class="ltx_title_abstract">Abstract</h6><p>Short.</p>': "## Abstract\n\nShort.\n",
        '<h2><span class="ltx_tag">1 </span>Intro <b>x</b></h2><p>A <math alttext="a^2">b</math> and <math display="block">c</math></p>': "## Intro x\n\nA $a^2$ and $$c$$\n",
        "<ul><li>one<li>two <i>x</i></ul>": "- one\n- two x\n",
        "<ol><li>a</li><li>b<ul><li>c</li></ul></li></ol>": "1. a\n2. b - c\n",
        "<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>": "| a | b\\|c |\n| --- | --- |\n| 1 |  |\n",
        '<p>See <cite>[<a href="#b1">X 1</a>; <a href="#b2">Y</a>]</cite>, <a href="#s">here</a>, <a href="http://h">there</a></p>': "See [X 1, Y], here, [there](http://h)\n",
        '<p><span class="ltx_font_bold">b</span> <em class="ltx_font_italic">i</em> <span class="ltx_font_typewriter">t</span> <code>c <b>d</b></code></p><pre>x\n y</pre>': "**b** *i* `t` `c d`\n\n```\nx\n y\n```\n",
        '<figure><div><figure><img src="x"><figcaption>Fig <b>1</b></figcaption>body</figure></div></figure>': "*Fig 1*\n\nbody\n",
        "<p>a</p>\n\n\n\n<p>b": "a\n\nb\n",
    }
    for html, want in cases.items():
        assert p(page.format(html)) == want, html
    assert p(None) is None and p("") == "\n" and p("<p>no article") == "no article\n"


def test_head_without_end_and_templates():
    assert markup.html_markdown("<html><head><title>T</title><body><h1>Hi</h1><p>Some text</p></body>") == "# Hi\n\nSome text\n"
    assert markup.html_markdown("<head><style>x</style></head><p>a<script>b</script>c") == "ac\n"
    cut = markup._without_templates
    assert cut("a{{b{{c}}d}}e") == "ae" and cut("a{{b") == "a{{b" and cut("a}}b{{c}}") == "a}}b" and cut("{{" * 5000 + "}}" * 5000 + "x") == "x"
