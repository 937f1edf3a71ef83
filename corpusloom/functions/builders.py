"""Documents to index out of the rows of each source: doc_id, title, version, text, section; rows without text give none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import body_version, hash_version, revision_version
from ..operators.quality import LINK_DUMP_CHARS, LINKS_PER_1000
from . import documents, markup
from . import text as T


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _plain(c: Column) -> Column:
    """Text of a field that may hold HTML."""
    return T.normalize_whitespace(markup.html_to_text(_given(c)))


def _docs(df: DataFrame, doc_id: Column, title: Column, version: Column, text: Column, section: Column | None = None) -> DataFrame:
    label = F.lit(None).cast("string") if section is None else section
    docs = df.select(doc_id.cast("string").alias("doc_id"), title.alias("title"), version.alias("version"), text.alias("text"), label.alias("section"))
    return docs.filter(T.strip_all(_given(F.col("text"))) != "")


def regulations(df: DataFrame) -> DataFrame:
    """From id, title_num, section, heading, content."""
    heading, content = T.strip_all(_given(F.col("heading"))), T.strip_all(_given(F.col("content")))
    name = F.concat(F.lit("Title "), F.col("title_num").cast("string"), F.lit(" § "), _given(F.col("section")))
    return _docs(df, F.col("id"), T.first_given(heading, name), hash_version(heading, content), content)


def laws(df: DataFrame) -> DataFrame:
    """From celex, name, body."""
    return _docs(df, F.col("celex"), T.first_given(T.normalize_whitespace(_given(F.col("name"))), F.col("celex")), hash_version(F.col("body")), F.col("body"))


def textbook_sections(df: DataFrame) -> DataFrame:
    """From section_id, book_title, chapter_title, title, objectives, body: title, objectives and body one below the other."""
    title, aims, body = (T.strip_all(_given(F.col(c))) for c in ("title", "objectives", "body"))
    told = F.when(aims != "", F.concat(F.lit("Learning objectives:\n"), aims))
    text = F.when(body != "", F.concat_ws("\n\n", T.blank_to_null(title), told, body))
    return _docs(df, F.col("section_id"), T.first_given(T.strip_all(F.col("book_title")), F.col("section_id")), hash_version(title, aims, body), text, T.section_label(F.col("chapter_title"), title))


def papers(df: DataFrame) -> DataFrame:
    """From id, title, abstract, html, pdf_text, datestamp, updated: the best body there is, at last the abstract or the title."""
    title, abstract = _plain(F.col("title")), _plain(F.col("abstract"))
    body = T.first_given(F.col("html"), F.col("pdf_text"))
    rendered = F.when(_given(F.col("html")) != "", T.strip_all(markup.paper_to_markdown("html"))).otherwise(T.strip_all(_given(F.col("pdf_text"))))
    version = body_version(F.col("datestamp"), body, title, F.col("abstract"), F.col("updated"))
    return _docs(df, F.col("id"), T.first_given(title, F.col("id").cast("string")), version, T.first_given(rendered, abstract, title))


def works(df: DataFrame) -> DataFrame:
    """From id (an address), title, abstract."""
    title, abstract = _plain(F.col("title")), _plain(F.col("abstract"))
    text = F.concat_ws("\n\n", T.blank_to_null(title), T.blank_to_null(abstract))
    return _docs(df, T.short_id(F.col("id")), T.first_given(title, T.short_id(F.col("id"))), hash_version(title, abstract), text)


def filings(df: DataFrame) -> DataFrame:
    """From accession_number, company_name, form_type, filed, body, status: fetched ones."""
    title = F.trim(F.concat_ws(" ", T.first_given(F.col("company_name"), F.col("accession_number").cast("string")), F.col("form_type"), F.col("filed")))
    fetched = df.filter(F.col("status") == "fetched")
    return _docs(fetched, F.col("accession_number"), title, hash_version(F.col("body")), F.when(T.strip_all(_given(F.col("body"))) != "", markup.html_to_text("body")))


def readmes(df: DataFrame) -> DataFrame:
    """From repo, name, readme, status: fetched ones that aren't mere lists of links."""
    c, n = F.col("readme"), F.length("readme")
    dump = (n >= LINK_DUMP_CHARS) & (T.count_substring(c, "](") * 1000 >= LINKS_PER_1000 * n)
    kept = df.filter((F.col("status") == "fetched") & ~F.coalesce(dump, F.lit(True)))
    return _docs(kept, F.col("repo"), T.first_given(F.col("name"), F.col("repo")), hash_version(c), F.when(T.strip_all(c) != "", markup.html_to_text("readme")))


def books(df: DataFrame) -> DataFrame:
    """From id, title, author, content (the file's bytes)."""
    from ..operators.index import CLEANER

    version = F.concat(T.edge_fingerprint(F.col("content")), F.lit(f"-{CLEANER}"))
    return _docs(df, F.col("id"), T.first_given(F.col("title"), F.col("author"), F.col("id").cast("string")), version, documents.book_body(markup.decode_text("content")))


def articles(df: DataFrame) -> DataFrame:
    """From page_id, namespace, title, revision_id, text (wiki text): pages of the main namespace that aren't redirects."""
    main = df.filter((F.col("namespace") == 0) & (_given(F.col("text")) != ""))
    return _docs(main, F.col("page_id"), F.col("title"), revision_version(F.col("revision_id")), markup.wiki_to_markdown("text"))
