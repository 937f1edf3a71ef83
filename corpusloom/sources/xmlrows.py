"""XML documents as rows of tokens with the elements they lie in, and records taken from them; all in DataFrame operations.

A document's tags and texts become rows in their order.  Levels are a running sum of
opened and closed elements; what was opened last on each level above a token is its
path.  Names are taken without their namespace.  Documents whose elements aren't
closed in pairs around one root drop out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace, strip_all
from .scratch import written

# Kinds of divisions of a regulation's XML.
DIVISIONS = ("TITLE", "SUBTITLE", "CHAPTER", "SUBCHAPTER", "PART", "SUBPART", "SUBJGRP", "SECTION", "APPENDIX")

_TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>|[^<]+"""


def _unescaped(c: Column) -> Column:
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#160", "\xa0"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def tokens(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """(keys, doc, pos, text, path): texts and opening tags of each document in order.

    ``path`` is array<struct<pos, name, tag>> of the elements around a text, from the
    root; an opening tag's own element is the path's last and its text is null.
    ``doc`` tells rows apart that repeat the keys.
    """
    told = df.select(*keys, F.col(content).alias("xml content")).withColumn("doc", F.monotonically_increasing_id())
    cut = told.select(*keys, "doc", F.posexplode(F.regexp_extract_all("xml content", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    data = F.col("token").startswith("<![CDATA[")
    kept = cut.filter(data | ~F.col("token").rlike(r"^<[!?]"))
    tag = F.col("token").startswith("<") & ~data
    closes, alone = tag & F.col("token").startswith("</"), tag & F.col("token").endswith("/>")
    opens = tag & ~closes
    text = F.when(data, F.regexp_extract("token", r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)).when(~tag, _unescaped(F.col("token")))
    name = F.when(tag, F.regexp_extract("token", r"^</?(?:[^\s/>:]+:)?([^\s/>]+)", 1))
    rows = kept.select(*keys, "doc", "pos", text.alias("text"), name.alias("name"), F.when(opens, F.col("token")).alias("tag"), opens.alias("opens"), (closes | alone).alias("closes"))
    order = Window.partitionBy("doc").orderBy("pos")
    opened = F.sum(F.col("opens").cast("int")).over(order)
    closed = F.coalesce(F.sum(F.col("closes").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levelled = written(rows.withColumn("level", opened - closed), "xml-tokens")  # a closing tag has its element's level
    deepest = levelled.agg(F.max("level")).first()[0] or 0
    here = lambda i: F.last(F.when(F.col("opens") & (F.col("level") == i), F.struct("pos", "name", "tag")), ignorenulls=True).over(order)
    above = F.slice(F.array(*(here(i) for i in range(1, deepest + 1))), 1, F.greatest("level", F.lit(0))) if deepest > 0 else F.array().cast("array<struct<pos: int, name: string, tag: string>>")
    pathed = levelled.withColumn("path", above)
    stray = (F.col("level") < 1) & (F.col("closes") | (strip_all(F.coalesce("text", F.lit(""))) != ""))
    crossed = F.col("closes") & (F.col("level") >= 1) & (F.col("name") != F.try_element_at("path", F.lit(-1))["name"])
    one = lambda c: F.sum(c.cast("int"))
    judged = pathed.groupBy("doc").agg(one(stray | crossed).alias("wrong"), (one(F.col("opens")) - one(F.col("closes"))).alias("left"), one(F.col("opens") & (F.col("level") == 1)).alias("roots"))
    good = judged.filter("wrong = 0 AND left = 0 AND roots = 1").select("doc")
    return pathed.filter(F.col("opens") | F.col("text").isNotNull()).join(good, "doc", "left_semi").select(*keys, "doc", "pos", "text", "path")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, whatever its namespace; empty where there is none."""
    either = F.regexp_extract(tag, rf"""\s(?:[^\s=:>]+:)?{name}\s*=\s*(?:"([^"]*)"|'[^']*')""", 1)
    return _unescaped(F.when(either != "", either).otherwise(F.regexp_extract(tag, rf"""\s(?:[^\s=:>]+:)?{name}\s*=\s*'([^']*)'""", 1)))


def _joined(order: str = "pos", text: str = "text") -> Column:
    """A group's texts in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")


def regulation_sections(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Sections of regulations in document order, each with the headings of the chapter and part before it.

    Divisions are elements with a TYPE; a section has the paragraphs (P) that lie in no
    division within it.
    """
    read = tokens(df, keys, content)
    kind = lambda x: attribute(x["tag"], "TYPE")
    divisions = F.filter("path", lambda x: kind(x).isin(*DIVISIONS))
    said = read.withColumn("division", F.try_element_at(divisions, F.lit(-1))).filter("division IS NOT NULL")
    last = F.try_element_at("path", F.lit(-1))
    opened = said.filter(F.col("text").isNull() & (last["pos"] == F.col("division.pos"))).select(*keys, "doc", F.col("division.pos").alias("division"), attribute(F.col("division.tag"), "TYPE").alias("kind"), attribute(F.col("division.tag"), "N").alias("section"))
    texts = said.filter(F.col("text").isNotNull())
    parent = F.get("path", F.size("path") - 2)
    heads = texts.filter((last["name"] == "HEAD") & (parent["pos"] == F.col("division.pos"))).groupBy("doc", F.col("division.pos").alias("division")).agg(strip_all(_joined()).alias("heading"))
    inner = F.filter("path", lambda x: (x["name"] == "P") & (x["pos"] > F.col("division.pos")))
    outer = texts.withColumn("p", F.get(inner, F.lit(0))["pos"]).filter("p IS NOT NULL")
    paragraphs = outer.groupBy("doc", F.col("division.pos").alias("division"), "p").agg(strip_all(_joined()).alias("text")).filter("text != ''")
    bodies = paragraphs.groupBy("doc", "division").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n").alias("content"))
    rows = opened.join(heads, ["doc", "division"], "left").withColumn("heading", F.coalesce("heading", F.lit("")))
    order = Window.partitionBy("doc").orderBy("division")
    carried = lambda name: F.coalesce(F.last(F.when(F.col("kind") == name, F.col("heading")), ignorenulls=True).over(order), F.lit(""))
    rows = rows.withColumns({"chapter": carried("CHAPTER"), "part": carried("PART")}).filter("kind = 'SECTION'")
    return rows.join(bodies, ["doc", "division"], "left").orderBy("doc", "division").select(*keys, "chapter", "part", "section", "heading", F.coalesce("content", F.lit("")).alias("content"))


def code_sections(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Sections of a legal code, whatever the namespace: number, heading, whole text with its spaces put in order."""
    texts = tokens(df, keys, content).filter("text IS NOT NULL")
    around = F.filter("path", lambda x: x["name"] == "section")
    each = texts.withColumn("s", F.explode(F.transform(around, lambda x: x["pos"]))).withColumn("child", F.get(F.filter("path", lambda x: x["pos"] > F.col("s")), F.lit(0)))
    # Of several children of a name the first counts.
    first = lambda name: F.min(F.when(F.col("child.name") == name, F.col("child.pos"))).over(Window.partitionBy("doc", "s"))
    named = each.withColumns({"num": first("num"), "head": first("heading")})
    part = lambda c: strip_all(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("child.pos") == F.col(c), F.struct("pos", "text")))), lambda x: x["text"]), ""))
    rows = named.groupBy(*keys, "doc", "s").agg(part("num").alias("section"), part("head").alias("heading"), normalize_whitespace(_joined()).alias("content"))
    return rows.filter("content != ''").orderBy("doc", "s").select(*keys, "section", "heading", "content")


def _ends_with(place: str) -> Column:
    """The sizes of the path's beginnings that end with these names."""
    depth = place.count("/") + 1
    names = lambda i: F.array_join(F.transform(F.slice("path", F.greatest(i - depth + 1, F.lit(1)), depth), lambda x: x["name"]), "/")
    return F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: names(i) == place)


def acts(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per act or regulation: its kind, number, titles, whether it is in force and when it was amended last."""
    read = tokens(df, keys, content)
    root = read.filter(F.col("text").isNull() & (F.size("path") == 1)).select(*keys, "doc", F.get("path", F.lit(0))["tag"].alias("tag"), F.lower(F.get("path", F.lit(0))["name"]).alias("kind"))
    # The texts of each kind of element, of which the document's first with any text is the value.
    wanted = {"short_title": ("Identification/ShortTitle", "ShortTitle"), "long_title": ("Identification/LongTitle", "LongTitle"), "number": ("Chapter/ConsolidatedNumber", "InstrumentNumber", "Chapter")}
    found = []
    for name, places in wanted.items():
        for rank, place in enumerate(places):
            ends = _ends_with(place)
            at = F.get("path", F.get(ends, F.lit(0)) - 1)["pos"]
            found.append(F.when(F.size(ends) > 0, F.struct(F.lit(name).alias("name"), F.lit(rank).alias("rank"), at.alias("at"))))
    texts = read.filter("text IS NOT NULL").withColumn("of", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    values = texts.groupBy("doc", "of").agg(strip_all(_joined()).alias("value")).groupBy("doc", "of.name", "of.rank").agg(F.min_by("value", "of.at").alias("value")).filter("value != ''")
    best = values.groupBy("doc").pivot("name", list(wanted)).agg(F.min_by("value", "rank"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return root.join(best, "doc", "left").orderBy("doc").select(*keys, "kind", empty("number"), empty("short_title"), empty("long_title"), attribute(F.col("tag"), "in-force").alias("in_force"), attribute(F.col("tag"), "lastAmendedDate").alias("amended"))


def book_contents(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The modules of textbooks in order, with their numbered chapters; modules outside of chapters have none."""
    read = tokens(df, keys, content)
    name = lambda i: F.get("path", F.lit(i - 1))["name"]
    last = F.try_element_at("path", F.lit(-1))
    modules = read.filter(F.col("text").isNull() & (last["name"] == "module") & (name(2) == "content")).withColumn("module_id", attribute(last["tag"], "document")).filter("module_id != ''")
    order = Window.partitionBy("doc").orderBy("pos")
    modules = modules.select(*keys, "doc", "module_id", F.when(name(3) == "subcollection", F.get("path", F.lit(2))["pos"]).alias("chapter"), (F.row_number().over(order) - 1).alias("place"))
    opened = read.filter(F.col("text").isNull() & (F.size("path") == 3) & (name(2) == "content") & (name(3) == "subcollection"))
    chapters = opened.select("doc", last["pos"].alias("chapter"), F.row_number().over(order).alias("chapter_number"))
    texts = read.filter("text IS NOT NULL")
    of_chapter = (name(3) == "subcollection") & ((name(4) == "title") | ((name(4) == "metadata") & (name(5) == "title")))
    titles = texts.filter(of_chapter).groupBy("doc", F.get("path", F.lit(2))["pos"].alias("chapter"), (name(4) != "title").alias("late")).agg(strip_all(_joined()).alias("t"))
    titles = titles.groupBy("doc", "chapter").agg(F.min_by("t", "late").alias("chapter_title"))
    meta = texts.filter((name(2) == "metadata") & (F.size("path") >= 3)).groupBy("doc", name(3).alias("n")).agg(strip_all(_joined()).alias("v"))
    book = meta.groupBy("doc").pivot("n", ["title", "uuid", "slug", "license"]).agg(F.first("v"))
    urls = read.filter(F.col("text").isNull() & (name(2) == "metadata") & (last["name"] == "license")).select("doc", attribute(last["tag"], "url").alias("url"))
    empty = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(""))
    rows = modules.join(chapters, ["doc", "chapter"], "left").join(titles, ["doc", "chapter"], "left").join(book, "doc", "left").join(urls, "doc", "left")
    chapter_title = F.when(F.col("chapter").isNotNull(), F.coalesce("chapter_title", F.lit("")))
    return rows.orderBy("doc", "place").select(*keys, empty("title").alias("book_title"), empty("uuid").alias("uuid"), empty("slug").alias("slug"), F.coalesce(F.nullif(F.col("license"), F.lit("")), "url", F.lit("")).alias("license"), "chapter_number", chapter_title.alias("chapter_title"), "module_id", F.col("place").cast("int").alias("place"))
