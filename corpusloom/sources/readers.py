"""Readers of corpus files: text tables, XML dumps, JSON records; rows that can't be read drop out."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_spaces, is_redirect, redirect_target, strip_all, strip_tags

# Column layouts and codes of the public formats.
PLACES = "geonameid long, name string, asciiname string, alternatenames string, latitude string, longitude string, feature_class string, feature_code string, country_code string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population string, elevation string, dem string, timezone string, modified string"
STATION_CUTS = {"station_id": (1, 11), "latitude": (13, 8), "longitude": (22, 9), "elevation": (32, 6), "state": (39, 2), "name": (42, 30)}
TENTHS = ("TMAX", "TMIN", "TAVG", "PRCP", "AWND")
ELEMENTS = (*TENTHS, "SNOW", "SNWD")
FILING_FORMS = ("10-K", "10-Q", "8-K")
INDEX_LINE = r"^(.+?)\s{2,}(\S(?:.*?\S)?)\s{2,}(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(edgar/\S+)\s*$"


def clean_name(name: str) -> str:
    """A column name of lower-case letters, digits and underscores."""
    name = re.sub(r"_+", "_", re.sub(r"\W", "_", name.strip().lower())).strip("_")
    return f"c_{name}" if not name or name[0].isdigit() else name


def delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    """A delimited file, all strings unless a schema is given; lines that don't fit drop out."""
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "DROPMALFORMED").option("multiLine", False).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return df if schema else df.toDF(*(clean_name(c.lstrip("﻿")) for c in df.columns))


def places(spark: SparkSession, path: str) -> DataFrame:
    """Headerless gazetteer lines; -9999 elevations are null; lines without number or coordinates drop out."""
    df = spark.read.option("sep", "\t").option("quote", "").schema(PLACES).csv(path)
    out = df.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")} | {c: F.nullif(F.col(c).try_cast("long"), F.lit(-9999).cast("long")) for c in ("elevation", "dem")} | {"population": F.coalesce(F.col("population").try_cast("long"), F.lit(0))})
    return out.filter("geonameid IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width station lines; unreadable coordinates are null together; short lines drop out."""
    line = spark.read.text(path).filter(F.length("value") >= 38)
    cut = {n: F.trim(F.substring("value", a, size)) for n, (a, size) in STATION_CUTS.items()}
    number = {n: cut[n].try_cast("double") for n in ("latitude", "longitude", "elevation")}
    whole = number["latitude"].isNotNull() & number["longitude"].isNotNull() & number["elevation"].isNotNull()
    return line.select(cut["station_id"].alias("station_id"), *(F.when(whole, c).alias(n) for n, c in number.items()), cut["state"].alias("state"), cut["name"].alias("name"), F.left(cut["station_id"], F.lit(2)).alias("country_code"))


def standard_unit(element: Column, raw: Column) -> Column:
    value = raw.try_cast("double")
    return F.when(element.isin(*TENTHS), value / 10).otherwise(value)


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Daily observations of the kept elements in standard units; compressed files are read as they are."""
    df = spark.read.schema("station_id string, date string, element string, raw string").csv(path)
    kept = df.filter(F.col("element").isin(*ELEMENTS))
    return kept.select("station_id", "date", "element", standard_unit(F.col("element"), F.col("raw")).alias("value")).filter("value IS NOT NULL")


def filing_index(spark: SparkSession, path: str, forms: Sequence[str] = FILING_FORMS) -> DataFrame:
    """Lines of a company index: company, form, cik, date, path, accession; headers don't match."""
    part = lambda i: F.regexp_extract("value", INDEX_LINE, i)
    rows = spark.read.text(path).filter(F.col("value").rlike(INDEX_LINE)).select(strip_all(part(1)).alias("company_name"), part(2).alias("form_type"), part(3).alias("cik"), part(4).alias("filed"), part(5).alias("path"))
    return rows.filter(F.col("form_type").isin(*forms)).withColumn("accession_number", F.regexp_extract("path", r"([^/]+?)(?:\.txt)?$", 1))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't JSON objects drop out."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    columns = [c for c in df.columns if c != "_corrupt"]
    return df.filter("_corrupt IS NULL").select(*columns)


def flat_strings(df: DataFrame) -> DataFrame:
    """Lists joined by commas, structs and maps as JSON, nulls empty."""
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("array<string"):
            c = F.array_join(c, ", ")
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements ``tag`` as rows; attributes are columns with a leading underscore; broken ones drop out."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").option("attributePrefix", "_").schema(schema).load(path)


def wiki_pages(spark: SparkSession, path: str, namespaces: Sequence[int] = (0,)) -> DataFrame:
    """Pages of a MediaWiki dump, compressed or not, with their redirect target."""
    schema = "id long, title string, ns int, revision struct<id: long, timestamp: string, text: struct<_VALUE: string>>"
    df = xml_rows(spark, path, "page", schema).filter(F.col("ns").isin(*namespaces) & F.col("id").isNotNull())
    text = F.col("revision.text._VALUE")
    return df.select(F.col("id").alias("page_id"), "title", F.col("ns").alias("namespace"), F.col("revision.id").alias("revision_id"), F.coalesce(text, F.lit("")).alias("text"), is_redirect(text).alias("is_redirect"), redirect_target(text).alias("target"))


def forum_posts(spark: SparkSession, path: str, site: str) -> DataFrame:
    df = xml_rows(spark, path, "row", "_Id long, _PostTypeId int, _ParentId long, _Title string, _Body string, _Tags string, _Score long, _CreationDate string")
    return df.filter("_Id IS NOT NULL").select(F.lit(site).alias("site"), F.col("_Id").alias("post_id"), F.col("_PostTypeId").alias("kind"), F.col("_ParentId").alias("parent_id"), F.col("_Title").alias("title"), strip_tags(F.coalesce("_Body", F.lit(""))).alias("body"), F.col("_Tags").alias("tags"), F.col("_Score").alias("score"), F.col("_CreationDate").alias("created"))


def harvested_papers(spark: SparkSession, path: str) -> DataFrame:
    """Records of an OAI-PMH answer; deleted ones and those without id, date, title or abstract drop out."""
    author = "array<struct<keyname: string, forenames: string, suffix: string, affiliation: string>>"
    schema = f"header struct<_status: string, identifier: string, datestamp: string>, metadata struct<arXiv: struct<id: string, created: string, updated: string, authors: struct<author: {author}>, title: string, categories: string, comments: string, doi: string, `journal-ref`: string, abstract: string>>"
    df = xml_rows(spark, path, "record", schema)
    m = lambda n: F.col(f"metadata.arXiv.`{n}`")
    named = F.filter("metadata.arXiv.authors.author", lambda a: F.coalesce(a["keyname"], a["forenames"], a["affiliation"]).isNotNull())
    authors = F.transform(named, lambda a: F.struct(a["keyname"].alias("keyname"), a["forenames"].alias("forenames"), a["affiliation"].alias("affiliation"), F.concat_ws(" ", a["forenames"], a["keyname"], a["suffix"]).alias("display_name")))
    out = df.filter(~F.coalesce(F.col("header._status") == "deleted", F.lit(False))).select(
        m("id").alias("id"), F.col("header.datestamp").alias("oai_datestamp"), collapse_spaces(m("title")).alias("title"), collapse_spaces(m("abstract")).alias("abstract"), authors.alias("authors"),
        m("categories").alias("categories"), F.get(F.split(m("categories"), " "), F.lit(0)).alias("primary_category"), m("created").alias("submitted_date"), m("updated").alias("updated_date"), m("doi").alias("doi"), m("journal-ref").alias("journal_ref"), m("comments").alias("comments"),
    )
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("id", "oai_datestamp", "title", "abstract")]
    return out.filter(given[0] & given[1] & given[2] & given[3])


def text_files(spark: SparkSession, path: str, pattern: str = "*", decode: bool = True) -> DataFrame:
    """(path, size, text) of whole files; UTF-8, else Latin-1."""
    from ..functions.markup import decode_text

    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select("path", F.col("length").alias("size"), decode_text("content").alias("text") if decode else F.col("content"))


def repository_links(df: DataFrame, text: str, source: str, order: str) -> DataFrame:
    """(repo, source): repositories linked from curated lists; the first list that names one wins."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"https?://github\.com/([A-Za-z0-9][\w\-]*/[\w.\-]+)"), F.lit(1))
    each = df.select(F.col(source).alias("source"), F.col(order).alias("_o"), F.explode(found).alias("repo"))
    each = each.withColumn("repo", F.regexp_replace("repo", r"(\.git|[.)])+$", "")).filter(~F.lower("repo").rlike("^(topics|sponsors|features|about|orgs|marketplace|settings|login|search)/"))
    return each.groupBy("repo").agg(F.min_by("source", "_o").alias("source"))
