"""Readers of archives and of XML and MARC records inside them; each file is one row until its records are taken out."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined, strip_all, strip_tags

# Field and subfield codes of a library record.
BOOK_FIELDS = {"lccn": ("010a",), "title": ("245ab",), "author": ("100a", "110a", "111a"), "published": ("260c", "264c"), "publisher": ("260b", "264b"), "summary": ("520a",), "item_type": ("655a",)}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def _each_member(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if not name.endswith("/"):
                    yield name, z.read(name)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for member in t:
                if member.isfile():
                    yield member.name, t.extractfile(member).read()


def members(archives: DataFrame, suffix: str = "") -> DataFrame:
    """(path, member, content) of each file in zip and tar archives (path, content) whose name ends with ``suffix``."""

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                for name, data in _each_member(path, content):
                    if name.endswith(suffix):
                        yield pd.DataFrame({"path": [path], "member": [name], "content": [data]})

    return archives.select("path", "content").mapInPandas(take, "path string, member string, content binary")


def manual_pages(archives: DataFrame) -> DataFrame:
    """(doc_path, section, title, content) of a manual's text members: the first part of the path is dropped, the first line with text is the title."""
    rows = members(archives, ".txt").select(F.regexp_replace(F.regexp_replace("member", r"^[^/]*/", ""), r"\.txt$", "").alias("doc_path"), F.decode(F.col("content"), "UTF-8").alias("content"))
    lines = F.filter(F.transform(F.split("content", r"\R"), strip_all), lambda x: x != "")
    section = F.when(F.col("doc_path").contains("/"), F.substring_index("doc_path", "/", 1)).otherwise("root")
    return rows.select("doc_path", section.alias("section"), F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("title"), "content")


def book_files(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """Texts named ``<number>-0.txt`` below a directory, retired ones (``old``) left out, with the catalog's data where it has the book."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*-0.txt").option("recursiveFileLookup", True).load(path)
    number = F.regexp_extract("path", r"/([0-9]+)-0\.txt$", 1).try_cast("long")
    found = df.filter(~F.col("path").contains("/old/")).select(number.alias("id"), "path", F.col("length").alias("size_bytes")).filter("id IS NOT NULL")
    return found.join(catalog, "id", "left")


# ---- bills ------------------------------------------------------------------------------------

_BILL = "bill struct<congress: string, billType: string, type: string, billNumber: string, number: string, title: string, introducedDate: string, sponsors: struct<item: array<struct<fullName: string>>>, latestAction: struct<text: string>, policyArea: struct<name: string>>"


def _unescaped(c: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def bills(xml: DataFrame, text: str = "text") -> DataFrame:
    """One row per bill status document: id, what is known of the bill, its subjects in order and its last summary without tags; others drop out."""
    part = lambda tag: F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    names = F.regexp_extract_all(part("subjects"), F.lit("<name>([^<]*)</name>"), F.lit(1))
    subjects = F.array_distinct(F.filter(F.transform(names, lambda x: strip_all(_unescaped(x))), lambda x: x != ""))
    last = F.try_element_at(F.regexp_extract_all(part("summaries"), F.lit("(?s)<summary>(.*?)</summary>"), F.lit(1)), F.lit(-1))
    summary = F.regexp_extract(last, r"(?s)<text>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</text>", 1)
    rows = xml.select(F.from_xml(F.col(text), _BILL, {"mode": "PERMISSIVE"})["bill"].alias("b"), F.array_join(subjects, "; ").alias("subjects"), strip_tags(_unescaped(F.coalesce(summary, F.lit("")))).alias("summary"))
    get = lambda *names: F.coalesce(*(F.nullif(strip_all(F.col(f"b.{n}")), F.lit("")) for n in names), F.lit(""))
    kind, number = get("billType", "type"), get("billNumber", "number")
    return rows.filter("b IS NOT NULL").select(
        joined(get("congress"), kind, number).alias("bill_id"), get("congress").try_cast("int").alias("congress"), kind.alias("bill_type"), number.alias("bill_number"), get("title").alias("title"),
        F.coalesce(strip_all(F.get("b.sponsors.item", F.lit(0))["fullName"]), F.lit("")).alias("sponsor"), get("introducedDate").alias("introduced_date"), get("latestAction.text").alias("latest_action"), get("policyArea.name").alias("policy_area"), "subjects", "summary",
    )


# ---- library records --------------------------------------------------------------------------


def marc_fields(record: bytes) -> dict[str, list[str]]:
    """Fields of one binary record by tag: control fields as they are, others from their first subfield mark on."""
    base, out = int(record[12:17]), {}
    for at in range(24, base - 1, 12):
        tag, size, start = record[at : at + 3].decode(), int(record[at + 3 : at + 7]), int(record[at + 7 : at + 12])
        out.setdefault(tag, []).append(record[base + start : base + start + size].rstrip(b"\x1e").decode("utf-8", "replace"))
    return out


def _subfields(field: str) -> list[tuple[str, str]]:
    return [(s[0], s[1:]) for s in field.split("\x1f")[1:] if s]


def _book(fields: dict[str, list[str]]) -> dict[str, str]:
    def first(*codes: str) -> str:
        for code in codes:
            for field in fields.get(code[:3], [])[:1]:
                if text := " ".join(v for k, v in _subfields(field) if k in code[3:]).strip():
                    return text
        return ""

    row = {name: first(*codes) for name, codes in BOOK_FIELDS.items()}
    topics = [next((v for k, v in _subfields(f) if k == "a"), None) for f in fields.get("650", [])]
    fixed = (fields.get("008") or [""])[0]
    return row | {"subject": "; ".join(t for t in topics if t), "language": first("041a") or (fixed[35:38].strip() if len(fixed) >= 38 else "")}


def library_books(df: DataFrame, content: str = "content") -> DataFrame:
    """English books out of files of binary library records; records that can't be read drop out, of equal numbers the first stays."""
    names = [*BOOK_FIELDS, "subject", "language"]

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, data in zip(part.iloc[:, 0], part.iloc[:, 1]):
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                elif data[:3] == b"BZh":
                    data = bz2.decompress(data)
                rows = []
                for n, record in enumerate(re.findall(rb"[^\x1d]+(?=\x1d)", data)):
                    try:
                        rows.append(_book(marc_fields(record)) | {"path": path, "place": n})
                    except (ValueError, IndexError):
                        continue
                if rows:
                    yield pd.DataFrame(rows)[["path", "place", *names]]

    every = df.select("path", content).mapInPandas(take, "path string, place long, " + ", ".join(f"{n} string" for n in names))
    english = every.filter(strip_all(F.col("language")).isin("", "eng", "en"))
    first = english.groupBy("lccn").agg(F.min_by(F.struct(*names), F.struct("path", "place")).alias("book"))
    return first.select("book.*")


