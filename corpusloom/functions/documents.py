"""Source-specific document text: book banners, filings, record fields, JSON profiles, underlined headings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import text_udf
from .markup import html_to_text
from .text import normalize_whitespace, strip_all, strip_markdown

# Section order of country profiles, and heading levels by underline character.
PROFILE_ORDER = ("Introduction", "Geography", "People and Society", "Environment", "Government", "Economy", "Energy", "Communications", "Transportation", "Military and Security", "Space", "Terrorism", "Transnational Issues")
UNDERLINES = {"*": 1, "=": 2, "-": 3, "~": 4, "^": 5, '"': 6}


def book_body(c: Column) -> Column:
    """A public-domain book without banners, notices of its library and Markdown.

    The end banner is looked for after the start banner was cut.
    """
    banner = r"\*\*\*\s*{} OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"
    c = F.regexp_replace(c, rf"(?is)\A.*?{banner.format('START')}[^\n]*\n", "")
    c = F.regexp_replace(c, rf"(?is){banner.format('END')}.*\z", "")
    return normalize_whitespace(strip_markdown(F.regexp_replace(c, r"(?im)^.*project gutenberg.*$\n?", "")))


def filing_body(c: Column, form: Column) -> Column:
    """Text of a filing's main document: the first of its form, else the first; of a filing without documents what follows its header."""
    parts = F.split(c, "(?i)<DOCUMENT>")
    blocks = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    kind = lambda b: F.upper(strip_all(F.regexp_extract(b, r"(?i)<TYPE>([^\r\n<]*)", 1)))
    chosen = F.coalesce(F.get(F.filter(blocks, lambda b: kind(b) == F.upper(form)), F.lit(0)), F.get(blocks, F.lit(0)), F.regexp_replace(c, r"(?is)\A.*?</(?:SEC|IMS)-HEADER>", ""))
    body = F.regexp_extract(chosen, r"(?is)<TEXT>(.*?)(?:</TEXT>|\z)", 1)
    body = F.when(body != "", body).otherwise(chosen)
    for silent in (r"(?is)<(script|style|ix:header)\b.*?</\1\s*>", r"(?is)<(\w+)[^>]*display:\s*none[^>]*>.*?</\1\s*>"):
        body = F.regexp_replace(body, silent, " ")
    return normalize_whitespace(html_to_text(body))


def sectioned(parts: dict[str, Column]) -> Column:
    """Level-two Markdown sections of the fields that have text; empty if none has."""
    return F.concat_ws("\n\n", *(F.when(strip_all(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"## {name}\n\n"), strip_all(c))) for name, c in parts.items()))


def _leaves(value, path: str = ""):
    """(path, text) of each leaf, depth first; a lone ``text`` field stands for its object."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, path if k == "text" else f"{path} > {k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    elif value not in (None, ""):
        yield path, str(value)


def profile_text(raw: str | None) -> str | None:
    """Markdown of a JSON profile: known sections in their order, then the others."""
    try:
        data = json.loads(raw or "")
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    names = [n for n in PROFILE_ORDER if n in data] + [n for n in data if n not in PROFILE_ORDER]
    out = []
    for n in names:
        lines = [f"{p}: {t}" if p else t for p, t in _leaves(data[n])]
        if lines:
            out.append(f"## {n}\n\n" + "\n".join(lines))
    return "\n\n".join(out)


def unwrapped(value):
    """JSON with ``{"text": v}`` as v; beside other fields v goes under ``value``."""
    if isinstance(value, list):
        return [unwrapped(v) for v in value]
    if not isinstance(value, dict):
        return value
    if set(value) == {"text"}:
        return unwrapped(value["text"])
    return {("value" if k == "text" else k): unwrapped(v) for k, v in value.items()}


def _unwrap(raw: str | None) -> str | None:
    try:
        return json.dumps(unwrapped(json.loads(raw or "")), ensure_ascii=False)
    except ValueError:
        return None


def underlined_markdown(df: DataFrame, key: str, text: str, out: str = "markdown") -> DataFrame:
    """``key`` and the plain text with underlined headings as Markdown; level-one headings go, emphasis is unwrapped.

    A line is a heading if the next underlines it: three or more of one sign, as long
    as the heading or up to three longer.  An underline is no heading itself, so of
    lines that underline each other every second is one.
    """
    lines = df.select(key, F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    each = lines.select(key, "row", F.posexplode(F.split("whole", "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy("row").orderBy("pos")
    head, under = strip_all(F.col("line")), strip_all(F.lead("line").over(order))
    sign = F.left(under, F.lit(1))
    level = F.create_map(*(F.lit(x) for pair in UNDERLINES.items() for x in pair))[sign]
    ruled = (F.length(under) >= 3) & (F.replace(under, sign, F.lit("")) == "") & (F.length(head) > 0) & F.length(under).between(F.length(head), F.length(head) + 3)
    marked = each.withColumn("level", F.when(ruled, level))
    since = F.coalesce(F.last(F.when(F.col("level").isNull(), F.col("pos")), ignorenulls=True).over(order), F.lit(-1))
    titled = marked.withColumn("title", F.col("level").isNotNull() & ((F.col("pos") - since) % 2 == 1))
    gone = F.coalesce(F.lag("title").over(order), F.lit(False)) | (F.col("title") & (F.col("level") == 1))
    said = F.when(F.col("title"), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), strip_all(F.col("line")))).otherwise(F.col("line"))
    kept = titled.select(key, "row", "pos", F.when(~gone, said).alias("said"))
    joined = kept.groupBy(key, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "\n").alias(out))
    plain = F.regexp_replace(F.regexp_replace(out, r"(?<!\*)(\*{1,2})(?![*\s])([^*\n]*[^*\s])\1(?!\*)", "$2"), "\n{3,}", "\n\n")
    return joined.select(key, strip_all(plain).alias(out))


profile_to_markdown, unwrap_json = text_udf(profile_text), text_udf(_unwrap)
