"""Text and identity functions as pure Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
# White space of any kind, one character after the other.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_all(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.trim(c, F.lit(BLANKS))


def normalize_whitespace(c: Column) -> Column:
    """One kind of line end, single spaces, none around line ends, at most one blank line."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return strip_all(F.regexp_replace(c, "\n{3,}", "\n\n"))


# What marks enclose: code or a link's text, which an image's looks like; then emphasis by pairs of a sign, and by one.
_SPANS = r"`([^`]+)`|!?\[([^\]]*)\]\([^)]*\)"
_STRONG = r"(?s)([*_])\1((?:(?!\1).)++)\1\1"
_WEAK = r"(?<!\*)\*([^*\n]+)\*(?!\*)|(?<!_)_([^_\n]+)_(?!_)"
# What begins a line: a heading's signs, then a quotation's, then a rule that is all of it.
_LINE_MARKS = r"(?md)^(?:#{1,6}\s+)?(?:>\s?)?(?:[-*_]{3,}\s*$)?"
_FENCE = "```"


def _without_fences(c: Column) -> Column:
    """Text between a pair of fences becomes a space; what follows one that isn't closed stays."""

    def outside(parts: Column) -> Column:
        even = F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), " ")
        return F.when(F.size(parts) % 2 == 0, F.concat(even, F.lit(_FENCE), F.try_element_at(parts, F.lit(-1)))).otherwise(even)

    return F.when(c.contains(_FENCE), F.get(F.transform(F.array(F.split(c, _FENCE, -1)), outside), F.lit(0))).otherwise(c)


def strip_markdown(c: Column) -> Column:
    """Plain text of Markdown: fenced code becomes a space, what marks enclose stays without them, line markers go.

    Spans are opened from the outside in, as often as they lie in each other: an image
    in a link in code, and strong or weak emphasis in the other sign's.
    """
    c = _without_fences(c)
    for marks, opened, depth in ((_SPANS, "$1$2", 3), (_STRONG, "$2", 2), (_WEAK, "$1$2", 2)):
        for _ in range(depth):
            c = F.regexp_replace(c, marks, opened)
    return F.regexp_replace(c, _LINE_MARKS, "")


def collapse_spaces(c: Column) -> Column:
    return strip_all(F.regexp_replace(c, SPACES, " "))


def strip_tags(c: Column) -> Column:
    """Tags become spaces, then spaces collapse."""
    return collapse_spaces(F.regexp_replace(c, "<[^>]+>", " "))


def split_list(c: Column, by: str = ";") -> Column:
    """Trimmed, non-empty items of a delimited string."""
    return F.filter(F.transform(F.split(c, by), strip_all), lambda x: x != "")


def joined(*parts: Column, by: str = "-") -> Column:
    """One key out of several parts, null where one is missing."""
    every = F.lit(True)
    for p in parts:
        every = every & p.isNotNull()
    return F.when(every, F.concat_ws(by, *(p.cast("string") for p in parts)))


def section_label(chapter: Column, section: Column) -> Column:
    """``chapter — section``, or the one that is given."""
    return F.nullif(F.concat_ws(" — ", blank_to_null(chapter), blank_to_null(section)), F.lit(""))


def body_with_source(**bodies: Column) -> Column:
    """struct(body, source): the first body that has text, and its name; a null struct if none has."""
    found = [F.when(strip_all(F.coalesce(c, F.lit(""))) != "", F.struct(c.alias("body"), F.lit(name).alias("source"))) for name, c in bodies.items()]
    return F.coalesce(*found)


def escaped_html(c: Column) -> Column:
    """Text as HTML: the five signs that markup uses become entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def short_id(c: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(c, "/"), -1)


def title_case(c: Column) -> Column:
    """Underscores as spaces, spaces collapsed, first letter upper-case; the rest as it is."""
    c = collapse_spaces(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_name(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def count_substring(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def strip_think(c: Column) -> Column:
    """Without a model's ``<think>`` blocks."""
    return strip_all(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))


def intro(c: Column) -> Column:
    """The lines before the first level-one heading."""
    return strip_all(F.regexp_replace(c, r"(?ms)^#(?!#).*\z", ""))


def is_redirect(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^\s*#\s*redirect\s*\[\["), F.lit(False))


def redirect_target(c: Column) -> Column:
    """The title a redirect leads to, without anchor and label; null if the text is none."""
    return F.when(is_redirect(c), F.nullif(strip_all(F.regexp_extract(c, r"(?i)^\s*#\s*redirect\s*\[\[\s*([^\]|#]+)", 1)), F.lit("")))


def categories(c: Column) -> Column:
    """Distinct category names of a wiki text, sort keys dropped, names normalised."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\[\[\s*category\s*:\s*([^\]|]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, title_case), lambda x: x != ""))


def content_hash(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts, each followed by a NUL; null counts as empty."""
    joined = F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))))
    return F.substring(F.sha2(joined, 256), 1, 32)


def plain_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 32)


def edge_fingerprint(content: Column) -> Column:
    """``size-hash`` of a binary: 16 hex digits over its first and last 4096 bytes."""
    size = F.octet_length(content)
    tail = F.when(size > 8192, F.substring(content, -4096, 4096)).otherwise(F.unhex(F.lit("")))
    head = F.when(size > 8192, F.substring(content, 1, 4096)).otherwise(content)
    return F.concat(size.cast("string"), F.lit("-"), F.substring(F.sha2(F.concat(head, tail), 256), 1, 16))


def cache_key(params: Column) -> Column:
    """SHA-1 over a map's sorted ``key=value`` pairs."""
    pairs = F.transform(F.map_entries(params), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha1(F.array_join(F.array_sort(pairs), "&"))


def name_parts(c: Column) -> Column:
    """struct(keyname, forenames): the last word, and the words before it (null if none)."""
    words = F.split(collapse_spaces(c), " ")
    rest = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(F.element_at(words, -1).alias("keyname"), F.nullif(rest, F.lit("")).alias("forenames"))


def display_name(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), TOKEN_BREAK), lambda x: x != "")


def abstract_from_index(c: Column) -> Column:
    """Text of an inverted index map<word, array<position>>: words by position, then word."""
    placed = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def embed_input(title: Column, section: Column, text: Column) -> Column:
    head = F.when(F.coalesce(section, F.lit("")) != "", F.concat_ws(" - ", title, section)).otherwise(title)
    return F.concat(F.lit("search_document: "), F.coalesce(head, F.lit("")), F.lit("\n\n"), text)


def embed_query(text: Column) -> Column:
    return F.concat(F.lit("search_query: "), text)


def mirror_path(number: Column) -> Column:
    """Directory of a numbered text: its digits but the last, then the number; one digit lies under 0."""
    s = number.cast("string")
    digits = F.array_join(F.split(F.left(s, F.length(s) - 1), ""), "/")
    return F.concat_ws("/", F.when(F.length(s) < 2, F.lit("0")).otherwise(digits), s)


def human_size(n: Column) -> Column:
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).when(n < 1024**4, 3).otherwise(4)
    unit = F.element_at(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "TB"))), step + 1)
    return F.concat(F.replace(F.format_number(n / F.pow(F.lit(1024.0), step), 1), F.lit(","), F.lit("")), F.lit(" "), unit)


def place_sentence(name: Column, feature: Column, country: Column, lat: Column, lon: Column, population: Column, timezone: Column) -> Column:
    """One sentence about a place; parts that are missing are left out."""
    parts = (
        F.concat(name, F.lit(" is a "), F.coalesce(feature, F.lit("place"))),
        F.when(country != "", F.concat(F.lit("in "), country)),
        F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("located at "), lat.cast("string"), F.lit(", "), lon.cast("string"))),
        F.when(population > 0, F.concat(F.lit("with a population of "), F.format_number(population, 0))),
        F.when(timezone != "", F.concat(F.lit("in the "), timezone, F.lit(" timezone"))),
    )
    return F.concat(F.concat_ws(", ", *parts), F.lit("."))


def degrees(value: Column, north: str, south: str) -> Column:
    """Degrees, minutes and seconds with a hemisphere letter."""
    total = F.round(F.abs(value) * 3600).cast("long")
    return F.concat(F.format_string("%d°%02d′%02d″", (total / 3600).cast("long"), ((total % 3600) / 60).cast("long"), total % 60), F.when(value < 0, south).otherwise(north))


def year_of(date: Column) -> Column:
    """The year of an ISO date string; null where it is no date."""
    return F.year(F.substring(date, 1, 10).try_cast("date"))


def on_date(stamp: Column, date: str) -> Column:
    """Whether a timestamp, as text or not, falls on an ISO date."""
    return F.substring(stamp.cast("string"), 1, 10) == date


def within_year(date: Column, year: int) -> Column:
    """From the year's first day on, before the next year's."""
    return (date >= F.lit(f"{year}-01-01").cast("date")) & (date < F.lit(f"{year + 1}-01-01").cast("date"))


def year_and_quarter(date: Column) -> Column:
    return F.struct(F.year(date).alias("year"), F.quarter(date).alias("quarter"))


def file_digest(content: Column, bits: int = 256) -> Column:
    """Hexadecimal SHA-2 of a whole binary."""
    return F.sha2(content, bits)


def template_date(c: Column) -> Column:
    """ISO date of the ``{{date|Month D, YYYY}}`` template in a text's first 500 characters, else null."""
    raw = F.regexp_extract(F.substring(c, 1, 500), r"(?i)\{\{\s*date\s*\|\s*([A-Za-z]+ \d{1,2}, \d{4})", 1)
    return F.date_format(F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("MMMM d, yyyy")), "yyyy-MM-dd")


def is_annual(period: Column) -> Column:
    return F.coalesce(period.rlike("^[0-9]{4}$"), F.lit(False))


def number_or_null(c: Column, missing: str = ".") -> Column:
    return F.when(c != missing, c.try_cast("double"))


def json_strings(c: Column) -> Column:
    """Non-empty strings of a JSON array; empty where the text is no array."""
    parsed = F.from_json(c, "array<string>")
    return F.coalesce(F.filter(F.transform(parsed, strip_all), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
