"""Chunking of prose, Markdown and paged text; Arrow batches around a small splitter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import runs

SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


@dataclass(frozen=True)
class Profile:
    """Target size, hard cap and overlap in characters."""

    size: int
    cap: int
    overlap: int

    def __post_init__(self):
        if self.size < 1 or self.cap < self.size or not 0 <= self.overlap < self.size:
            raise ValueError("need 1 <= size <= cap and 0 <= overlap < size")


# Profiles by kind of corpus.
DEFAULT = Profile(1500, 1800, 150)
DENSE = Profile(1000, 1200, 100)
LONG_FORM = Profile(2000, 2400, 300)
WIKI = Profile(800, 1000, 100)


def tidy(text: str) -> str:
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _pieces(text: str, by: str) -> list[str]:
    """Cut before each separator; the separator opens the next piece."""
    if not by:
        return list(text)
    cuts = [m.start() for m in re.finditer(re.escape(by), text)]
    edges = [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:]) if a < b]


def _join(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces up to ``size``; each begins with the end of the one before, up to ``overlap``."""
    held: list[str] = []
    total = 0
    for p in pieces:
        if held and total + len(p) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        yield "".join(held)


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks at the coarsest separator in the text; longer pieces are cut at finer ones."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), None)
    if at is None:
        return [text] if text.strip() else []
    finer = separators[at + 1 :]
    out: list[str] = []
    small: list[str] = []
    for p in [*_pieces(text, separators[at]), None]:
        if p is not None and len(p) < size:
            small.append(p)
            continue
        out += [c.strip() for c in _join(small, size, overlap)]
        small = []
        if p is not None:
            out += split(p, size, overlap, finer) if finer else [p.strip()]
    return [c for c in out if c]


def chunk_text(text: str, profile: Profile) -> list[str]:
    found = []
    for c in split(tidy(text or ""), profile.size, profile.overlap):
        parts = [c] if len(c) <= profile.cap else split(c, profile.cap, 0, (" ", ""))
        found += [t for t in map(tidy, parts) if t]
    return found


def sections(markdown: str, default: str | None = None) -> list[tuple[str | None, str]]:
    """(label, body) between headings of levels 2 to 4; the label is the outermost open heading.

    Headings inside fenced code count as text.
    """
    open_: dict[int, str] = {}
    out: list[tuple[str | None, list[str]]] = [(default, [])]
    fence = None
    for line in markdown.split("\n"):
        bare = line.strip()
        if fence is None and bare[:3] in ("```", "~~~"):
            fence = bare[:3]
        elif fence and bare.startswith(fence):
            fence = None
        head = None if fence else re.match(r"(#{2,4})(?:\s+(.*))?$", bare)
        if head:
            level = len(head[1])
            open_ = {k: v for k, v in open_.items() if k < level} | {level: (head[2] or "").strip()}
            out.append((open_[min(open_)] or default, []))
        else:
            out[-1][1].append(line)
    return [(label, body) for label, lines in out if (body := "\n".join(lines)).strip()]


def chunk_markdown(text: str, profile: Profile, default: str | None = None) -> list[tuple[str | None, str]]:
    return [(label, c) for label, body in sections(text or "", default) for c in chunk_text(body, profile)]


def chunk_pages(text: str, profile: Profile) -> list[tuple[str, str]]:
    """Pages end at form feeds; empty pages keep their numbers."""
    return [(f"p. {n}", c) for n, p in enumerate((text or "").split("\f"), 1) for c in chunk_text(p, profile)]


def chunks(docs: DataFrame, kind: str = "text", profile: Profile = DEFAULT, doc: str = "doc_id", text: str = "text", section: str | None = None) -> DataFrame:
    """(doc_id, section, chunk_index, text, text_length); documents without text give no rows."""
    if kind not in ("text", "markdown", "pages"):
        raise ValueError(kind)

    def pieces(t: str | None, label: str | None) -> list[tuple[str | None, str]]:
        return chunk_markdown(t, profile, label) if kind == "markdown" else chunk_pages(t, profile) if kind == "pages" else [(label, c) for c in chunk_text(t, profile)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n in runs(len(batch)):
                part = batch.slice(begin, n)
                rows = [(at, i, s, c) for at, (t, label) in enumerate(zip(part.column("t").to_pylist(), part.column("label").to_pylist())) for i, (s, c) in enumerate(pieces(t, label))]
                if rows:
                    at, i, s, c = zip(*rows)
                    columns = [part.column("doc_id").take(pa.array(at)), pa.array(s, pa.string()), pa.array(i, pa.int32()), pa.array(c, pa.string()), pa.array(list(map(len, c)), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "chunk_index", "text", "text_length"])

    label = F.col(section) if section else F.lit(None).cast("string")
    given = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("t"), label.alias("label"))
    return given.mapInArrow(cut, f"doc_id {dict(given.dtypes)['doc_id']}, section string, chunk_index int, text string, text_length int")
