"""HTML and wiki markup to text and Markdown; parsers per document inside Arrow-batched UDFs."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from .arrow import text_udf

# Elements without visible text, sections without prose.
SILENT = {"script", "style", "head", "template", "noscript"}
VOID = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "source", "wbr"}
BLOCK = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "figure", "main", "header", "footer", "nav", "aside"}
NAVIGATION = {"related pages", "other websites", "see also", "external links", "references", "notes", "further reading", "bibliography", "footnotes", "citations"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data):
        self.out.append(data)


def html_text(s: str | None) -> str | None:
    """Text of every node, joined by spaces; a text without markup is returned as it is."""
    if not s or ("<" not in s and "&" not in s):
        return s
    p = _Text()
    p.feed(s)
    p.close()
    return html.unescape(" ".join(p.out))


class _Markdown(HTMLParser):
    """Blocks as Markdown; a stack of open inline wrappers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = self.pre = 0
        self.in_head = False
        self.links: list[str] = []
        self.lists: list[list] = []
        self.cells: list[str] | None = None
        self.rows = 0
        self.inline = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "tt": "`"}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.in_head and (tag == "body" or tag in BLOCK or tag in self.inline or re.fullmatch("h[1-6]", tag)):
            self.silent, self.in_head = 0, False  # the end tag of head may be left out
        if tag == "head":
            self.in_head = True
        if tag in SILENT:
            self.silent += 1
        if self.silent:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append(f"\n\n{'#' * int(tag[1])} ")
        elif tag == "math":
            tex = a.get("alttext") or ""
            self.out.append(f"\n\n$${tex}$$\n\n" if a.get("display") == "block" else f"${tex}$")
            self.silent += 1
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in self.inline and not self.pre:
            self.out.append(self.inline[tag])
        elif tag == "a":
            href = a.get("href") or ""
            self.links.append("" if href.startswith("#") else href)
            if self.links[-1]:
                self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + ("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "))
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
            self.rows += self.cells is None
            self.cells = (self.cells or []) + [tag]
        elif tag == "br":
            self.out.append("\n")
        elif tag in BLOCK and tag != "tr":
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag == "head":
            self.silent, self.in_head = (0, False) if self.in_head else (self.silent, False)
            return
        if tag in SILENT or tag == "math":
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in self.inline and not self.pre:
            self.out.append(self.inline[tag])
        elif tag == "a" and self.links:
            href = self.links.pop()
            if href:
                self.out.append(f"]({href})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr" and self.cells is not None:
            self.out.append("|\n" + ("|" + " --- |" * len(self.cells) + "\n" if self.rows == 1 else ""))
            self.cells = None
        elif tag in BLOCK:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_markdown(s: str | None) -> str | None:
    """Markdown of an HTML page: headings, lists, tables, links, emphasis, math and code; one line end at the end."""
    if s is None:
        return None
    p = _Markdown()
    p.feed(s)
    p.close()
    lines, fenced = [], False
    for line in "".join(p.out).split("\n"):
        if line.strip() == "```":
            fenced = not fenced
        lines.append(line.rstrip() if fenced or re.match(r"\s*(-|\d+\.) ", line) else line.strip())
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return text + "\n" if text else ""


def _without_templates(s: str) -> str:
    """Without templates and what is nested in them, in one pass; braces that don't close stay."""
    kept = [[]]
    for piece in re.split(r"(\{\{|\}\})", s):
        if piece == "{{":
            kept.append([])
        elif piece == "}}" and len(kept) > 1:
            kept.pop()
        else:
            kept[-1].append(piece)
    return "{{".join("".join(x) for x in kept)


def _wiki_plain(s: str) -> str:
    s = re.sub(r"(?s)<!--.*?-->", "", s)
    s = re.sub(r"(?is)<(ref|references|gallery)\b[^>]*?(/>|>.*?</\1\s*>)", "", s)
    s = _without_templates(s)
    s = re.sub(r"(?s)\{\|.*?\|\}", "", s)
    s = re.sub(r"(?i)\[\[\s*(?:file|image|media|category)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?:)?//\S+\s*([^\]]*)\]", r"\1", s)
    s = re.sub(r"'{2,5}", "", s)
    s = re.sub(r"<[^>]+>", "", s)
    return re.sub(r"\n{3,}", "\n\n", html.unescape(s)).strip()


def wiki_markdown(s: str | None) -> str:
    """Markdown of a wiki text: headings of levels 2 to 6, plain bodies; redirects give nothing.

    The lead gets the heading Introduction where sections follow; sections
    without prose (see ``NAVIGATION``) are left out.
    """
    if not s or re.match(r"(?i)\s*#\s*redirect\s*\[\[", s):
        return ""
    # Odd items: the marks of a heading, then its title; then the body below it.
    parts = re.split(r"(?m)^(={2,6})\s*(.+?)\s*\1\s*$", s)
    lead = _wiki_plain(parts[0])
    if len(parts) == 1:
        return lead
    out = [f"## Introduction\n\n{lead}"] if lead else []
    for marks, title, body in zip(parts[1::3], parts[2::3], parts[3::3]):
        if title.strip().lower() in NAVIGATION:
            continue
        out.append("\n\n".join(x for x in (f"{'#' * len(marks)} {title.strip()}", _wiki_plain(body)) if x))
    return "\n\n".join(out)


# What a rendered paper has besides its text, by element and by class.
PAPER_SILENT = {"nav", "header", "footer", "script", "style", "h1"}
PAPER_SILENT_CLASSES = {"ltx_TOC", "ltx_page_navbar", "ltx_dates", "ltx_authors", "ltx_title_document"}
FONTS = {"ltx_font_bold": "**", "ltx_font_italic": "*", "ltx_font_typewriter": "`"}


class _Open:
    """An element whose end hasn't come: its rendered and raw text so far, and what its parts left for it."""

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.classes = tag, attrs, set((attrs.get("class") or "").split())
        self.text, self.raw, self.items = [], [], []

    def flat(self) -> str:
        return " ".join("".join(self.text).split())


class _Paper(HTMLParser):
    """Markdown of a paper that LaTeXML rendered: each element is rendered when it ends, from what its parts became."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("", {})]
        self.article = self.body = None

    def handle_data(self, data):
        self.stack[-1].text.append(data)
        self.stack[-1].raw.append(data)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.stack[-1].text.append("\n")
        elif tag not in VOID:
            if tag in ("li", "p", "tr", "td", "th") and self.stack[-1].tag == tag:
                self.finish()  # end tags that may be left out
            self.stack.append(_Open(tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(x.tag == tag for x in self.stack[1:]):
            while self.stack[-1].tag != tag:
                self.finish()
            self.finish()

    def finish(self):
        done, above = self.stack.pop(), self.stack[-1]
        if done.tag in PAPER_SILENT or done.classes & PAPER_SILENT_CLASSES:
            return
        above.raw += done.raw
        rendered = self.render(done)
        if done.tag in ("td", "th", "li", "figcaption"):
            near = {"li": ("ul", "ol"), "figcaption": ("figure",)}.get(done.tag, ("tr",))
            owner = next((x for x in reversed(self.stack) if x.tag in near), None)
            if owner is not None and (done.tag != "figcaption" or not owner.items):
                owner.items.append(rendered)
                return
        if done.tag == "tr":
            table = next((x for x in reversed(self.stack) if x.tag == "table"), None)
            if table is not None and done.items:
                table.items.append(done.items)
            return
        if done.tag == "a":
            for x in self.stack:
                if x.tag == "cite":
                    x.items.append(" ".join("".join(done.raw).split()))
        if "ltx_tag" in done.classes and any(re.fullmatch("h[2-6]", x.tag) for x in self.stack):
            return
        above.text.append(rendered)
        if done.tag == "article" and "ltx_document" in done.classes and self.article is None:
            self.article = rendered
        if done.tag == "body" and self.body is None:
            self.body = rendered

    def render(self, x: _Open) -> str:
        whole, raw, flat = "".join(x.text), "".join(x.raw), x.flat()
        if x.tag == "math":
            mark = "$$" if x.attrs.get("display") == "block" else "$"
            tex = x.attrs.get("alttext")
            return f"{mark}{raw if tex is None else tex}{mark}"
        if re.fullmatch("h[2-6]", x.tag):
            level = 2 if "ltx_title_abstract" in x.classes else int(x.tag[1])
            return f"\n{'#' * level} {flat}\n\n" if flat else ""
        if x.tag in ("td", "th"):
            return flat.replace("|", r"\|")
        if x.tag in ("li", "figcaption"):
            return flat
        if x.tag in ("ul", "ol"):
            marks = (f"{n}." if x.tag == "ol" else "-" for n in range(1, len(x.items) + 1))
            return "\n" + "".join(f"{m} {item}\n" for m, item in zip(marks, x.items)) + "\n"
        if x.tag == "table":
            width = max(map(len, x.items), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in x.items]
            return "\n".join(["", lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:], ""]) if lines else ""
        if x.tag == "figure":
            return "".join(f"\n*{c}*\n\n" for c in x.items) + whole
        if x.tag == "cite":
            return f"[{', '.join(x.items)}]" if x.items else ""
        if x.tag == "a":
            href = x.attrs.get("href") or ""
            return f"[{flat}]({href})" if href and not href.startswith("#") else flat
        if x.tag == "pre":
            return f"\n```\n{raw}\n```\n\n"
        if x.tag == "code":
            return f"`{raw}`"
        if x.tag == "p":
            return whole + "\n\n"
        mark = next((m for name, m in FONTS.items() if name in x.classes), "")
        return f"{mark}{whole}{mark}"


def paper_markdown(s: str | None) -> str | None:
    """Markdown of a paper rendered by LaTeXML: no title, authors or page furniture, formulas as TeX, one line end at the end."""
    if s is None:
        return None
    p = _Paper()
    p.feed(s)
    p.close()
    while len(p.stack) > 1:
        p.finish()
    text = next(x for x in (p.article, p.body, "".join(p.stack[0].text)) if x is not None)
    lines = "\n".join(line.rstrip() for line in text.splitlines())
    return re.sub(r"\n{3,}", "\n\n", lines).strip() + "\n"


def _decode(content) -> str | None:
    """UTF-8, a leading byte order mark dropped; else Latin-1."""
    if content is None:
        return None
    try:
        return bytes(content).decode("utf-8-sig")
    except UnicodeDecodeError:
        return bytes(content).decode("latin-1")


html_to_text, html_to_markdown, wiki_to_markdown, paper_to_markdown = text_udf(html_text), text_udf(html_markdown), text_udf(wiki_markdown), text_udf(paper_markdown)
decode_text = text_udf(_decode)
