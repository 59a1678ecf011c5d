"""Bytes to text and markup to visible text, in one pass over a page however broken it is."""

from __future__ import annotations

import codecs
import html
import html.entities
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content isn't visible text; of the first two anything up to the end tag is content.
RAW, HIDDEN = ("script", "style"), ("noscript", "svg", "template", "iframe")
#: Bytes of a page in which it may name its own encoding.
HEAD_BYTES = 2048

_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE) for name in RAW}
_STOP = re.compile("[>\"']")
_BLANKS = re.compile(r"\s+")
_CLOSED = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);")
_CHARSET = re.compile(rb"""<meta\b[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)|<\?xml\b[^>]*?encoding\s*=\s*["']([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decoded(body: bytes, content_type: str | None) -> str:
    """Text of a body: by its byte order mark, else the charset of its content type, else what its head names, else
    UTF-8. Encodings that aren't known count as not named; bytes that don't fit become U+FFFD."""
    for mark, name in _MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    said = re.search(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", content_type or "", re.IGNORECASE)
    head = _CHARSET.search(body[:HEAD_BYTES])
    for name in (said and said[1], head and (head[1] or head[2]).decode("ascii")):
        if name:
            try:
                if codecs.lookup(name)._is_text_encoding:
                    return body.decode(name, "replace")
            except (LookupError, UnicodeError):
                continue
    return body.decode("utf-8", "replace")


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that is open at a place ends: behind the next `>` outside quotes, or at the end of the page."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        closed = last[m[0]] >= m.end()
        at = page.index(m[0], m.end()) + 1 if closed else m.end()
    return len(page)


def _past(page: str, sign: str, at: int) -> int:
    """Behind the next such sign, or the end of the page."""
    found = page.find(sign, at)
    return len(page) if found < 0 else found + len(sign)


def _closed_only(text: str) -> str:
    """Entities read that end with their semicolon; `&amp` without one stays as it is."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html.entities.html5.get(m[0][1:], m[0]), text)


def visible(page: str, closed: bool = False) -> tuple[str, str]:
    """(title, text): each stretch of text between tags, entities read, joined by blanks; the first title is both.

    A `<` that begins no tag, comment or declaration is text. A `>` within quotes doesn't end a tag; a quote that is
    never closed doesn't count. `closed`: only entities that end with a semicolon are read. What is hidden ends with the end tag of the element that began it, nested ones of its
    name counted, or with the page. Every step goes forward, so the work grows with the length alone.
    """
    out: list[str] = []
    run: list[str] = []  # text since the last tag
    titled: list[int] = []
    last = {q: page.rfind(q) for q in "\"'"}
    hidden, depth, at = "", 0, 0
    while at < len(page):
        start = page.find("<", at)
        start = len(page) if start < 0 else start
        name = _NAME.match(page, start + 1)
        declared = page.startswith(("<!", "<?"), start)
        begins = name or declared or start == len(page)
        if not hidden:
            run.append(page[at : start + (0 if begins else 1)])
        if not begins:
            at = start + 1
            continue
        out.append("".join(run))
        run.clear()
        if page.startswith("<!--", start):
            at = _past(page, "-->", start + 4)
        elif declared:
            at = _past(page, ">", start)
        elif name:
            at, closing, tag = _tag_end(page, name.end(), last), page[start + 1] == "/", name[1].lower()
            alone = page[at - 2 : at] == "/>"
            if hidden:
                depth += 0 if tag != hidden or alone else -1 if closing else 1
                hidden = hidden if depth else ""
            elif tag in HIDDEN and not closing and not alone:
                hidden, depth = tag, 1
            elif tag == "title" and len(titled) == (1 if closing else 0):
                titled.append(len(out))
            if tag in RAW and not closing:
                end = _ENDS[tag].search(page, at)
                at = end.start() if end else len(page)
        else:
            at = len(page)
    out.append("".join(run))
    entities = _closed_only if closed else html.unescape
    blank = lambda parts: _BLANKS.sub(" ", entities(" ".join(parts))).strip()
    return blank(out[slice(*[*titled, len(out)][:2])]) if titled else "", blank(out)


def visible_text(closed: bool = False) -> Callable[[Column], Column]:
    """`visible` of each page; null for null."""

    @F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
    def shown(page: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None else visible(x, closed) for x in page]
        return pd.DataFrame({"title": [a for a, _ in got], "text": [b for _, b in got]}, dtype="object")

    return shown


@F.pandas_udf(T.StringType())
def decoded_text(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """`decoded` of each body; null for null."""
    return pd.Series([None if b is None else decoded(bytes(b), c) for b, c in zip(body, content_type, strict=True)], dtype="object")
