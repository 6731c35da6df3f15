"""Reading HTML: a tokenizer in one pass, and the text of a page by blocks.

The tokenizer follows the states of the HTML standard as far as text needs them: comments of all forms, declarations,
attributes with any quotes, raw text of scripts and styles, and what an unclosed tag, quote, comment or script swallows. It
never reads a character more than a few times, whatever the markup. Scripts that hold comments with scripts are not told
apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements of the HTML standard.
#: Elements whose content is text up to their end tag; no character references in the first ones.
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line of text, so that their tags end no block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_TAG = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*")
_SKIP = re.compile(r"[ \t\n\r\f/]*")
_NAME = re.compile(r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
_PLAIN = re.compile(r"[^ \t\n\r\f>]*")
_COMMENT_END = re.compile(r"--!?>")
_END = {name: re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.IGNORECASE) for name in RAW | ESCAPABLE}


def _attributes(html: str, at: int) -> tuple[dict[str, str], int] | None:
    """A tag's attributes and where it ends; None if the text ends first."""
    found: dict[str, str] = {}
    while True:
        at = _SKIP.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return found, at + 1
        m = _NAME.match(html, at)
        name, value, at = m[0].lower(), "", m.end()
        if m := _EQUALS.match(html, at):
            at = m.end()
            if html[at : at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                m = _PLAIN.match(html, at)
                value, at = m[0], m.end()
        found.setdefault(name, unescape(value) if "&" in value else value)


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start", name, attributes) and ("end", name, {}), names in lower case, texts decoded."""
    at = scan = 0
    size = len(html)
    while at < size:
        low = html.find("<", scan)
        if low < 0:
            low = size
        scan = low + 1
        mark = html[low + 1 : low + 2]
        if low < size and not (mark and (mark in "!?/" or mark.isascii() and mark.isalpha())):
            continue  # a sign of its own
        if mark == "/" and low + 2 >= size:
            low = scan = size
        if low > at:
            piece = html[at:low]
            yield "text", unescape(piece) if "&" in piece else piece, {}
        if low >= size:
            return
        if m := _SIMPLE.match(html, low):
            closing, name, attributes, at = m[1], m[2].lower(), {}, m.end()
        elif mark in "!?" or not (html[low + 2].isascii() and html[low + 2].isalpha() if mark == "/" else True):
            at = scan = _after_comment(html, low)
            continue
        else:
            closing = "/" if mark == "/" else ""
            m = _TAG.match(html, low + 1 + len(closing))
            name, read = m[0].lower(), _attributes(html, m.end())
            if read is None:
                return  # the text ends inside a tag
            attributes, at = read
        scan = at
        if closing:
            yield "end", name, {}
            continue
        yield "start", name, attributes
        if name in _END:
            m = _END[name].search(html, at)
            end = m.start() if m else size
            if end > at and name in ESCAPABLE:
                yield "text", unescape(html[at:end]), {}
            at = scan = end


def _after_comment(html: str, low: int) -> int:
    """Where a comment, a declaration or an end tag without a name ends."""
    if html.startswith("<!--", low):
        if html.startswith((">", "->"), low + 4):
            return html.index(">", low + 4) + 1
        m = _COMMENT_END.search(html, low + 4)
        return m.end() if m else len(html)
    end = html.find(">", low + 2)
    return end + 1 if end >= 0 else len(html)


def blocks(html: str) -> list[str]:
    """The texts of a page that a reader sees, in order, a block each: tags of elements that don't stand inside a line end a
    block, white space inside one is a space, <br> too. Titles, templates, and controls of forms have no text."""
    found: list[str] = []
    run: list[str] = []
    hidden = 0
    for kind, name, _ in tokens(html):
        if kind == "text":
            if not hidden:
                run.append(name)
            continue
        if name in _HIDDEN:
            hidden = max(0, hidden + (1 if kind == "start" else -1))
        if name == "br":
            run.append(" ")
        elif name not in INLINE:
            found.append(" ".join("".join(run).split()))
            run = []
    found.append(" ".join("".join(run).split()))
    return [x for x in found if x]


_HIDDEN = frozenset("title textarea template select".split())


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, html = batch.columns
        found = pa.array(["\n".join(blocks(x.as_py() or "")) for x in html], pa.string())
        yield pa.RecordBatch.from_arrays([*kept, found], names=[*batch.schema.names[:-1], "text"])


def html_to_text(df: DataFrame, html: str | Column, keep: list[str]) -> DataFrame:
    """The columns to keep and `text`, the blocks of a page's text by line; null and empty pages have an empty text."""
    column = F.col(html) if isinstance(html, str) else html
    rows = df.select(*keep, column.alias("__html"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_text, f"{kept}, text string" if kept else "text string")
