"""Pages: from HTML to lines, to one text, and from places in that text back to the page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spans
from ..operators.automaton import slices

#: Elements that are blocks of their own.
BLOCKS = ["address", "article", "aside", "blockquote", "body", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "thead", "title", "tr", "ul"]
#: At the end of a line these break a word.
HYPHENS = "-­"
_SILENT = r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_PART = re.compile(rf"{_SILENT}|<[a-z/!?][^>]*>|&(?:#\d+|#x[0-9a-f]+|\w+);|\n|[^<&\n]+|.", re.S | re.I)
_TAG = re.compile(r"</?([a-z][a-z0-9]*)\b", re.I)


@dataclass
class Scanned:
    """A page's text; its lines (block, line, where it starts, its text, whether a hyphen at its end was dropped); the pieces of
    the text that stand in the source (from where in the text, from where in the source, how many characters in either); and the
    places of the last characters before a dropped hyphen."""

    text: str = ""
    lines: list[tuple[int, int, int, str, bool]] = field(default_factory=list)
    pieces: list[tuple[int, int, int, int]] = field(default_factory=list)
    wraps: list[int] = field(default_factory=list)


def _lines(source: str) -> Iterator[tuple[bool, list[tuple[int, str, int]]]]:
    """Of each line that isn't blank whether a block starts with it, and its characters' runs: where in the source, the text,
    and how long it is there."""
    runs: list[tuple[int, str, int]] = []
    fresh = True
    for m in _PART.finditer(source):
        s, new_block, new_line = m[0], False, m[0] == "\n"
        if s[0] == "<" and len(s) > 1:
            tag = _TAG.match(s)
            silent = s.startswith("<!--") or (tag and tag[1].lower() in ("script", "style"))
            new_block = bool(tag and not silent and tag[1].lower() in BLOCKS)
            new_line = new_block or bool(tag and tag[1].lower() == "br")
        elif not new_line:
            runs.append((m.start(), html.unescape(s) if s[0] == "&" else s, len(s)))
        if new_line:
            if any(not t.isspace() for _, t, _ in runs):
                yield fresh, runs
                fresh = False
            runs = []
            fresh = fresh or new_block
    if any(not t.isspace() for _, t, _ in runs):
        yield fresh, runs


def _stripped(runs: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The runs without white space at both ends of the line; a run of a character reference is one whole."""
    runs = list(runs)
    while runs[0][1].isspace():
        runs.pop(0)
    while runs[-1][1].isspace():
        runs.pop()
    at, t, n = runs[0]
    if len(t) == n:
        runs[0] = (at + n - len(t.lstrip()), t.lstrip(), len(t.lstrip()))
    at, t, n = runs[-1]
    if len(t) == n:
        runs[-1] = (at, t.rstrip(), len(t.rstrip()))
    return runs


def scan_page(source: str) -> Scanned:
    out, parts, at = Scanned(), [], 0
    block, line, pending = -1, 0, False
    for fresh, runs in _lines(source):
        runs = _stripped(runs)
        block, line = (block + 1, 0) if fresh else (block, line + 1)
        if pending and not fresh:  # a space parts the lines of a block, but after a dropped hyphen
            parts.append(" ")
            at += 1
        start, said = at, "".join(t for _, t, _ in runs)
        wrap = said[-1] in HYPHENS
        if wrap:
            s, t, n = runs.pop()
            if len(t) > 1:
                runs.append((s, t[:-1], n - 1))
            said = said[:-1]
        for s, t, n in runs:
            if out.pieces and sum(out.pieces[-1][::2]) == at and out.pieces[-1][1] + out.pieces[-1][3] == s and out.pieces[-1][2] == out.pieces[-1][3] and len(t) == n:
                a, b, k, _ = out.pieces[-1]
                out.pieces[-1] = (a, b, k + n, k + n)
            else:
                out.pieces.append((at, s, len(t), n))
            at += len(t)
        parts.append(said)
        if wrap and at:
            out.wraps.append(at - 1)
        out.lines.append((block, line, start, said, wrap))
        pending = not wrap and at > 0
    out.text = "".join(parts)
    return out


SCANNED = "text string, lines array<struct<block:int,line:int,start:int,text:string,wrap:boolean>>, pieces array<struct<at:int,source:int,length:int,source_length:int>>, wraps array<int>"


def scan(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id and a page's text, lines, pieces and wraps, as Scanned has them, in code points. Lines end at line feeds and <br>,
    blocks at the tags of BLOCKS; comments, scripts, styles and other tags leave nothing. Lines are stripped, blank ones left
    out; a hyphen at a line's end is dropped and its word goes on with the next line; other lines of a block are parted by one
    space, blocks by nothing. Null pages have an empty text. There is no shuffle."""
    kinds = [pa.string(), pa.list_(pa.struct([("block", pa.int32()), ("line", pa.int32()), ("start", pa.int32()), ("text", pa.string()), ("wrap", pa.bool_())])), pa.list_(pa.struct([(n, pa.int32()) for n in ("at", "source", "length", "source_length")])), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda rows, names: [dict(zip(names, r, strict=True)) for r in rows]
        for b in slices(batches, 1):
            made = [scan_page(t or "") for t in b.column(1).to_pylist()]
            cols = [[m.text for m in made], [named(m.lines, ("block", "line", "start", "text", "wrap")) for m in made], [named(m.pieces, ("at", "source", "length", "source_length")) for m in made], [m.wraps for m in made]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "text", "lines", "pieces", "wraps"])

    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, {SCANNED}")


def located(scanned: DataFrame, found: DataFrame, id_col: str = "page_id", back: bool = False) -> DataFrame:
    """found's id, start and end (end exclusive, in the text) with source_start and source_end: the least stretch of the page's
    source that holds the piece of each character between; the other way round if back: start and end are of the source, and
    text_start and text_end what of the text comes from between. Null where nothing does. A page's spans come to its pieces as
    one array; the pieces are sorted, so each place is found by bisection. Spans of pages that aren't there, or with a null
    place, are left out."""
    spans_of = found.where("start is not null and end is not null").groupBy(id_col).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("_found"))
    rows = scanned.select(id_col, "pieces").join(spans_of, id_col).select(id_col, "pieces", "_found")
    first, last = ("text_start", "text_end") if back else ("source_start", "source_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pieces, asked = b.column(1)[i].values, b.column(2)[i].values
                at, source, n, m = (pieces.field(k).to_numpy().astype(np.int64) for k in range(4))
                (x, nx), (y, ny) = ((source, m), (at, n)) if back else ((at, n), (source, m))
                start, end = asked.field(0).to_numpy().astype(np.int64), asked.field(1).to_numpy().astype(np.int64)
                left = np.searchsorted(x + nx, start, "right")  # the first piece that ends behind the start
                right = np.searchsorted(x, end, "left") - 1  # the last that starts before the end
                there = (left <= right) & (start < end)
                lo, hi = np.minimum(left, max(len(x) - 1, 0)), np.maximum(right, 0)
                if not len(x):
                    there, from_, upto = np.zeros(len(start), bool), start, end
                else:
                    whole = nx == ny  # within other pieces there is no place between
                    from_ = y[lo] + np.where(whole[lo], np.maximum(start - x[lo], 0), 0)
                    upto = y[hi] + np.where(whole[hi], np.minimum(end - x[hi], nx[hi]), ny[hi])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(start), i))), pa.array(start), pa.array(end), pa.array(from_, mask=~there), pa.array(upto, mask=~there)], names=["id", "start", "end", first, last])

    return rows.mapInArrow(run, f"`{id_col}` {scanned.schema[id_col].dataType.simpleString()}, start long, end long, {first} long, {last} long")


def split_at_wraps(scanned: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """found (id, start, end exclusive) cut behind each dropped hyphen, with part_start and part_end."""
    rows = found.join(scanned.select(id_col, F.transform("wraps", lambda w: (w + 1).cast("long")).alias("_wraps")), id_col)
    return spans.split_at(rows, F.col("start").cast("long"), F.col("end").cast("long"), F.col("_wraps")).drop("_wraps")
