"""Documents from files: DOCX, ODT and plain text, as lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import accumulate
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import highlight

_DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ODT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def docx_paragraphs(data: bytes) -> list[str]:
    """Paragraphs of the body, then those of tables, row by row."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_DOCX}body")
    said = lambda p: "".join(t.text or "" for t in p.iter(f"{_DOCX}t"))
    return [said(p) for p in body.findall(f"{_DOCX}p")] + [said(p) for t in body.findall(f"{_DOCX}tbl") for p in t.iter(f"{_DOCX}p")]


def odt_paragraphs(data: bytes) -> list[str]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    return [x for p in root.iter(f"{_ODT}p") if (x := "".join(p.itertext())).strip()]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of the .docx, .odt and .txt files; a file that can't be read has no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = docx_paragraphs(data) if name.endswith(".docx") else odt_paragraphs(data) if name.endswith(".odt") else data.decode("utf-8-sig").splitlines()
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError):
                    found = []
                rows += [(name, i, x) for i, x in enumerate(y.strip() for y in found) if x]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "line_no", "line"])

    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(docx|odt|txt)$")).select("path", "content")
    return files.mapInArrow(run, "path string, line_no long, line string")


def _run_text(run: ElementTree.Element) -> str:
    """A run's text, with its tabs and breaks."""
    said = {f"{_DOCX}tab": "\t", f"{_DOCX}br": "\n", f"{_DOCX}cr": "\n", f"{_DOCX}noBreakHyphen": "-"}
    return "".join(c.text or "" if c.tag == f"{_DOCX}t" else said.get(c.tag, "") for c in run)


def docx_segments(data: bytes) -> Iterator[tuple[str, list[str]]]:
    """Kind (paragraph, link) and runs of each stretch of text that is searched by itself: a paragraph's own runs together, each
    of its links by itself; first the body's paragraphs, then those of its tables, row by row and cell by cell. Paragraphs
    without runs of their own have none."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_DOCX}body")
    cells = (p for t in body.findall(f"{_DOCX}tbl") for r in t.findall(f"{_DOCX}tr") for c in r.findall(f"{_DOCX}tc") for p in c.findall(f"{_DOCX}p"))
    for p in [*body.findall(f"{_DOCX}p"), *cells]:
        for kind, element in [("paragraph", p), *(("link", x) for x in p.findall(f"{_DOCX}hyperlink"))]:
            if runs := [_run_text(r) for r in element.findall(f"{_DOCX}r")]:
                yield kind, runs


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    """segment_id (path and number), path, segment, kind, text and runs (array<struct<run, run_start, run_end>>, ends exclusive)
    of the .docx files, as docx_segments has them. A file that can't be read has none."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.struct([(n, pa.int32()) for n in ("run", "run_start", "run_end")]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for n, (kind, runs) in enumerate(docx_segments(data)):
                        ends = list(accumulate(map(len, runs)))
                        rows.append((f"{name}#{n}", name, n, kind, "".join(runs), [{"run": i, "run_start": e - len(t), "run_end": e} for i, (t, e) in enumerate(zip(runs, ends, strict=True))]))
                except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError):
                    pass
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["segment_id", "path", "segment", "kind", "text", "runs"])

    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".docx")).select("path", "content")
    return files.mapInArrow(run, "segment_id string, path string, segment int, kind string, text string, runs array<struct<run:int,run_start:int,run_end:int>>")


def run_pieces(segments: DataFrame, cut: DataFrame) -> DataFrame:
    """The pieces (highlight.pieces by segment_id) of segments' texts cut at the bounds of their runs: a row for each run and
    piece that overlap, with run, from_char and to_char in it."""
    runs = segments.select("segment_id", F.explode("runs").alias("r")).select("segment_id", "r.*")
    return highlight.by_runs(cut, runs, "segment_id")
