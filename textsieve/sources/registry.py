"""Registry files: tables under two lines of title, as CSV or XLSX."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line of the header, counted from 1; data follow it. Headers have at most so many columns.
HEADER_ROW, MOST_COLUMNS = 3, 200
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _columns(header: list[str | None], header_map: dict[str, str] | None) -> list[tuple[int, str]]:
    """Place and name of the columns that are kept: those that the map has, by their trimmed headers; without a map all that
    have one. Empty headers at the end are none, of equal names the first counts."""
    kept: dict[str, int] = {}
    known = {k.strip(): v for k, v in header_map.items()} if header_map is not None else None
    for i, label in enumerate(header[:MOST_COLUMNS]):
        label = (label or "").strip()
        name = known.get(label) if known is not None else label or None
        if name:
            kept.setdefault(name, i)
    return [(i, name) for name, i in kept.items()]


def _table(parts: list[tuple[DataFrame, list[tuple[int, str]]]], keep: list[str]) -> DataFrame:
    """Rows with `cells` as columns: blank cells null, rows of nulls only left out; columns that a file lacks are null."""
    made = []
    for rows, columns in parts:
        cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
        made.append(rows.select(*keep, *(cell(i).alias(name) for i, name in columns)).dropna("all", subset=[name for _, name in columns]) if columns else rows.select(*keep).limit(0))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def read_csv(spark: SparkSession, path: str, header_map: dict[str, str] | None = None, sep: str = ";") -> DataFrame:
    """path and the columns of the files: cells parted by `sep`, quoted where they hold it; the header in line HEADER_ROW, by
    header_map (label to column; others are left out) if given. Files are split and read by Spark as lines, so a cell holds
    no line feed; a file's first lines are those with the least numbers in its first block. Files may differ in their headers,
    which alone come to the driver. Files with fewer lines have no rows."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("_head"), F.monotonically_increasing_id().alias("_n"))
    firsts = lines.where("_head").groupBy("path").agg(F.min("_n").alias("_first"))
    placed = lines.join(firsts, "path").withColumn("_at", F.when(F.col("_head"), F.col("_n") - F.col("_first") + 1))
    headers = placed.where(F.col("_at") == HEADER_ROW).select("path", F.col("value").alias("_header"))
    told = [r["_header"] for r in headers.select("_header").distinct().orderBy("_header").collect()]
    data = placed.where(F.col("_at").isNull() | (F.col("_at") > HEADER_ROW)).join(headers, "path")
    if not told:
        return lines.select("path").limit(0)
    parsed = lambda c, n: F.from_csv(c, ", ".join(f"c{i} string" for i in range(n)), {"sep": sep, "ignoreLeadingWhiteSpace": "false"})
    parts = []
    for h in told:
        names = _split(h, sep)
        cells = parsed("value", len(names))
        rows = data.where(F.col("_header") == h).select("path", F.array(*(cells[f"c{i}"] for i in range(len(names)))).alias("cells"))
        parts.append((rows, _columns(names, header_map)))
    return _table(parts, ["path"])


def _split(line: str, sep: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿").rstrip("\r")], delimiter=sep), [])


def sheet_rows(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """Number and cells of the rows of a workbook's first sheet, read as a stream; strings that cells share are held."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if e.tag == f"{_SHEET}si":
                shared.append("".join(t.text or "" for t in e.iter(f"{_SHEET}t")))
                e.clear()
    names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    before = 0
    for _, e in ElementTree.iterparse(book.open(names[0])):
        if e.tag != f"{_SHEET}row":
            continue
        cells: list[str | None] = []
        for c in e.findall(f"{_SHEET}c"):
            place = re.match(r"[A-Z]+", c.get("r") or "")
            at = reduce(lambda n, x: n * 26 + ord(x) - 64, place[0], 0) - 1 if place else len(cells)
            v, kind = c.find(f"{_SHEET}v"), c.get("t")
            said = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            cells += [None] * (at - len(cells)) + [said]
        before = int(e.get("r") or before + 1)
        yield before, cells
        e.clear()


def read_xlsx(spark: SparkSession, path: str, header_map: dict[str, str] | None = None) -> DataFrame:
    """As read_csv, of the first sheets of .xlsx files; a task holds one file. A file that is no workbook has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple[int, list[str | None]]] = []
                try:
                    for r in sheet_rows(data):
                        rows.append(r)
                        if len(rows) >= 5000:
                            yield batch(name, rows)
                            rows = []
                except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError):
                    rows = []
                yield batch(name, rows)

    def batch(name: str, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["path", "row_no", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInArrow(run, "path string, row_no long, cells array<string>")
    headers = rows.where(F.col("row_no") == HEADER_ROW).select("path", F.col("cells").alias("_header"))
    told = [r["_header"] for r in headers.select("_header").distinct().orderBy("_header").collect()]
    if not told:
        return rows.select("path").limit(0)
    data = rows.where(F.col("row_no") > HEADER_ROW).join(headers, "path")
    same = lambda h: F.to_json("_header") == F.to_json(F.array(*(F.lit(x).cast("string") for x in h)))  # noqa: E731  (nulls are equal)
    return _table([(data.where(same(h)), _columns(h, header_map)) for h in told], ["path"])
