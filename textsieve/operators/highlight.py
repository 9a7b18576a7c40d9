"""Highlights: overlapping matches cut into disjoint coloured pieces, and texts marked with them."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .automaton import slices


def pieces(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, color, title, n and titles: the text that matches (start, end in characters, end exclusive; ord,
    color, title) cover, cut at each place where one of them starts or ends. A piece has the color and title of the match
    that was laid on it last, that is of the greatest (start, ord, end, title); n matches cover it, whose distinct titles are
    `titles`, sorted. Matches that share no character don't meet: each chain of overlapping ones is swept by itself, with the
    places where it is cut in one array. Empty matches and rows with a null place are left out."""
    rows = matches.where("start < end").select(key, "start", "end", "ord", "color", "title")
    chained = spans.clusters(rows.withColumnsRenamed({"start": "start_pos"}).withColumn("end_pos", F.col("end") - 1).withColumn("span_id", F.struct("ord", "title")), key)
    # in place, as a join would compute the matches twice
    cuts = F.array_distinct(F.flatten(F.collect_list(F.array("start_pos", "end")).over(Window.partitionBy(key, "cluster"))))
    cut = spans.split_at(chained.withColumn("_cuts", cuts), F.col("start_pos"), F.col("end"), F.col("_cuts"))
    last = F.max(F.struct("start_pos", "ord", "end", "title", "color")).alias("_last")
    swept = cut.groupBy(key, "part_start", "part_end").agg(last, F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("title")).alias("titles"))
    return swept.select(key, F.col("part_start").alias("start"), F.col("part_end").alias("end"), "_last.color", "_last.title", "n", "titles")


def by_runs(cut: DataFrame, runs: DataFrame, key: str = "doc_id", size: int = 1000) -> DataFrame:
    """Pieces (start, end) cut at the bounds of runs (run, run_start, run_end; ends exclusive) of the same text: a row for each
    run and piece that overlap, with the run and the place in it, from_char and to_char, end exclusive."""
    a = cut.withColumn("a_start", F.col("start")).withColumn("a_end", F.col("end") - 1)
    b = runs.where("run_start < run_end").select(key, "run", F.col("run_start").alias("b_start"), (F.col("run_end") - 1).alias("b_end"))
    met = spans.overlapping(a, b, key, size)
    first, last = spans.intersection(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return met.withColumn("from_char", first - F.col("b_start")).withColumn("to_char", last - F.col("b_start") + 1).drop("a_start", "a_end", "b_start", "b_end")


def marked(docs: DataFrame, cut: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and html: the escaped text with each of its pieces (start, end, color, title) in a <mark>. Texts without
    pieces are escaped only, null ones stay null. A document's pieces come to it as one array, a text moves once."""
    per_text = cut.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "color", "title"))).alias("_p"))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_t")).join(per_text, id_col, "left").select(id_col, "_t", "_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for p in found or []:
                    parts.append(html.escape(text[at : p["start"]]))
                    parts.append(f'<mark style="background:{p["color"]}" title="{html.escape(p["title"])}">{html.escape(text[p["start"] : p["end"]])}</mark>')
                    at = p["end"]
                out.append(None if text is None else "".join([*parts, html.escape(text[at:])]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "html"])

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, html string")
