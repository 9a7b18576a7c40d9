"""Spans, pages and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersection(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Of [a, b] and [c, d], both ends included; nulls if they are apart."""
    meet = F.greatest(a, c) <= F.least(b, d)
    return F.when(meet, F.greatest(a, c)), F.when(meet, F.least(b, d))


def hull(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """The least interval that holds [a, b] and [c, d], whether they meet or not."""
    return F.least(a, c), F.greatest(b, d)


def page_offsets(pages: DataFrame, key: str, order: str, length: Column) -> DataFrame:
    """pages with `offset`: where each starts if all are joined by one space."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("offset", (F.sum(length + 1).over(upto) - (length + 1)).cast("long"))


def in_buckets(df: DataFrame, start: Column, end: Column, size: int, name: str = "_bucket") -> DataFrame:
    """A row for each bucket of `size` positions that [start, end] touches: overlap joins become equi-joins on these."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def overlapping(a: DataFrame, b: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Pairs of spans of a (a_start, a_end) and b (b_start, b_end) with the same key that overlap, each pair once: in the
    bucket where the later of the two starts."""
    joined = in_buckets(a, F.col("a_start"), F.col("a_end"), size).join(in_buckets(b, F.col("b_start"), F.col("b_end"), size), [key, "_bucket"])
    return joined.where("a_start <= b_end and b_start <= a_end").where(F.floor(F.greatest("a_start", "b_start") / size) == F.col("_bucket")).drop("_bucket")


def clusters(df: DataFrame, key: str) -> DataFrame:
    """df (start_pos, end_pos) with `cluster`, from 0: spans that overlap, directly or by way of others."""
    order = Window.partitionBy(key).orderBy("start_pos", "end_pos", "span_id")
    before = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("_new", F.when(before.isNull() | (F.col("start_pos") > before), 1).otherwise(0))
    return new.withColumn("cluster", (F.sum("_new").over(order) - 1).cast("long")).drop("_new")


def split_at(df: DataFrame, start: Column, end: Column, points: Column) -> DataFrame:
    """Spans [start, end) cut at the points inside: a row for each piece, with part_start and part_end."""
    inside = F.array_sort(F.array_distinct(F.filter(points, lambda p: (p > start) & (p < end))))
    cuts = F.concat(F.array(start), inside, F.array(end))
    pieces = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("part_start"), b.alias("part_end")))
    return df.select("*", F.explode(pieces).alias("_p")).select(*df.columns, "_p.*")


def join_hyphenated(words: DataFrame) -> DataFrame:
    """OCR words (page, block, par, line, word_num, text, conf, left, width, height): one that ends in a hyphen takes in the
    first word of the next line of its paragraph. A word that was taken in takes in none, so in a run of such words every
    other one does."""
    at = Window.partitionBy("page").orderBy("block", "par", "line", "word_num")
    following = F.lead(F.struct("block", "par", "line", "word_num", "text", "conf", "left", "width", "height")).over(at)
    near = (F.col("_n.block") == F.col("block")) & (F.col("_n.par") == F.col("par")) & (F.col("_n.line") == F.col("line") + 1) & (F.col("_n.word_num") == 1)
    rows = words.withColumn("_n", following).withColumn("_i", F.row_number().over(at))
    rows = rows.withColumn("_opens", F.coalesce(F.col("text").endswith("-") & (F.char_length("text") > 1) & near, F.lit(False)))
    closed = F.coalesce(F.max(F.when(~F.col("_opens"), F.col("_i"))).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_joins", F.col("_opens") & ((F.col("_i") - closed) % 2 == 1))
    rows = rows.withColumn("_gone", F.coalesce(F.lag("_joins").over(at), F.lit(False))).where("not _gone")
    merged = {
        "text": F.concat(F.expr("left(text, length(text) - 1)"), F.col("_n.text")),
        "conf": F.least("conf", "_n.conf"),
        "width": F.col("_n.left") + F.col("_n.width") - F.col("left"),
        "height": F.greatest("height", "_n.height"),
    }
    return rows.select(*(F.when(F.col("_joins"), merged[c]).otherwise(F.col(c)).alias(c) if c in merged else F.col(c) for c in words.columns))


def resolve_overlaps(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The matches (start_word, end_word, kind, by_lemma, phrase) of each key that stay if none may share a word with one
    that comes before it: phrases before words, longer ones first, those found by lemma first, then by place. Only matches
    that overlap, directly or by way of others, are weighed against each other, so a group is as long as such a chain."""
    rows = clusters(matches.withColumn("start_pos", F.col("start_word")).withColumn("end_pos", F.col("end_word")).withColumn("span_id", F.col("phrase")), key)
    rank = F.struct(
        F.when(F.col("kind") == "phrase", 0).otherwise(1).alias("r0"), (F.col("start_word") - F.col("end_word")).alias("r1"), F.when(F.col("by_lemma"), 0).otherwise(1).alias("r2"),
        F.col("start_word").alias("s"), F.col("phrase").alias("phrase"), F.col("end_word").alias("e"), F.col("kind").alias("kind"), F.col("by_lemma").alias("by_lemma"),
    )
    ranked = rows.groupBy(key, "cluster").agg(F.array_sort(F.collect_list(rank)).alias("all"))
    none = F.slice("all", 1, 0)
    meets = lambda a, x: F.exists(a, lambda y: (x["s"] <= y["e"]) & (y["s"] <= x["e"]))
    kept = F.aggregate("all", none, lambda acc, x: F.when(meets(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return ranked.select(key, F.explode(kept).alias("m")).select(key, F.col("m.phrase").alias("phrase"), F.col("m.s").alias("start_word"), F.col("m.e").alias("end_word"), F.col("m.kind").alias("kind"), F.col("m.by_lemma").alias("by_lemma"))
