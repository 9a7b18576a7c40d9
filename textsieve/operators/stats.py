"""Aggregates over matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_list(matches: DataFrame) -> DataFrame:
    """For each list, kind and phrase the number of distinct spans (doc_id, start_word, end_word) and the pages."""
    return matches.groupBy("list_key", "kind", "phrase").agg(F.countDistinct(F.struct("doc_id", "start_word", "end_word")).alias("n"), F.array_sort(F.collect_set("page")).alias("pages"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("list_key", "kind").agg(F.sum("n").cast("long").alias("total"))


def by_form(matches: DataFrame) -> DataFrame:
    """For each phrase, kind and form the number of matches and the pages."""
    return matches.groupBy("phrase", "kind", "form").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("page")).alias("pages"))


def footnotes(matches: DataFrame, lexicon: DataFrame) -> DataFrame:
    """kind, key, total, forms (`form:count`, sorted) of matches: words by their lemma in the lexicon (word, lemma), or
    themselves, phrases as they are; forms are the words of the texts."""
    known = lexicon.select(F.col("word").alias("phrase"), "lemma").where("lemma <> ''")
    keyed = matches.join(known, "phrase", "left").withColumn("key", F.when(F.col("kind") == "phrase", F.col("phrase")).otherwise(F.coalesce("lemma", "phrase")))
    forms = keyed.groupBy("kind", "key", "matched").agg(F.count(F.lit(1)).alias("n"))
    return forms.groupBy("kind", "key").agg(F.sum("n").cast("long").alias("total"), F.array_sort(F.collect_list(F.concat_ws(":", "matched", "n"))).alias("forms"))


def search_stats(matches: DataFrame) -> DataFrame:
    """phrase, kind, total and forms (map from a form to its count and sorted distinct pages) of matches (phrase, kind, form,
    page); patterns' matches are rows like the others. Forms are counted before they meet, so a group holds its distinct forms;
    null pages are none, a null form counts as empty."""
    by = matches.groupBy("phrase", "kind", F.coalesce("form", F.lit("")).alias("form")).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("page")).alias("pages"))
    return by.groupBy("phrase", "kind").agg(F.sum("count").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("form", F.struct("count", "pages").alias("x"))))).alias("forms"))


def results(docs: DataFrame, matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id and `result`, a JSON text with total_matches and stats: of each list, phrase and kind the number of matches, by
    the phrases' order (ord). Documents without matches have none of them."""
    counts = matches.groupBy(id_col, "ord", "list_key", "phrase", "kind").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy(id_col).agg(F.sum("n").alias("total_matches"), F.sort_array(F.collect_list(F.struct("ord", "list_key", "phrase", "kind", "n"))).alias("_s"))
    rows = docs.select(id_col).join(stats, id_col, "left")
    shown = F.transform(F.coalesce("_s", F.array().cast("array<struct<ord:bigint,list_key:string,phrase:string,kind:string,n:bigint>>")), lambda x: F.struct(*(x[c].alias(c) for c in ("list_key", "phrase", "kind", "n"))))
    return rows.select(id_col, F.to_json(F.struct(F.coalesce("total_matches", F.lit(0).cast("long")).alias("total_matches"), shown.alias("stats"))).alias("result"))


def by_words_and_phrases(matches: DataFrame) -> DataFrame:
    """One row: `stats`, a JSON text with word_stats and phrase_stats, each the phrases of that kind with their counts, the
    most frequent first, then by phrase. Other kinds take no part; the row is as large as the dictionary."""
    counts = matches.groupBy("kind", "phrase").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("less"), "phrase", "n")))), lambda x: F.struct(x["phrase"].alias("phrase"), x["n"].alias("count"))).alias(f"{kind}_stats")
    return counts.agg(of("word"), of("phrase")).select(F.to_json(F.struct("word_stats", "phrase_stats")).alias("stats"))
