"""Phrase lists: links, changes, paging, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    return max(1, min(500, 100 if limit is None else limit)), max(0, offset or 0)


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows that hold every word of the query, in any case."""
    return df.where(reduce(lambda a, b: a & b, (F.lower(column).contains(t.lower()) for t in query.split()), F.lit(True)))


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    limit, offset = clamp(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """change (added, deleted) and phrase."""
    return new.subtract(old).select(F.lit("added").alias("change"), "phrase").unionByName(old.subtract(new).select(F.lit("deleted").alias("change"), "phrase"))


def excluded(phrases: DataFrame, gone: DataFrame) -> DataFrame:
    """phrases without those that gone has, in any case; nulls stay."""
    return phrases.join(gone.select(F.lower("phrase").alias("_gone")).distinct(), F.lower("phrase") == F.col("_gone"), "left_anti")


def one_each(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], keep_if_set: tuple[str, ...] = ()) -> DataFrame:
    """old, with the columns of new where the key is in both (those of keep_if_set only where they are empty), and the
    rows of new whose key isn't; null keys of new are left out."""
    o, n = old.alias("o"), new.where(F.col(key).isNotNull()).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    cell = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep_if_set else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(cell(c).alias(c) for c in columns))


def prepared_terms(terms: DataFrame, words_of: Column, order: Column) -> DataFrame:
    """term, kind (phrase, word) and key (its words in order of the alphabet), the first of those that differ in case alone."""
    clean = one_each(terms.withColumn("_key", F.lower(F.trim("term"))).where("_key <> ''"), F.col("_key"), order)
    return clean.select(F.trim("term").alias("term"), F.when(F.size(words_of) > 1, "phrase").otherwise("word").alias("kind"), F.array_join(F.array_sort(words_of), " ").alias("key"))


def term_index(terms: DataFrame, lexicon: DataFrame, order: Column) -> DataFrame:
    """The keys by which terms (term) are found: kind (word, phrase), by (lemma, stem), sorted, bucket, key, info, n. A term is
    a phrase if it has two words or more (runs of letters, as text.clean_word takes them), else a word; of terms that differ in
    case alone the first by `order` stands. Words of the lexicon (word, lemma, stem; each once) have its lemma and stem,
    others themselves; a phrase has a key of its words' lemmas and one of their stems, each as they stand and sorted (sorted
    true), joined by spaces; a word has its lemma and its stem. Of terms of one key the first is `info`, n counts them; bucket
    holds the key's first three characters, by which rows are dealt. Terms without letters have no keys."""
    clean = one_each(terms.select(F.trim("term").alias("term"), order.alias("_order")).withColumn("_k", F.lower("term")).where("_k <> ''"), F.col("_k"), F.col("_order"))
    split = clean.withColumn("_w", F.regexp_extract_all("_k", F.lit(text.LETTER_RUN), F.lit(0))).where(F.size("_w") > 0)
    words = split.select("term", "_order", F.size("_w").alias("_n"), F.posexplode("_w").alias("_i", "word"))
    known = words.join(lexicon.select("word", "lemma", "stem"), "word", "left")
    of = lambda c: F.sort_array(F.collect_list(F.struct("_i", F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("word")).alias("x"))))["x"]
    made = known.groupBy("term", "_order", "_n").agg(of("lemma").alias("lemma"), of("stem").alias("stem"))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("by"), F.lit(s).alias("sorted"), F.array_join(F.array_sort(c) if s else F.col(c), " ").alias("key")) for c in ("lemma", "stem") for s in (False, True))))
    keys = made.select("term", "_order", F.when(F.col("_n") > 1, "phrase").otherwise("word").alias("kind"), rows.alias("k")).select("term", "_order", "kind", "k.*").where("kind = 'phrase' or not sorted")
    found = keys.groupBy("kind", "by", "sorted", F.substring("key", 1, 3).alias("bucket"), "key").agg(F.min_by("term", "_order").alias("info"), F.count(F.lit(1)).alias("n"))
    return found


def sync(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """old with the values of new where all keys agree, nulls included, and the rest of new."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    same = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    joined = o.join(n, same, "full_outer")
    pick = lambda c: F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(pick(c).alias(c) for c in [*keys, *values]))


def with_prefix_id(keys: DataFrame, column: str, prefix: str) -> DataFrame:
    """id: what stands between the prefix and the next colon, once each, of keys that begin with the prefix."""
    return keys.where(F.col(column).startswith(prefix)).select(F.split_part(F.substring(column, len(prefix) + 1, 1 << 30), F.lit(":"), F.lit(1)).alias("id")).distinct()


def without_prefix(keys: DataFrame, column: str, prefix: str) -> DataFrame:
    return keys.where(F.col(column).isNull() | ~F.col(column).startswith(prefix))


def export_text(links: DataFrame) -> DataFrame:
    """list, content: the distinct phrases of each list, sorted, a line each."""
    return links.groupBy("list").agg(F.array_join(F.array_sort(F.collect_set("phrase")), "\n").alias("content"))


def renamed(links: DataFrame, changes: DataFrame) -> DataFrame:
    """links (list, phrase) after changes (old, new), but for those whose new phrase is there already."""
    taken = links.select(F.col("phrase").alias("new")).distinct()
    allowed = changes.join(taken, "new", "left_anti").select(F.col("old").alias("phrase"), "new")
    return links.join(F.broadcast(allowed), "phrase", "left").select("list", F.coalesce("new", "phrase").alias("phrase"))


def removed(links: DataFrame, gone: DataFrame) -> DataFrame:
    """links (list, phrase) without those of gone, and only from the lists that gone names them for."""
    return links.join(gone.select("list", "phrase").distinct(), ["list", "phrase"], "left_anti").select("list", "phrase")


def with_companions(files: DataFrame, due: Column) -> DataFrame:
    """The files (name, stem: what it shares with its companions) that are due, and all of the same stem."""
    return files.join(files.where(due).select("stem").distinct(), "stem", "left_semi")
