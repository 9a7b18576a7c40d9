"""From raw documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import jaccard, linededup, packing, quality, substrings
from textsieve.llm.common import forget, mod_of_id, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to labelled rows that aren't held out, scores 0.5 or more; all, if none
    are labelled. Null texts score as empty ones, null ids have no label, repeated rows are judged alike."""
    held_out = mod_of_id(F.col("doc_id"), 4) == 2
    # of rows that the fit may use; all are scored later, in a pass that reads no more than a join with scores would
    stats = written(quality.with_statistics(docs.where(~held_out)), "stats")
    model = quality.fit(quality.train_rows(stats, table(spark, sf_dir, "labels"), "quality", held_out), "quality")
    forget(stats)
    return quality.accepted(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that over a tenth of their source's documents hold."""
    return linededup.drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id; of rows with the same id and text one, in any case.
    Different texts of one id stay together, and rows without an id stay as they are."""
    kept = jaccard.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.where("doc_id is null")).select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes and more that stand in an earlier document, or earlier in the same one."""
    return substrings.cut_texts(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("line_dedup", drop_boilerplate), ("near_duplicates", one_of_each_group), ("suffix_dedup", drop_repeats), ("pack", pack)]
#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the table documents; each stage's is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
