"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, fingerprint, jaccard, linededup, neighbours, packing, quality, substrings, topk, toxicity, trie
from .common import mod_of_id, table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), lambda c: mod_of_id(c, 3) == 1
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"), "toxic", held_out))
    return toxicity.scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = mod_of_id(F.col("doc_id"), 4) == 2
    stats = written(quality.with_statistics(table(spark, sf_dir, "documents")), "stats")
    model = quality.fit(quality.train_rows(stats, table(spark, sf_dir, "labels"), "quality", held_out), "quality")
    return quality.scored(stats, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_conversations(turns))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.scaled(table(spark, sf_dir, "embeddings")), lambda i: i % 20 == 0)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.arranged(table(spark, sf_dir, "documents")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_jaccard_join, op3_imatch, op4_line_dedup, op5_byte_bpe, op6_quality, op7_suffix_dedup, op8_neighbours, op9_chat_format, op10_pack, op11_topk, op12_fim, op13_conversation_trie)}

_ESC = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
SQL = {
    "op4_line_dedup": linededup.SQL,
    "op11_topk": topk.SQL,
    "op12_fim": fim.SQL,
    "op13_conversation_trie": trie.SQL,
    "op9_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESC.format('role')}) + length(replace(role, chr(10), '  ')) - length(role) + length({_ESC.format('text')}) + 24)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
}
