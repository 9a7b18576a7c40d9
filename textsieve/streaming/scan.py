"""Phrase matches over documents that arrive as files. Windows of words are made within the row and the dictionary is a
static side, so the scan keeps no state and may write in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.match import phrase_match


def scan_stream(spark: SparkSession, path: str, schema: str, phrases: DataFrame) -> DataFrame:
    return phrase_match(spark.readStream.schema(schema).parquet(path), phrases)
