"""Queries of the language-model problems, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import token_counts, token_ids
from tidemark.llm.packing import pack
from tidemark.llm.truncation import source_rates, truncated
from tidemark.sources import read_table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(read_table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(read_table(spark, d, "documents")), read_table(spark, d, "container_sizes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(read_table(spark, d, "documents")).where("truncated").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return source_rates(truncated(read_table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_ids, p7_packed, p8_found, p8_sources)}
SQL: dict[str, str] = {}
