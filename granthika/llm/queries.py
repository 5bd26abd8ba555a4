"""Queries pN_... of the llm problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granthika.llm import conversations, language, lookalike, packing, pii, scans, tokens, truncation
from granthika.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "chat_messages"), table(spark, d, "analyze_text_requests"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "chat_messages"), table(spark, d, "analyze_text_requests"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "users"), table(spark, d, "conversations"), table(spark, d, "chat_messages"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segment_rows(table(spark, d, "chat_messages"))


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every message with its confidence, and the languages of its whole sentences; null where it shows none."""
    return language.labelled(table(spark, d, "chat_messages")).select("id", "lang", "confidence", "whole")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "analyze_text_requests"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "analyze_text_requests"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.found(table(spark, d, "chat_sessions"), table(spark, d, "chat_messages"))


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.turns(table(spark, d, "chat_sessions"), table(spark, d, "chat_messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "datasets"), table(spark, d, "chat_messages"))


def p5_looks(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text of both tables."""
    return lookalike.looks(table(spark, d, "datasets"), table(spark, d, "chat_messages")).select("src", "id", "look")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the class of its look and its number of links to rows with other characters."""
    return lookalike.classed(table(spark, d, "datasets"), table(spark, d, "chat_messages"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return packing.pack(tokens.token_counts(documents), table(spark, d, "token_windows"), documents.count())


def p8_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p8_containers(spark, d), table(spark, d, "token_windows"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "documents"))


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.per_source(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_messages, p2_segments, p3_found, p3_texts, p4_found, p4_turns, p5_found, p5_looks, p5_classes, p7_ids, p8_containers, p8_utilisation, p9_found, p9_sources)}
