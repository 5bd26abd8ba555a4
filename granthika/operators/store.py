"""Keeping a table of chunks: ids, exact duplicates, upsert, delete and incremental ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granthika.functions.text import clean, normalise
from granthika.operators import chunks


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.sha2(F.concat_ws("_", document_id, chunk_index), 256)


def document_id(act_name: Column, year: Column) -> Column:
    """The letters and digits of an act's name and its year, joined by underscores."""
    name = F.btrim(F.regexp_replace(act_name, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.concat(name, F.coalesce(F.concat(F.lit("_"), year.cast("string")), F.lit("")))


# Reasons for which an ingest refuses a document, in the order in which they are tried.
def refusal(text: Column, act_name: Column, source: Column) -> Column:
    return (
        F.when(text.isNull(), "no text").when(F.length(F.regexp_replace(text, r"\s+", "")) == 0, "blank text")
        .when(F.coalesce(act_name, F.lit("")) == "", "no act").when(F.coalesce(source, F.lit("")) == "", "no source")
    )


def refused(docs: DataFrame) -> DataFrame:
    """doc_id and reason of the documents that `records` leaves out; nothing is lost between both."""
    reason = refusal(F.col("text"), F.col("act_name"), F.col("source"))
    return docs.select("doc_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def records(docs: DataFrame, size: int = chunks.SIZE, overlap: int = chunks.OVERLAP) -> DataFrame:
    """The ingest as one plan: texts are cleaned and cut, chunks get id, section and text key, and of equal ones the first is kept.

    Chunks are equal if act, year, section and text are; first is the one of the smallest doc_id and index. The
    texts are read once, and one shuffle by key finds the first with a partial minimum.
    """
    good = docs.where(refusal(F.col("text"), F.col("act_name"), F.col("source")).isNull())
    cleaned = good.select("doc_id", clean(F.col("text")).alias("text"), F.struct("act_name", F.col("act_year").alias("year"), "source").alias("of"))
    rows = chunks.chunk_rows(cleaned, "doc_id", "text", size, overlap, kept=["of"])
    x = rows.select("doc_id", "chunk_index", "of.act_name", "of.year", "of.source", "section_number", "section_title", "chunk", text_key(F.col("chunk")).alias("text_key"))
    first = x.groupBy("act_name", "year", "section_number", "text_key").agg(F.min_by(F.struct("doc_id", "chunk_index", "source", "section_title", "chunk"), F.struct("doc_id", "chunk_index")).alias("r"), F.count("*").alias("copies"))
    flat = first.select("act_name", "year", "section_number", "text_key", "copies", "r.*")
    return flat.withColumn("document_id", document_id(F.col("act_name"), F.col("year"))).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index")))


def text_key(text: Column) -> Column:
    return F.sha1(normalise(text))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group of equal keys, by `order`, which must decide every tie.

    One row per group survives on the map side already (a partial minimum), so a group with a third of all
    rows costs no more than others.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    first = df.groupBy(*named).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def upsert(stored: DataFrame, arriving: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key; of equal versions the arriving one."""
    both = stored.withColumn("_late", F.lit(0)).unionByName(arriving.withColumn("_late", F.lit(1)))
    rest = [c for c in both.columns if c != key]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, "_late")).alias("_row"))
    return newest.select(key, *[f"_row.{c}" for c in rest if c != "_late"])


def delete(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def only_new(arriving: DataFrame, stored: DataFrame, key: Column) -> DataFrame:
    """Arriving rows whose key isn't stored yet."""
    known = stored.select(key.alias("_known")).distinct()
    return arriving.withColumn("_key", key).join(known, F.col("_key") == F.col("_known"), "left_anti").drop("_key")


def latest_n(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
