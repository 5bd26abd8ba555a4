"""Files as tables: discovery, what their path and their first bytes tell, texts and pages.

Defined results: a missing or empty folder has no files; a file is judged by its first bytes alone, whatever its
name says, but for plain text, which has no signature; pages without anything to see are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The least bytes of a file, the bytes in which signatures are sought, and the most bytes of an upload.
LEAST_BYTES, HEAD_BYTES, PDF_BYTES, MOST_BYTES = 16, 2048, 1024, 25 * 1024 * 1024
# What shows that a download went wrong.
ERROR_PAGES = ("<html", "<!doctype html", "<head", "404 not found", "500 internal server", "access denied")


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, name, length and modificationTime of the files below a folder, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", file_name(F.col("path")).alias("name"), "length", "modificationTime")


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, length and content of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", file_name(F.col("path")).alias("name"), "length", "content")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def sanitised_name(name: Column) -> Column:
    """The last part of a path with everything but letters, digits, `_`, `.` and `-` made an underscore."""
    plain = F.regexp_replace(file_name(name), r"[^\p{L}\p{M}\p{N}_.\-]", "_")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("uploaded_document"))


def saved_name(name: Column, token: Column) -> Column:
    """The name under which an upload is kept: its stem, eight hexadecimal digits of a token, and its extension."""
    plain = sanitised_name(name)
    ext = F.regexp_extract(plain, r"(\.[^.]+)$", 1)
    stem = F.regexp_replace(plain, r"\.[^.]+$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(token, 256), 1, 8), F.lower(ext))


def path_facts(path: Column, root_parts: int = 0) -> tuple[Column, Column, Column]:
    """route, folder and year that a path below a root tells: its first part, its second with spaces, and a year in the name."""
    parts = F.slice(F.split(path, "/"), root_parts + 1, 64)
    folder = F.when(F.size(parts) > 2, F.regexp_replace(parts[1], "_", " ")).otherwise("")
    route = F.when(F.size(parts) > 1, F.lower(parts[0])).otherwise("general")
    year = F.regexp_extract(F.regexp_replace(file_name(path), "_", " "), r"\b((?:18|19|20)\d{2})\b", 1).try_cast("int")
    return route.alias("route"), folder.alias("folder"), year.alias("year")


def checked(files: DataFrame) -> DataFrame:
    """Files (name, length, content) with is_valid, file_type and the first error, by signature."""
    head = F.substring("content", 1, HEAD_BYTES)
    low = F.lower(F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1"))
    raw = F.decode(head, "ISO-8859-1")
    page = F.lit(False)
    for mark in ERROR_PAGES:
        page = page | F.contains(low, F.lit(mark))
    bytes_ = F.hex(head)
    text = F.lower(F.col("name")).rlike(r"\.te?xt$") & F.is_valid_utf8(F.col("content"))
    kind = (
        F.when(F.contains(F.substring(raw, 1, PDF_BYTES), F.lit("%PDF-")), "pdf").when(F.startswith(bytes_, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(bytes_, F.lit("FFD8FF")), "jpg")
        .when(F.startswith(bytes_, F.lit("52494646")) & (F.substring(bytes_, 17, 8) == "57454250"), "webp").when(text, "txt")
    )
    small = F.col("length") < LEAST_BYTES
    found = F.when(small, "unknown").when(page, "html_error").otherwise(F.coalesce(kind, F.lit("unsupported")))
    error = F.when(small, "empty or too small").when(page, "an error page").when(kind.isNull(), "no known signature")
    return files.withColumn("file_type", found).withColumn("error", error).withColumn("is_valid", F.col("error").isNull())


def intake(files: DataFrame) -> DataFrame:
    """Checked uploads with the kind by extension; empty and too large ones are refused first."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    size = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large")
    x = checked(files).withColumn("error", F.coalesce(size, F.col("error"))).withColumn("is_valid", F.col("error").isNull())
    return x.withColumn("doc_type", F.when(ext == ".pdf", "pdf").when(ext.isin(".png", ".jpg", ".jpeg", ".webp"), "image").otherwise("text"))


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", "name", F.sha2("content", 256).alias("file_hash"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of text files, one row each."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def joined_pages(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """document and text: the pages of each document in their order, each under its number.

    A document is one value in the end, so its pages meet in one row; a document is no larger than its file.
    """
    seen = pages.where(F.length(F.regexp_replace(text, r"\s+", "")) > 0)
    each = seen.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text")))).alias("p"))
    shown = F.transform("p", lambda x: F.concat(F.lit("--- Page "), x["page"].cast("string"), F.lit(" ---\n"), F.regexp_replace(x["text"], r"^\s+|\s+$", "")))
    return each.select(document, F.array_join(shown, "\n\n").alias("text"))
