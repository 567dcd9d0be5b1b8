"""Structured extraction: links, CSV tables and metadata of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docframe.functions import text as X

# Extensions that are read as text.
SUPPORTED = ("pdf", "docx", "xlsx", "csv", "md", "txt", "text", "log")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED)


def links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, urls, emails, dates: distinct matches in byte order; empty arrays where there are none."""
    return df.filter(F.col(text_col).isNotNull()).select(id_col, X.links(F.col(text_col)).alias("_l")).select(id_col, "_l.*")


def link_totals(found: DataFrame) -> DataFrame:
    """One row: urls, emails, dates, and the total that counts urls and emails only."""
    sums = [F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in ("urls", "emails", "dates")]
    return found.agg(*sums).withColumn("total", F.col("urls") + F.col("emails"))


def csv_tables(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cells of a CSV text split at commas: id, row, col (from 0), value."""
    rows = df.filter(F.col(text_col).isNotNull()).select(id_col, F.posexplode(X.csv_rows(F.col(text_col))).alias("row", "_c"))
    return rows.select(id_col, "row", F.posexplode("_c").alias("col", "value"))


def metadata(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size_bytes, words, characters (bytes, as the documents' metadata counts them), lines."""
    t = F.col(text_col)
    return df.filter(t.isNotNull()).select(id_col, F.octet_length(t).alias("size_bytes"), X.words(t).alias("words"), F.octet_length(t).alias("characters"), F.size(X.split_lines(t)).alias("lines"))
