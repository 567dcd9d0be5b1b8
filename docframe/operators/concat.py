"""Ordered concatenation of documents, whole or per group, with header, delimiter and line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docframe.functions.text import scan_lines


def part(text: Column, name: Column, position: Column, header: str = "", delimiter: str = "", numbered: bool = False) -> Column:
    """Lines one document contributes; ``position`` is its 0-based place among the inputs.

    ``%f``, ``%b`` and ``%n`` of the header are the name, its last part and the number of lines, replaced in that order. The
    delimiter stands before every input but the first place.
    """
    lines = scan_lines(text)
    shown = F.transform(lines, lambda x, i: F.format_string("%4d | %s", i + 1, x)) if numbered else lines
    none = F.array().cast("array<string>")
    head = none
    if header:
        h = F.replace(F.lit(header), F.lit("%f"), name)
        h = F.replace(h, F.lit("%b"), F.regexp_extract(name, r"([^/]*)/*$", 1))
        head = F.array(F.replace(h, F.lit("%n"), F.size(lines).cast("string")))
    cut = F.when(position > 0, F.array(F.lit(delimiter))).otherwise(none) if delimiter else none
    return F.concat(cut, head, shown)


def concat_lines(df: DataFrame, name_col: str, text_col: str, header: str = "", delimiter: str = "", numbered: bool = False, group_col: str | None = None) -> DataFrame:
    """The lines of the concatenation, of all documents or of each group: (group), name, position, line.

    ``name`` and ``position`` give the order within a group. Documents stay rows of their own, so a group of any size is never
    gathered in one task; ``text`` joins small ones. Null texts are skipped as unreadable inputs are; equal names are
    kept, in no defined order among themselves, each taking the delimiter unless it is the first name.
    """
    group = F.col(group_col) if group_col else F.lit(1)
    src = df.filter(F.col(text_col).isNotNull()).select(group.alias("_g"), F.col(name_col), F.col(text_col).alias("_t"))
    first = src.groupBy(F.col("_g").alias("_h")).agg(F.min(name_col).alias("_first"))
    src = src.join(first, F.col("_g").eqNullSafe(F.col("_h")))
    lines = part(F.col("_t"), F.col(name_col).cast("string"), F.when(F.col(name_col) == F.col("_first"), 0).otherwise(1), header, delimiter, numbered)
    keys = [F.col("_g").alias(group_col)] if group_col else []
    return src.select(*keys, name_col, F.posexplode(lines).alias("position", "line"))


def totals(lines: DataFrame, name_col: str, group_col: str) -> DataFrame:
    """Per group: files_processed, total_lines, total_bytes (a line end each). Documents without a line are not counted."""
    return lines.groupBy(group_col).agg(F.count_distinct(name_col).alias("files_processed"), F.count("*").alias("total_lines"), F.sum(F.octet_length("line") + 1).alias("total_bytes"))


def text(lines: DataFrame, name_col: str, group_col: str, max_bytes: int = 1 << 26) -> DataFrame:
    """One text per group whose size is at most ``max_bytes``; larger groups are left as lines, which their null text says."""
    sizes = totals(lines, name_col, group_col).select(F.col(group_col).alias("_h"), "total_bytes")
    small = lines.join(sizes.filter(F.col("total_bytes") <= max_bytes), F.col(group_col).eqNullSafe(F.col("_h")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name_col, "position", "line"))), lambda x: x["line"]), "\n")
    made = small.groupBy(group_col).agg(F.concat(body, F.lit("\n")).alias("text")).withColumnRenamed(group_col, "_g")
    return sizes.join(made, F.col("_h").eqNullSafe(F.col("_g")), "left").select(F.col("_h").alias(group_col), "text", "total_bytes")


def parts(lines: DataFrame, name_col: str, group_col: str, max_bytes: int = 1 << 26) -> DataFrame:
    """Every group's text in ordered parts: (group), part (from 1), text, total_bytes (of the part).

    A part ends with the line that reaches the next multiple of ``max_bytes``, so it is at most a line longer; the parts of a group put
    together are its text. Only larger groups are numbered, by the sizes of their documents, then by line within a document.
    """
    sizes = totals(lines, name_col, group_col).select(F.col(group_col).alias("_h"), F.col("total_bytes").alias("_bytes"))
    one = lines.select(F.col(group_col).alias("_g"), F.col(name_col).alias("_name"), "position", "line", (F.octet_length("line") + 1).cast("bigint").alias("_b"))
    large = one.join(sizes.filter(F.col("_bytes") > max_bytes).select("_h"), F.col("_g").eqNullSafe(F.col("_h")))
    docs = large.groupBy(F.col("_g").alias("_h2"), F.col("_name").alias("_n2")).agg(F.sum("_b").alias("_doc"))
    ahead = F.sum("_doc").over(W.partitionBy("_h2").orderBy("_n2").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_doc")  # one row per document
    inside = F.sum("_b").over(W.partitionBy("_g", "_name").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_b")
    placed = large.withColumn("_in", inside).join(docs.select("_h2", "_n2", ahead.alias("_ahead")), F.col("_g").eqNullSafe(F.col("_h2")) & F.col("_name").eqNullSafe(F.col("_n2")))
    at = F.floor((F.col("_ahead") + F.col("_in")) / max_bytes)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_name", "position", "line"))), lambda x: x["line"]), "\n")
    hot = placed.groupBy("_g", at.alias("_at")).agg(F.concat(body, F.lit("\n")).alias("text"), F.sum("_b").alias("total_bytes"))
    number = F.row_number().over(W.partitionBy("_g").orderBy("_at")).cast("int")  # one row per part
    hot = hot.select(F.col("_g").alias(group_col), number.alias("part"), "text", "total_bytes")
    whole = text(lines, name_col, group_col, max_bytes).filter(F.col("total_bytes") <= max_bytes)
    return whole.select(group_col, F.lit(1).alias("part"), "text", "total_bytes").unionByName(hot)
