"""Search and reading of lines, with context. Narrow plans: no shuffle before an ordering is asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from docframe.functions.regex import search_pattern
from docframe.functions.text import scan_lines, split_lines


def search_lines(df: DataFrame, id_col: str, text_col: str, query: str, *, regex: bool = False, case_sensitive: bool = False, before: int = 0, after: int = 0, scan: bool = False) -> DataFrame:
    """First match of every matching line: id, line_number, column_number (1-based bytes), line_text, matched_text, before_context, after_context.

    ``scan`` takes scan lines (code search), else split lines (document search). Texts without a match are skipped before
    they are split. Null texts match nothing; context arrays are empty where there is none.
    """
    java = search_pattern(query, regex, case_sensitive)
    # an anchor may hold for a line and not for the whole text; without one, a text that has no match has no line with one
    anchored = regex and re.search(r"\^|\$|\\[ABz]|\(\?", query)
    src = df.select(id_col, F.col(text_col).alias("_t"))
    src = src.filter("_t is not null") if anchored else src.filter(F.col("_t").rlike(java))
    lines = (scan_lines if scan else split_lines)(F.col("_t"))
    src = src.select(id_col, lines.alias("_l"))
    # keep the matching lines of the array first, so that only they become rows
    at = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.try_element_at("_l", i + 1).rlike(java))
    hits = src.filter(F.size("_l") > 0).select(id_col, "_l", F.explode(at).alias("_i"))
    line = F.try_element_at("_l", F.col("_i") + 1)
    hits = hits.withColumn("line_text", line)
    start = F.regexp_instr("line_text", F.lit(java))
    i = F.col("_i")
    ctx_before = F.slice("_l", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before))) if before else F.array().cast("array<string>")
    ctx_after = F.when(i + 1 < F.size("_l"), F.slice("_l", i + 2, F.lit(after))).otherwise(F.array().cast("array<string>")) if after else F.array().cast("array<string>")
    return hits.select(
        id_col, (i + 1).alias("line_number"), (F.octet_length(F.substring("line_text", F.lit(1), start - 1)) + 1).alias("column_number"), "line_text",
        F.regexp_extract("line_text", java, 0).alias("matched_text"), ctx_before.alias("before_context"), ctx_after.alias("after_context"),
    )


def capped(matches: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The first ``limit`` matches by id and line; 0 keeps all."""
    return matches.orderBy(id_col, "line_number").limit(limit) if limit > 0 else matches


def summary(df: DataFrame, matches: DataFrame, id_col: str) -> DataFrame:
    """One row: total_matches, files_scanned, files_matched."""
    found = matches.agg(F.count("*").alias("total_matches"), F.count_distinct(id_col).alias("files_matched"))
    scanned = df.agg(F.count("*").alias("files_scanned"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(found).join(one(scanned), "_k").select("total_matches", "files_scanned", "files_matched")


def read_lines(df: DataFrame, id_col: str, text_col: str, start: int = 1, end: int = 0, context: int = 0) -> DataFrame:
    """Lines start..end widened by context: id, start_line, end_line (clamped), total_lines, line_number, content, byte_length."""
    lo = max(start, 1)
    src = df.filter(F.col(text_col).isNotNull()).select(id_col, scan_lines(F.col(text_col)).alias("_l"))
    n = F.size("_l")
    last: Column = n if end <= 0 else F.least(F.lit(end), n)
    first = max(lo - context, 1)
    until = F.least(last + context, n)
    src = src.select(id_col, F.lit(lo).alias("start_line"), last.alias("end_line"), n.alias("total_lines"), F.when(until >= first, F.slice("_l", F.lit(first), until - first + 1)).otherwise(F.array().cast("array<string>")).alias("_s"))
    out = src.select(id_col, "start_line", "end_line", "total_lines", F.posexplode("_s").alias("_p", "content"))
    return out.select(id_col, "start_line", "end_line", "total_lines", (F.col("_p") + first).alias("line_number"), "content", F.octet_length("content").alias("byte_length"))


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every scan line: id, line_number, content, byte_length."""
    out = df.select(id_col, F.posexplode(scan_lines(F.col(text_col))).alias("_p", "content"))
    return out.select(id_col, (F.col("_p") + 1).alias("line_number"), "content", F.octet_length("content").alias("byte_length"))
