"""Registered queries of the text operators, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docframe.llm import encode, leakage, mojibake, reading, secrets, splitting
from docframe.session import table


def _p1_records(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.records(("line_items", table(spark, d, "line_items"), "line_id", "content"), ("chunks", table(spark, d, "chunks"), "chunk_id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.affected(_p1_records(spark, d)).select("source_table", "row_id")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(_p1_records(spark, d))


def p1_transformations(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.learn(_p1_records(spark, d))["pairs"].filter("learned").select("read_as", "written_as", "votes", "against")


def p1_routes(spark: SparkSession, d: str) -> DataFrame:
    """How many words and lines each route of the restoration decided."""
    return mojibake.routes(_p1_records(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.pieces(table(spark, d, "chunks"), table(spark, d, "chunk_results"))
    return cut.filter("piece_index = 0").select("chunk_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks"), table(spark, d, "chunk_results"))


def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized chunk: do its pieces, without their overlaps, make up the text, and is each within the limit?"""
    chunks, results = table(spark, d, "chunks"), table(spark, d, "chunk_results")
    cut = splitting.pieces(chunks, results)
    own = F.struct("piece_index", F.expr("substring(text, overlap_characters + 1)").alias("t"))
    size = splitting.size_of(F.col("text"))
    joined = cut.groupBy("chunk_id").agg(F.array_sort(F.collect_list(own)).alias("p"), F.max(size).alias("largest"), F.max(F.col("tokens") - size).alias("off"))  # the pieces of one text
    src = splitting.oversized(chunks, results).select("chunk_id", F.col("text").alias("whole"), "_max")
    text = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return joined.join(src, "chunk_id").select("chunk_id", (text == F.col("whole")).alias("whole"), (F.col("largest") <= F.col("_max")).alias("within"), (F.col("off") == 0).alias("sized"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(table(spark, d, "line_items"), table(spark, d, "match_locations")).select("source_table", "row_id")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(table(spark, d, "line_items"), table(spark, d, "match_locations"))


def p5_residual(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose redacted text still holds a secret of its own: none should."""
    found = secrets.find(table(spark, d, "line_items"), table(spark, d, "match_locations"))
    return secrets.line_secrets(found.select("source_table", "row_id", F.col("redacted").alias("text"))).select("source_table", "row_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents", "doc_id", "text"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents decoded from their ids again, by length: what went in must come out."""
    ids = encode.encode(table(spark, d, "documents", "doc_id", "text"))
    return ids.select("doc_id", F.length(encode.decode(F.col("ids"))).cast("bigint").alias("n_chars"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items")).filter("passage = 1").select("doc_id", "item_id")


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"))


def p7_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Length of every document's text without the leaked passages."""
    out = leakage.strip(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items"))
    return out.select("doc_id", F.length("text").alias("n_chars"))


def p7_residual(spark: SparkSession, d: str) -> DataFrame:
    """Documents that still leak an item after the passages are taken out: none should."""
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items")
    return leakage.find(leakage.strip(docs, items), items).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    out = reading.levels(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "reading_labels"))
    return out.filter("level >= 4").select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "reading_labels"))


def queries() -> dict:
    named = (p1_found, p1_restored, p1_transformations, p1_routes, p3_found, p3_pieces, p3_whole, p5_found, p5_redacted, p5_residual, p6_ids, p6_round_trip, p7_found, p7_spans, p7_stripped, p7_residual, p8_found, p8_levels)
    return {f.__name__: f for f in named}


_SPACES = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


# The chunks beyond their limit, with their size.
_OVERSIZED = f"""
            WITH res AS (SELECT result_id, any_value(max_tokens) AS max_tokens FROM chunk_results GROUP BY result_id),
            sized AS (
              SELECT c.chunk_id, CASE WHEN r.max_tokens > 0 THEN r.max_tokens ELSE 512 END AS most,
                floor((length(c.text) / 4.0::DOUBLE + len(regexp_extract_all(c.text, '[^{_SPACES}]+')) * 1.3::DOUBLE) / 2.0::DOUBLE) AS size
              FROM chunks c LEFT JOIN res r ON c.result_id = r.result_id WHERE c.text IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{_OVERSIZED} SELECT chunk_id FROM sized WHERE size > most",
        "p3_whole": f"{_OVERSIZED} SELECT chunk_id, true AS whole, true AS within, true AS sized FROM sized WHERE size > most",
        "p5_residual": "SELECT 'line_items' AS source_table, line_id AS row_id FROM line_items WHERE false",
        "p7_residual": "SELECT doc_id, 0::BIGINT AS item_id FROM documents WHERE false",
        "p6_round_trip": "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents",
    }
