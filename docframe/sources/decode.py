"""Decode binary documents on the executors: text, pages, tables, cells, media and metadata.

Every function takes a relation with a path and a binary content and decodes each document once, in Arrow batches. A document that
cannot be decoded gives empty results and an ``error``; null contents are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from docframe.formats import docx, images, package, pdf, xlsx


def format_of(path: str) -> str:
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "csv": "csv"}.get(ext, "text")


def text_of(path: str, data: bytes) -> str:
    kind = format_of(path)
    if kind == "pdf":
        return pdf.text(data)
    if kind == "docx":
        return docx.to_text(data)
    if kind == "xlsx":
        return xlsx.to_text(data)
    return data.decode("utf-8", "replace")


def tables_of(path: str, data: bytes) -> list[list[list[str]]]:
    kind = format_of(path)
    if kind == "docx":
        return docx.tables(data)
    if kind == "xlsx":  # all sheets merged into one table without its empty lines
        return [[line.split("\t") for line in xlsx.to_text(data).split("\n") if line]]
    if kind == "csv":  # split at every comma
        return [[line.split(",") for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n") if line]]
    return []


def metadata_of(path: str, data: bytes) -> dict:
    kind = format_of(path)
    out: dict = {"size_bytes": len(data)}
    text = text_of(path, data)
    if kind == "pdf":
        out["pages"] = len(pdf.pages(data))
    elif kind == "xlsx":
        out["sheets"] = len(xlsx.info(data))
    elif kind == "docx":
        out |= {"paragraphs": text.count("\n") + 1, "tables": len(docx.tables(data))}
    return out | {"words": len(text.split()), "characters": len(text.encode())}


def _each(df: DataFrame, path_col: str, content_col: str, schema: str, rows: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """Rows of every file; a file that cannot be read has one row, with the error and nulls."""
    src = df.filter(F.col(content_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    full = f"path string, {schema}, error string"
    width = len(T._parse_datatype_string(f"struct<{schema}>").fields)
    names = [f.name for f in T._parse_datatype_string(f"struct<{full}>").fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            out = []
            for path, data in zip(pdf_["path"], pdf_["content"]):
                try:
                    out += [(path, *r, None) for r in rows(path, bytes(data))]
                except Exception as x:  # a broken file must not stop the others
                    out.append((path, *[None] * width, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return src.mapInPandas(run, full)


def documents(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, format (``unknown`` where it cannot be read), text, error."""
    out = _each(df, path_col, content_col, "format string, text string", lambda p, b: [(format_of(p), text_of(p, b))])
    return out.withColumn("format", F.coalesce("format", F.lit("unknown"))).withColumn("text", F.coalesce("text", F.lit("")))


def cells(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Non-empty cells of workbooks: path, sheet, sheet_index, row, col, value (rows and columns from 1), error."""
    rows = lambda p, b: [(n, i, r, c, v) for i, (n, table) in enumerate(xlsx.read(b)) for r, row in enumerate(table, 1) for c, v in enumerate(row, 1) if v != ""]
    return _each(df, path_col, content_col, "sheet string, sheet_index int, row int, col int, value string", rows)


def sheet_info(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    rows = lambda p, b: [(s["name"], s["index"], s["row_count"], s["col_count"], s["headers"]) for s in xlsx.info(b)]
    return _each(df, path_col, content_col, "name string, index int, row_count int, col_count int, headers array<string>", rows)


def pages(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    return _each(df, path_col, content_col, "page int, text string", lambda p, b: list(enumerate(pdf.pages(b), 1)))


def tables(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    rows = lambda p, b: [(i, t) for i, t in enumerate(tables_of(p, b))]
    return _each(df, path_col, content_col, "index int, rows array<array<string>>", rows)


def metadata(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    names = ("size_bytes", "pages", "sheets", "paragraphs", "tables", "words", "characters")
    rows = lambda p, b: [tuple((m := metadata_of(p, b)).get(n) for n in names)]
    return _each(df, path_col, content_col, ", ".join(f"{n} bigint" for n in names), rows)


def media(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Embedded pictures: path, name, data, error."""

    def rows(p: str, b: bytes) -> list[tuple]:
        return pdf.embedded_images(b) if format_of(p) == "pdf" else package.media(b)

    return _each(df, path_col, content_col, "name string, data binary", rows)


def image_info(df: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    def rows(p: str, b: bytes) -> list[tuple]:
        m = images.info(b)
        if not m:
            raise ValueError("unknown image format")
        return [(m["format"], m["width"], m["height"], m["aspect_ratio"], m["file_size"])]

    return _each(df, path_col, content_col, "format string, width int, height int, aspect_ratio double, file_size bigint", rows)


def encode(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """Documents of a text column as binary ``content``: ``docx`` or ``pdf`` from Markdown, ``xlsx`` from CSV."""
    make = {"docx": docx.from_markdown, "pdf": pdf.from_markdown, "xlsx": xlsx.from_csv}[kind]
    src = df.filter(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_t"))
    schema = T.StructType([src.schema[0], T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({id_col: part[id_col], "content": [make(t) for t in part["_t"]]})

    return src.mapInPandas(run, schema)


def to_json(rows: DataFrame) -> list[dict]:
    """Rows of a result that is shown to a person, as plain values."""
    return [json.loads(x) for x in rows.toJSON().collect()]
