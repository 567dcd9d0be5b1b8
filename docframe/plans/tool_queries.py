"""Registered queries of sources, tools and streams that work on files of their own, made in the shared folder, with SQL."""

from __future__ import annotations

import contextlib
import io
import json
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from docframe.formats import docx, images, package, pdf, xlsx
from docframe.operators import icons, search
from docframe.session import shared_folder, table
from docframe.sources import decode, files
from docframe.streaming import ingest
from docframe.tools import cli, registry, server


def _place(spark: SparkSession, *parts: str) -> str:
    """A path in the folder that all executors share."""
    path = os.path.join(shared_folder(spark).removeprefix("file:").replace("//", "/"), "docframe-tools", *parts)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


_TEXT = "key,name\n1,first\n2,second\n"


def _sources() -> dict[str, bytes]:
    """One small file of each readable format, and a broken one."""
    md = "# Title\n\nSee the *text*."
    return {
        "a.txt": b"plain\ntext", "b.md": md.encode(), "c.log": b"INFO started", "d.csv": _TEXT.encode(), "e.xlsx": xlsx.from_csv(_TEXT), "f.docx": docx.from_markdown("# Title\n\nSee the text."), "g.pdf": pdf.from_markdown("# Title\n\nSee the text."), "h.docx": b"no package",
    }


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(list(_sources().items()), columns=["path", "content"]), "path string, content binary")


def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text and format of a file of every kind."""
    return decode.documents(_files(spark)).select("path", "format", "text")


def source_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a spreadsheet, a CSV and others."""
    return decode.tables(_files(spark).filter("path in ('d.csv', 'e.xlsx', 'a.txt')")).select("path", "index", F.to_json("rows").alias("rows"))


def source_metadata(spark: SparkSession, d: str) -> DataFrame:
    return decode.metadata(_files(spark)).select("path", "pages", "sheets", "words", "characters")


def sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """Single cells of a workbook, one beyond its end."""
    get = F.pandas_udf(lambda cells: cells.map(lambda c: xlsx.get_cell(xlsx.from_csv(_TEXT), c)), "string")
    src = spark.createDataFrame([(c,) for c in ("A1", "b3", "$A$2", "C9")], "cell string")
    return src.select("cell", get("cell").alias("value"))


def wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Every document wrapped to 80 characters: is any line too long that has more than one word, and are all words kept?"""

    def holds(text):
        lines = images.wrap(text, 80)
        return all(len(x) <= 80 or " " not in x for x in lines) and " ".join(lines).split() == text.split()

    check = F.pandas_udf(lambda texts: texts.map(holds), "boolean")
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", check("text").alias("holds"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of a Word file and of one, several and all pages of a PDF, by their headers."""
    names = {n: _place(spark, n) for n in ("s.docx", "s.pdf", "one.png", "word.png")}
    files.write_atomic(names["s.docx"], docx.from_markdown("# Title\n\ntext"))
    files.write_atomic(names["s.pdf"], pdf.from_pages(["first", "second", "third"]))
    calls = [
        ("docs_snapshot", {"filePath": names["s.docx"], "outputPng": names["word.png"]}), ("pdf_snapshot", {"filePath": names["s.pdf"], "outputTarget": names["one.png"], "page": 2}),
        ("pdf_snapshot", {"filePath": names["s.pdf"], "outputTarget": _place(spark, "range", "p_%d.png"), "from": 2, "to": 3}), ("pdf_snapshot", {"filePath": names["s.pdf"], "outputTarget": _place(spark, "every", ""), "all": True}),
    ]
    rows = []
    for n, (tool, args) in enumerate(calls):
        text, error = registry.dispatch(tool, args)
        made = json.loads(text) if not error else {}
        for path in made.get("outputs", [made.get("output")]):
            head = images.info(registry.read(path))
            rows.append((n, os.path.basename(path), head["format"], head["width"], head["height"]))
    return spark.createDataFrame(rows, "call int, file string, format string, width int, height int")


def rewritten(spark: SparkSession, d: str) -> DataFrame:
    """A file replaced in one step, whole and piece by piece; nothing else is left in its folder."""
    rows = []
    for name, data in (("whole.txt", b"new text"), ("pieces.txt", (x for x in (b"new ", b"text")))):
        path = _place(spark, "rewritten", name)
        files.write_atomic(path, b"old")
        files.write_atomic(path, data)
        rows.append((name, registry.read(path).decode(), sum(n.startswith(name) for n in os.listdir(os.path.dirname(path)))))
    return spark.createDataFrame(rows, "file string, text string, files int")


def file_order(spark: SparkSession, d: str) -> DataFrame:
    """Files of globs in order: each pattern's matches by name, repeats kept; and by extension below a folder."""
    for n in ("b.js", "a.js", "c.ts", "sub/d.ts"):
        files.write_atomic(_place(spark, "order", n), b"x")
    root = os.path.dirname(_place(spark, "order", "x"))
    found = files.expand([f"{root}/*.js", f"{root}/c.ts", f"{root}/a*"])
    rows = [(i, "glob", os.path.basename(p)) for i, p in enumerate(found)]
    tree = files.file_tree(spark, root, include=",".join(files.extension_globs("ts, .js"))).select("name").orderBy("name").collect()  # four files
    return spark.createDataFrame(rows + [(i, "extension", r["name"]) for i, r in enumerate(tree)], "position int, kind string, file string")


def rpc_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the request loop: one a line, none to notifications, blank lines and what is no JSON."""
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "text_tokens", "arguments": {"text": "one two"}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "none"}},
        {"jsonrpc": "2.0", "id": 5, "method": "none"}, {"jsonrpc": "2.0", "id": 6, "method": "resources/read", "params": {"uri": "none:"}}, {"jsonrpc": "2.0", "id": 7, "method": "prompts/list"}, {"jsonrpc": "2.0", "id": 8, "method": "ping"},
    ]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(map(json.dumps, asked)) + "\n\nno json\n[1]\n"), out)
    rows = []
    for x in map(json.loads, out.getvalue().splitlines()):
        result = x.get("result", {})
        rows.append((x["id"], x.get("error", {}).get("code"), result.get("isError"), len(result["tools"]) if "tools" in result else None))
    return spark.createDataFrame(rows, "id int, code int, failed boolean, tools int")


def command_line(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of some commands, good and bad, with the global options."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for argv in (["--json", "--workers", "2", "text", "tokens", "--text", "one two three"], ["--json", "no", "such"], ["--json", "docs", "info", "/none"], ["--silent", "text", "tokens", "--text", "a"], ["--json", "schema", "export", "--tool", "TEXT_TOKENS"]):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            code = cli.main(argv)
        got = json.loads(out.getvalue() or "{}")
        rows.append((len(rows), code, got.get("success"), got.get("command"), len(got["data"]) if "data" in got else None))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.createDataFrame(rows, "call int, code int, success boolean, command string, fields int")


def tool_filter(spark: SparkSession, d: str) -> DataFrame:
    """Definitions by name, in any case, in the three shapes."""
    rows = [(kind, name, len(registry.export(kind, name))) for kind in ("plain", "function", "input_schema") for name in ("", "Read_Lines")]
    return spark.createDataFrame(rows, "kind string, name string, tools int")


def icon_filter(spark: SparkSession, d: str) -> DataFrame:
    """Icons of one collection only, whatever its case."""
    return icons.search(icons.catalogue(spark), "", "MARKS", 99).select("collection", "name")


def manifest_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a batch manifest in UTF-8 with a mark and in UTF-16."""
    steps = [{"id": "a", "tool": "text_tokens"}, {"tool": "größe"}]
    rows = [(enc, i, s.get("id"), s["tool"]) for enc in ("utf-8-sig", "utf-16") for i, s in enumerate(server.manifest(json.dumps(steps).encode(enc)))]
    return spark.createDataFrame(rows, "encoding string, step int, id string, tool string")


def embedded_media(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of one page of a PDF, and of all."""
    png = [images.snapshot([], "", w, 20) for w in (30, 40)]
    book = pdf.from_images(png)
    rows = [(page, name, images.info(body)["width"]) for page in (0, 1, 2, 3) for name, body in pdf.embedded_images(book, page)]
    zipped = package.write({"word/media/a.png": png[0], "x/media/a.png": png[1]})
    rows += [(-1, name, images.info(body)["width"]) for name, body in package.media(zipped)]
    return spark.createDataFrame(rows, "page int, name string, width int")


def stream_search(spark: SparkSession, d: str) -> DataFrame:
    """The search of lines on a stream of the documents' file, written and read again."""
    run = uuid.uuid4().hex
    src = table(spark, d, "documents", "doc_id", "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    stream = ingest.documents(spark, f"{d}/documents.parque[t]", schema)
    hits = search.search_lines(stream, "doc_id", "text", "small robot", before=0, after=0)
    out, marks = _place(spark, run, "out"), _place(spark, run, "marks")
    ingest.to_parquet(hits.select("doc_id", "line_number", "column_number"), out, marks).start().awaitTermination()
    return spark.read.parquet(out)


def queries() -> dict:
    named = (source_texts, source_tables, source_metadata, sheet_cells, wrapped, snapshots, rewritten, file_order, rpc_answers, command_line, tool_filter, icon_filter, manifest_steps, embedded_media, stream_search)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    nl = "chr(10)"
    return {
        "source_texts": f"""SELECT * FROM (VALUES ('a.txt', 'text', 'plain' || {nl} || 'text'), ('b.md', 'text', '# Title' || {nl} || {nl} || 'See the *text*.'), ('c.log', 'text', 'INFO started'), ('d.csv', 'csv', 'key,name' || {nl} || '1,first' || {nl} || '2,second' || {nl}),
          ('e.xlsx', 'xlsx', 'key' || chr(9) || 'name' || {nl} || '1' || chr(9) || 'first' || {nl} || '2' || chr(9) || 'second'), ('f.docx', 'docx', 'Title' || {nl} || 'See the text.'), ('g.pdf', 'pdf', 'Title' || {nl} || 'See the text.'), ('h.docx', 'unknown', '')) v(path, format, text)""",
        "source_metadata": """SELECT * FROM (VALUES ('a.txt', NULL, NULL, 2::BIGINT, 10::BIGINT), ('b.md', NULL, NULL, 5, 24), ('c.log', NULL, NULL, 2, 12), ('d.csv', NULL, NULL, 3, 26), ('e.xlsx', NULL, 1::BIGINT, 6, 25), ('f.docx', NULL, NULL, 4, 19), ('g.pdf', 1::BIGINT, NULL, 4, 19), ('h.docx', NULL, NULL, NULL, NULL)) v(path, pages, sheets, words, characters)""",
        "source_tables": """SELECT * FROM (VALUES ('d.csv', 0, '[["key","name"],["1","first"],["2","second"]]'), ('e.xlsx', 0, '[["key","name"],["1","first"],["2","second"]]')) v(path, "index", rows)""",
        "sheet_cells": "SELECT * FROM (VALUES ('A1', 'key'), ('b3', 'second'), ('$A$2', '1'), ('C9', '')) v(cell, value)",
        "wrapped": "SELECT doc_id, true AS holds FROM documents WHERE text IS NOT NULL",
        "snapshots": """SELECT * FROM (VALUES (0, 'word.png', 'png', 800, 1100), (1, 'one.png', 'png', 800, 1100), (2, 'p_2.png', 'png', 800, 1100), (2, 'p_3.png', 'png', 800, 1100),
          (3, 'page_1.png', 'png', 800, 1100), (3, 'page_2.png', 'png', 800, 1100), (3, 'page_3.png', 'png', 800, 1100)) v(call, file, format, width, height)""",
        "rewritten": "SELECT * FROM (VALUES ('whole.txt', 'new text', 1), ('pieces.txt', 'new text', 1)) v(file, text, files)",
        "file_order": """SELECT * FROM (VALUES (0, 'glob', 'a.js'), (1, 'glob', 'b.js'), (2, 'glob', 'c.ts'), (3, 'glob', 'a.js'), (0, 'extension', 'a.js'), (1, 'extension', 'b.js'), (2, 'extension', 'c.ts'), (3, 'extension', 'd.ts')) v("position", kind, file)""",
        "rpc_answers": "SELECT * FROM (VALUES (1, NULL, NULL, NULL), (2, NULL, NULL, 27), (3, NULL, false, NULL), (4, NULL, true, NULL), (5, -32601, NULL, NULL), (6, NULL, NULL, NULL), (7, NULL, NULL, NULL), (8, NULL, NULL, NULL)) v(id, code, failed, tools)",
        "command_line": "SELECT * FROM (VALUES (0, 0, true, 'text tokens', 3), (1, 1, false, 'no such', NULL), (2, 1, false, 'docs info', NULL), (3, 0, NULL, NULL, NULL), (4, 0, true, 'schema export', 1)) v(call, code, success, command, fields)",
        "tool_filter": "SELECT k.kind, n.name, CASE n.name WHEN '' THEN 27 ELSE 1 END AS tools FROM (VALUES ('plain'), ('function'), ('input_schema')) k(kind), (VALUES (''), ('Read_Lines')) n(name)",
        "icon_filter": "SELECT 'marks' AS collection, 'mark-' || n AS name FROM (VALUES ('sun'), ('moon'), ('drop'), ('flake'), ('peak'), ('wave'), ('leaf'), ('tree'), ('fish'), ('bowl'), ('spoon'), ('wheel'), ('sail'), ('tent'), ('lamp'), ('drum')) v(n)",
        "manifest_steps": "SELECT e.encoding, s.step, s.id, s.tool FROM (VALUES ('utf-8-sig'), ('utf-16')) e(encoding), (VALUES (0, 'a', 'text_tokens'), (1, NULL, 'größe')) s(step, id, tool)",
        "embedded_media": "SELECT * FROM (VALUES (0, 'image_1.png', 30), (0, 'image_2.png', 40), (1, 'image_1.png', 30), (2, 'image_1.png', 40), (-1, 'a.png', 30), (-1, 'a_2.png', 40)) v(page, name, width)",
        "stream_search": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, {nl})) AS line, generate_subscripts(string_split(text, {nl}), 1) AS n FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, n::INTEGER AS line_number, strlen(split_part(lower(line), 'small robot', 1))::INTEGER + 1 AS column_number FROM l WHERE contains(lower(line), 'small robot')""",
    }
