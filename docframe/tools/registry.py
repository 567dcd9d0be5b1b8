"""Callable tools over files and folders: definitions, argument checks, dispatch and schema export."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from docframe import session
from docframe.formats import convert as conversion, docx, images, package, pdf, xlsx
from docframe.functions import text as X
from docframe.operators import chunking, concat, extract, icons, search, svg
from docframe.sources import decode, files

KINDS = {"string": str, "integer": int, "boolean": bool, "array": list}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    properties: dict[str, tuple[str, str]]
    required: tuple[str, ...]
    run: Callable[..., object]
    options: dict[str, tuple[str, str]]

    @property
    def accepted(self) -> dict[str, tuple[str, str]]:
        """All arguments: those of the schema and the further ones of the command line."""
        return self.properties | self.options

    def schema(self) -> dict:
        props = {k: {"type": t, "description": d, **({"items": {"type": "string"}} if t == "array" else {})} for k, (t, d) in self.properties.items()}
        return {"type": "object", "properties": props, **({"required": list(self.required)} if self.required else {})}


TOOLS: dict[str, Tool] = {}


def tool(description: str, required: str = "", options: dict[str, str] | None = None, **properties: str) -> Callable:
    """Register a function as a tool; properties are ``name="type: description"``, options the same, outside the schema."""

    def parsed(given: dict[str, str]) -> dict[str, tuple[str, str]]:
        return {k: tuple(v.split(": ", 1)) for k, v in given.items()}

    def add(fn: Callable) -> Callable:
        TOOLS[fn.__name__] = Tool(fn.__name__, description, parsed(properties), tuple(required.split()), fn, parsed(options or {}))
        return fn

    return add


def spark() -> SparkSession:
    return SparkSession.getActiveSession() or session.build("local[*]")


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _one(path: str) -> DataFrame:
    return spark().createDataFrame([(path, read(path).decode("utf-8", "replace"))], "path string, text string")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # a tool's answer is shown whole


def _text_tree(folder: str, globs: list[str], exclude: str = "") -> DataFrame:
    tree = files.file_tree(spark(), folder or ".", include=",".join(globs), exclude=exclude, content=True)
    return tree.filter("not is_dir and not is_binary").select("path", F.col("content").cast("string").alias("text"))


def _found(docs: DataFrame, query: str, regex: bool, case: bool, before: int, after: int, scan: bool, limit: int = 0) -> dict:
    """The answer of a search. The documents are decoded once and kept, on disk where memory is short, for the count and the search."""
    docs = docs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scanned = docs.count()
        hits = search.search_lines(docs, "path", "text", query, regex=regex, case_sensitive=case, before=before, after=after, scan=scan)
        shown = _rows(search.capped(hits, "path", limit) if limit else hits.orderBy("path", "line_number"))
    finally:
        docs.unpersist()
    return {"query": query, "is_regex": regex, "total_matches": len(shown), "files_scanned": scanned, "files_matched": len({h["path"] for h in shown}), "matches": shown}


_Q = dict(query="string: text or pattern to find", dir="string: folder to search", regex="boolean: read the query as a pattern", caseSensitive="boolean: respect case", ext="string: extensions, parted by commas", context="integer: lines shown around a match")
_SIDES = dict(before="integer: lines shown before a match", after="integer: lines shown after a match")
_LIMITS = dict(exclude="string: globs of files to leave out, parted by commas", max="integer: most matches returned, 0 for all")


@tool("Find text or a pattern in code and text files, with context lines", "query", _SIDES | _LIMITS, **_Q)
def search_code(query: str, dir: str = ".", regex: bool = False, caseSensitive: bool = False, ext: str = "", context: int = 0, before: int = 0, after: int = 0, exclude: str = "", max: int = 0) -> dict:
    return _found(_text_tree(dir, files.extension_globs(ext), exclude), query, regex, caseSensitive, before or context, after or context, True, max)


@tool("Find text or a pattern in documents (PDF, Word, spreadsheets, CSV, Markdown, text)", "query", _SIDES, **_Q, **_LIMITS)
def search_docs(query: str, dir: str = ".", regex: bool = False, caseSensitive: bool = False, ext: str = "", context: int = 0, before: int = 0, after: int = 0, exclude: str = "", max: int = 0) -> dict:
    tree = files.file_tree(spark(), dir or ".", include=",".join(files.extension_globs(ext)), exclude=exclude, content=True).filter("not is_dir")
    if not ext:
        tree = tree.filter(extract.is_supported(F.col("path")))
    docs = decode.documents(tree).filter("error is null").select("path", "text")
    return _found(docs, query, regex, caseSensitive, before or context, after or context, False, max)


@tool("List files below a folder by a glob on their names", "", dict(dirs="boolean: list folders too", exclude="string: globs to leave out, parted by commas"), pattern="string: glob of the base name", dir="string: folder", depth="integer: deepest level of folders")
def search_files(pattern: str = "", dir: str = ".", depth: int = 0, dirs: bool = False, exclude: str = "") -> list:
    tree = files.file_tree(spark(), dir or ".", include=pattern, exclude=exclude, depth=depth, dirs=dirs)
    return _rows(tree.select("path", "name", "size", "mod_time", "is_dir").orderBy(F.split("path", "/")))


@tool("Read a range of lines of a file", "filePath", filePath="string: file", start="integer: first line, from 1", end="integer: last line, 0 for all", context="integer: lines around the range")
def read_lines(filePath: str, start: int = 1, end: int = 0, context: int = 0) -> dict:
    lines = _rows(search.read_lines(_one(filePath), "path", "text", start, end, context))
    total = lines[0]["total_lines"] if lines else 0
    return {"file_path": filePath, "start_line": max(start, 1), "end_line": min(end, total) if end > 0 else total, "total_lines": total, "lines": [{k: x[k] for k in ("line_number", "content", "byte_length")} for x in lines]}


def _edit(path: str, value) -> dict:
    row = _one(path).select(value.alias("e")).select("e.*").first()
    files.write_atomic(path, row["text"].encode())
    return {"file_path": path, "lines_affected": row["lines_affected"], "total_lines": row["total_lines"], "bytes_written": row["bytes_written"]}


@tool("Replace a range of lines of a file in one step", "filePath start content", filePath="string: file", start="integer: first line", end="integer: last line", content="string: new text, empty to delete")
def replace_lines(filePath: str, start: int, content: str, end: int = 0) -> dict:
    return _edit(filePath, X.replace_lines(F.col("text"), start, end, content))


@tool("Insert text before or after a line", "filePath line content", filePath="string: file", line="integer: line, from 1", content="string: text", before="boolean: insert before the line instead of behind it")
def insert_lines(filePath: str, line: int, content: str, before: bool = False) -> dict:
    return _edit(filePath, X.insert_lines(F.col("text"), line, content, before))


@tool("Delete a range of lines", "filePath start", filePath="string: file", start="integer: first line", end="integer: last line")
def delete_lines(filePath: str, start: int, end: int = 0) -> dict:
    return _edit(filePath, X.delete_lines(F.col("text"), start, end))


def _read_each(batches):
    """Texts of the files named in the second column; they are read where they are used, one after another."""
    for part in batches:
        for i, path in zip(part["i"], part["path"]):
            yield pd.DataFrame({"i": [i], "path": [path], "text": [read(path).decode("utf-8", "replace")]})


@tool("Join files in order, with header, delimiter and line numbers", "patterns", dict(lineNumbers="boolean: number the lines", skipEmpty="boolean: leave out files without a line"), patterns="array: paths or globs", output="string: where to write", header="string: header with %f, %b and %n", delimiter="string: line between files")
def concat_files(patterns: list, output: str = "", header: str = "", delimiter: str = "", lineNumbers: bool = False, skipEmpty: bool = False) -> dict:
    paths = files.expand([p.strip() for p in patterns if p.strip()])
    if skipEmpty:
        paths = [p for p in paths if os.path.getsize(p)]
    ends, total, size, shown = [], 0, 0, []
    if paths:
        names = spark().createDataFrame(list(enumerate(paths)), "i int, path string").repartition(1)
        texts = names.mapInPandas(_read_each, "i int, path string, text string")
        parts = texts.select(concat.part(F.col("text"), F.col("path"), F.col("i"), header, delimiter, lineNumbers).alias("p"))

        def lines():
            nonlocal total, size
            for row in parts.toLocalIterator():  # a file at a time, in order
                for x in row["p"]:
                    total, size = total + 1, size + len(x.encode()) + 1
                    yield x + "\n"

        ends = lines()
        if output:
            files.write_atomic(output, (x.encode() for x in ends))
        else:
            shown = list(ends)
    elif output:
        files.write_atomic(output, b"")
    return {"files_processed": len(paths), "total_lines": total, "total_bytes": size, "input_files": paths, **({"output_file": output} if output else {"content": "".join(shown)})}


@tool("Clean a file: ANSI codes, characters, blank lines, trailing blanks, a pattern", "filePath", dict(removeChars="string: characters to remove", asciiOnly="boolean: remove other characters than ASCII", normalize="string: line endings, lf or crlf"), filePath="string: file", stripAnsi="boolean: remove ANSI codes", stripBlank="boolean: remove blank lines", trim="boolean: cut trailing blanks", pattern="string: pattern to replace", replace="string: replacement")
def clean_file(filePath: str, stripAnsi: bool = False, stripBlank: bool = False, trim: bool = False, pattern: str = "", replace: str = "", removeChars: str = "", asciiOnly: bool = False, normalize: str = "") -> dict:
    if normalize.lower() not in ("", "lf", "crlf"):
        raise ValueError("normalize is lf or crlf")
    o = X.Clean(stripAnsi, removeChars, asciiOnly, pattern, replace, trim, stripBlank, normalize.lower() == "crlf")
    row = _one(filePath).select(X.clean(F.col("text"), o).alias("c")).select("c.*").first().asDict()
    files.write_atomic(filePath, row.pop("text").encode())
    return {"file_path": filePath} | row


def _source(filePath: str, text: str) -> str:
    if not (filePath or text):
        raise ValueError("a file or a text is needed")
    return decode.text_of(filePath, read(filePath)) if filePath else text


@tool("Cut a file into chunks of at most so many tokens", "", dict(text="string: text instead of a file"), filePath="string: file", maxTokens="integer: most tokens of a chunk", overlap="integer: tokens shared by neighbours", bySentence="boolean: cut between sentences")
def text_chunk(filePath: str = "", text: str = "", maxTokens: int = 0, overlap: int = 0, bySentence: bool = False) -> dict:
    df = spark().createDataFrame([(1, _source(filePath, text))], "id int, text string")
    got = [{k: v for k, v in r.items() if k != "id"} for r in _rows(chunking.chunks(df, "id", "text", maxTokens, overlap, bySentence).orderBy("index"))]
    most, lap = chunking.limits(maxTokens, overlap)
    return {"total_chunks": len(got), "total_tokens": sum(c["tokens"] for c in got), "max_tokens": most, "overlap_tokens": lap, "chunks": got}


@tool("Estimate the tokens of a file", "", dict(text="string: text instead of a file"), filePath="string: file")
def text_tokens(filePath: str = "", text: str = "") -> dict:
    df = spark().createDataFrame([(_source(filePath, text),)], "text string")
    named = {"file_path": filePath, "format": decode.format_of(filePath)} if filePath else {}
    return named | df.select(X.token_estimate(F.col("text")).alias("e")).select("e.*").first().asDict()


@tool("Describe the sheets of a workbook", "filePath", filePath="string: workbook")
def sheets_info(filePath: str) -> dict:
    got = xlsx.info(read(filePath))
    return {"file_path": filePath, "sheet_count": len(got), "sheets": got}


@tool("Set a cell", "filePath cell value", filePath="string: workbook", sheet="string: sheet, the first by default", cell="string: address such as B2", value="string: number, boolean or text")
def sheets_set_cell(filePath: str, cell: str, value: str, sheet: str = "") -> dict:
    files.write_atomic(filePath, xlsx.set_cell(read(filePath), cell, value, sheet))
    return {"cell": cell, "value": value}


@tool("Read a cell", "filePath cell", filePath="string: workbook", sheet="string: sheet", cell="string: address")
def sheets_get_cell(filePath: str, cell: str, sheet: str = "") -> dict:
    return {"cell": cell, "value": xlsx.get_cell(read(filePath), cell, sheet)}


@tool("Append a row", "filePath values", filePath="string: workbook", sheet="string: sheet", values="array: texts of the cells")
def sheets_add_row(filePath: str, values: list, sheet: str = "") -> dict:
    data, row = xlsx.add_row(read(filePath), [str(v) for v in values], sheet)
    files.write_atomic(filePath, data)
    return {"row": row}


@tool("Text of a Word document; Markdown when asked for", "filePath", filePath="string: document", asMarkdown="boolean: as Markdown")
def docs_read(filePath: str, asMarkdown: bool = False) -> dict:
    return {"content": (docx.to_markdown if asMarkdown else docx.to_text)(read(filePath))}


@tool("Picture of a Word document's first page", "filePath outputPng", filePath="string: document", outputPng="string: PNG file")
def docs_snapshot(filePath: str, outputPng: str) -> dict:
    files.write_atomic(outputPng, images.snapshot(docx.to_markdown(read(filePath)).split("\n"), os.path.basename(filePath)))
    return {"output": outputPng}


@tool("Text of a PDF, whole or by page", "filePath", filePath="string: PDF", byPage="boolean: one text per page")
def pdf_read(filePath: str, byPage: bool = False) -> dict:
    data = read(filePath)
    return {"pages": pdf.pages(data)} if byPage else {"content": pdf.text(data)}


@tool("Pictures of PDF pages, drawn from their text: one, a range, or all", "filePath outputTarget", {"from": "integer: first page of a range", "to": "integer: last page of a range"}, filePath="string: PDF", outputTarget="string: PNG file; for several pages a folder or a pattern with %d", page="integer: page, from 1", all="boolean: every page")
def pdf_snapshot(filePath: str, outputTarget: str, page: int = 1, all: bool = False, **limits: int) -> dict:
    found = pdf.pages(read(filePath))
    several = all or limits.get("from", 0) > 0 or limits.get("to", 0) > 0
    first, last = pdf.page_range(len(found), limits.get("from", 0), limits.get("to", 0)) if several and found else (min(max(page, 1), max(len(found), 1)),) * 2
    if several and "%d" not in outputTarget:
        stem = os.path.splitext(outputTarget)[0] if outputTarget.lower().endswith(".png") else os.path.join(outputTarget, "page")
        outputTarget = stem + "_%d.png"
    out = []
    for n in range(first, last + 1):
        name = outputTarget.replace("%d", str(n))
        os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
        files.write_atomic(name, images.snapshot(found[n - 1].split("\n") if found else [], f"{os.path.basename(filePath)} {n}/{len(found)}"))
        out.append(name)
    return {"outputs": out}


# ``from`` is no name for a parameter, but it is one of the arguments
TOOLS["pdf_snapshot"].properties.update(TOOLS["pdf_snapshot"].options)
TOOLS["pdf_snapshot"].options.clear()


@tool("Save the pictures embedded in a document", "documentPath outputDir", documentPath="string: document", outputDir="string: folder", page="integer: of a PDF, only this page")
def image_extract(documentPath: str, outputDir: str, page: int = 0) -> dict:
    data = read(documentPath)
    os.makedirs(outputDir, exist_ok=True)
    out = []
    for name, body in pdf.embedded_images(data, page) if decode.format_of(documentPath) == "pdf" else package.media(data):
        out.append(os.path.join(outputDir, name))
        files.write_atomic(out[-1], body)
    return {"images": out, "count": len(out)}


@tool("Convert a file to another format", "input output", dict(delimiter="string: delimiter of a CSV", quality="integer: quality of a JPEG, 1 to 100"), input="string: file", output="string: file, its extension names the format", sheet="string: sheet of a workbook")
def convert(input: str, output: str, sheet: str = "", delimiter: str = ",", quality: int = 0) -> dict:
    files.write_atomic(output, conversion.convert(read(input), input, output, sheet=sheet, delimiter=delimiter[:1] or ",", quality=quality))
    return {"output": output}


@tool("Links, e-mail addresses and dates of a document", "filePath", filePath="string: document")
def extract_links(filePath: str) -> dict:
    df = spark().createDataFrame([(1, decode.text_of(filePath, read(filePath)))], "id int, text string")
    row = extract.links(df, "id", "text").first().asDict()
    return {"urls": row["urls"], "emails": row["emails"], "dates": row["dates"]}


@tool("Tables of a document", "filePath", filePath="string: document")
def extract_tables(filePath: str) -> dict:
    known = decode.format_of(filePath) in ("docx", "xlsx", "csv")
    got = decode.tables_of(filePath, read(filePath))
    return {"format": conversion.extension(filePath) if known else "unsupported", "table_count": len(got), "tables": [{"index": i, "rows": t} for i, t in enumerate(got)]}


@tool("Metadata of a document", "filePath", filePath="string: document")
def extract_metadata(filePath: str) -> dict:
    kind = conversion.extension(filePath) or "text"
    return {"file_path": filePath, "format": kind} | decode.metadata_of(filePath, read(filePath))


@tool("Search icons", "query", query="string: words", collection="string: collection", limit="integer: most icons")
def icon_search(query: str, collection: str = "", limit: int = 0) -> dict:
    got = _rows(icons.search(icons.catalogue(spark()), query, collection, limit).drop("ordinal"))
    return {"query": query, "total": len(got), "source": "catalogue", "icons": got}


@tool("One icon as SVG, React component or data URI", "icon", dict(strokeWidth="string: stroke width", width="integer: width", height="integer: height"), icon="string: id, name or keyword", color="string: colour", size="integer: width and height", format="string: svg, jsx or data-uri", outputPath="string: file to save it in")
def icon_get(icon: str, color: str = "", size: int = 0, format: str = "svg", outputPath: str = "", strokeWidth: str = "", width: int = 0, height: int = 0) -> dict:
    hit = icons.get(icons.catalogue(spark()), icon)
    if not hit:
        raise ValueError(f"no icon {icon!r}")
    col = svg.adjust(F.lit(hit[2]), size=size, width=width, height=height, stroke_width=strokeWidth, color=color)
    made = {"jsx": svg.to_jsx(col, F.lit(hit[1])), "react": svg.to_jsx(col, F.lit(hit[1])), "datauri": svg.data_uri(col), "data-uri": svg.data_uri(col)}.get(format.lower(), col)
    content = spark().range(1).select(made.alias("c")).first()["c"]
    if outputPath:
        os.makedirs(os.path.dirname(outputPath) or ".", exist_ok=True)
        files.write_atomic(outputPath, content.encode())
    return {"id": f"{hit[0]}:{hit[1]}", "collection": hit[0], "name": hit[1], "content": content} | ({"saved_path": outputPath} if outputPath else {})


@tool("Inline SVG elements of a markup file", "source", source="string: file", outputDir="string: folder to save them in")
def icon_scrape(source: str, outputDir: str = "") -> dict:
    df = spark().createDataFrame([(1, svg.load(source))], "id int, html string")
    got = _rows(svg.named(svg.scrape(df, "id", "html"), "id").orderBy("index").drop("id"))
    if outputDir:
        os.makedirs(outputDir, exist_ok=True)
        for g in got:
            g["saved_path"] = os.path.join(outputDir, g["file_name"])
            files.write_atomic(g["saved_path"], g["svg"].encode())
    return {"source": source, "total": len(got), "svgs": got}


def definitions(name: str = "") -> list[Tool]:
    out = [t for t in TOOLS.values() if not name or t.name.lower() == name.lower()]
    if not out:
        raise KeyError(f"no tool {name!r}")
    return out


def export(kind: str = "plain", name: str = "") -> list[dict]:
    """Tool definitions in one of three shapes: ``plain`` (inputSchema), ``function`` (a typed wrapper) or ``input_schema``."""
    out = []
    for t in definitions(name):
        if kind in ("function", "openai"):
            out.append({"type": "function", "function": {"name": t.name, "description": t.description, "parameters": t.schema()}})
        elif kind in ("input_schema", "anthropic"):
            out.append({"name": t.name, "description": t.description, "input_schema": t.schema()})
        else:
            out.append({"name": t.name, "description": t.description, "inputSchema": t.schema()})
    return out


def check(t: Tool, arguments: dict) -> str:
    """What is wrong with the arguments of a tool, or nothing."""
    for r in t.required:
        if r not in arguments:
            return f"missing argument {r!r}"
    for k, v in arguments.items():
        if k not in t.accepted:
            return f"unknown argument {k!r}"
        kind = KINDS[t.accepted[k][0]]
        if not isinstance(v, kind) or (kind is int and isinstance(v, bool)):
            return f"argument {k!r} must be {t.accepted[k][0]}"
    return ""


def dispatch(name: str, arguments: dict | str) -> tuple[str, bool]:
    """(answer as JSON or error text, is it an error)."""
    t = TOOLS.get(name)
    if t is None:
        return f"unknown tool: {name}", True
    try:
        args = json.loads(arguments) if isinstance(arguments, str) else arguments
    except ValueError as x:
        return f"arguments are no JSON: {x}", True
    if not isinstance(args, dict):
        return "arguments must be an object", True
    if wrong := check(t, args):
        return wrong, True
    try:
        return json.dumps(t.run(**args), ensure_ascii=False, indent=2, default=str), False
    except Exception as x:
        return f"{type(x).__name__}: {x}", True
