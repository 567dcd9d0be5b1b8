"""Registered queries of the format operators: round trips of table rows through real documents, with SQL."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docframe.formats import convert, docx, images, jpeg, package, pdf, xlsx
from docframe.sources import decode, files
from docframe.session import shared_folder, table
from docframe.tools import registry, server


def _arrow(fn, kind: str):
    """A function of single values as an Arrow-batched one; nulls stay null."""

    @F.pandas_udf(kind)
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in col], dtype=object)

    return run


def _nations_csv(spark: SparkSession, d: str) -> DataFrame:
    """One CSV document per region with its nations, a header first."""
    row = F.struct("n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit(' & ""co"""'))).alias("l"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["l"])
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), F.array_join(lines, "\n")).alias("t"))


def _workbooks(spark: SparkSession, d: str) -> DataFrame:
    made = decode.encode(_nations_csv(spark, d), "n_regionkey", "t", "xlsx")
    return made.select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit(".xlsx")).alias("path"), "content")


def sheet_roundtrip(spark, d):
    return decode.cells(_workbooks(spark, d)).select("path", "sheet", "row", "col", "value")


def sheet_info(spark, d):
    return decode.sheet_info(_workbooks(spark, d)).select("path", "name", "index", "row_count", "col_count", "headers")


def sheet_edit(spark, d):
    """A cell set and a row added to every workbook, then read as CSV."""

    def edit(data):
        data = xlsx.set_cell(bytes(data), "B2", "12.5")
        data, n = xlsx.add_row(data, ["total", f" rows {len(xlsx.read(data)[0][1])} "])
        return xlsx.to_csv(data)

    return _workbooks(spark, d).select("path", _arrow(edit, "string")("content").alias("csv"))


def sheet_edit_keeps(spark, d):
    """What a workbook with a formula, a style, a merged range, a chart part and a picture still holds after a cell set and a row added."""

    def kept(data):
        parts = package.read(bytes(data))
        sheet = parts["xl/worksheets/sheet1.xml"].decode()
        sheet = sheet.replace("</sheetData>", '<row r="20"><c r="A20" s="3"><f>SUM(A2:A9)</f><v>7</v></c><c r="B20" s="3"/></row></sheetData><mergeCells count="1"><mergeCell ref="C1:D1"/></mergeCells>')
        extra = {"xl/media/image1.png": images.snapshot([], "", 30, 20), "xl/styles.xml": b"<styleSheet/>", "xl/charts/chart1.xml": b"<c:chart/>"}
        before = parts | extra | {"xl/worksheets/sheet1.xml": sheet.encode()}
        edited = xlsx.set_cell(xlsx.set_cell(package.write(before), "A3", "42"), "B20", "true")
        edited, row = xlsx.add_row(edited, ["end"])
        after = package.read(edited)
        now = after["xl/worksheets/sheet1.xml"].decode()
        return {
            "value": xlsx.get_cell(edited, "A3"), "row": row, "last": xlsx.get_cell(edited, f"A{row}"), "formula": "<f>SUM(A2:A9)</f>" in now, "style": '<c r="B20" s="3" t="b">' in now,
            "merged": '<mergeCell ref="C1:D1"/>' in now, "others": all(after[k] == v for k, v in before.items() if k != "xl/worksheets/sheet1.xml") and set(after) == set(before),
        }

    kind = "value string, row int, last string, formula boolean, style boolean, merged boolean, others boolean"

    @F.pandas_udf(kind)
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kept(x) for x in col], columns=[c.split()[0] for c in kind.split(", ")])

    return _workbooks(spark, d).select("path", run("content").alias("k")).select("path", "k.*")


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("# Region "), "r_name", F.lit("\n\n- first **item**\n\n| key | name |\n|---|---|\n| "), F.col("r_regionkey").cast("string"), F.lit(" | "), "r_name", F.lit(" |\n\nIts number is "), F.col("r_regionkey").cast("string"), F.lit("."))
    return table(spark, d, "region").select("r_regionkey", body.alias("t"))


def _word(spark, d):
    made = decode.encode(_markdown(spark, d), "r_regionkey", "t", "docx")
    return made.select(F.concat(F.col("r_regionkey").cast("string"), F.lit(".docx")).alias("path"), "content")


def docx_text(spark, d):
    return decode.documents(_word(spark, d)).select("path", "format", "text")


def docx_tables(spark, d):
    return decode.tables(_word(spark, d)).select("path", "index", F.to_json("rows").alias("rows"))


def docx_metadata(spark, d):
    return decode.metadata(_word(spark, d)).select("path", "paragraphs", "tables", "words")


def docx_markdown(spark, d):
    edit = _arrow(lambda b: docx.to_markdown(docx.append(docx.replace_text(bytes(b), "first", "1st <&>")[0], "The end", 2)), "string")
    return _word(spark, d).select("path", edit("content").alias("markdown"))


def pdf_pages(spark, d):
    made = decode.encode(_markdown(spark, d), "r_regionkey", "t", "pdf").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(".pdf")).alias("path"), "content")
    return decode.pages(made).select("path", "page", "text")


def pdf_words(spark, d):
    """Words of every document that is not null, of any letters, after a round trip through PDF pages: none may be lost."""
    count = _arrow(lambda t: len(pdf.text(pdf.from_pages([t])).split()), "int")
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", count("text").alias("words"))


def docx_stable(spark, d):
    """Is the Markdown of every document's Word file the Markdown of a Word file made from it again?"""

    def stable(text):
        once = docx.to_markdown(docx.from_markdown(text))
        return docx.to_markdown(docx.from_markdown(once)) == once

    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", _arrow(stable, "boolean")("text").alias("stable"))


def sheet_tables(spark, d):
    """Every result's tables as a workbook, a sheet for each and a cell for each raw record, read back: sheets, records, characters."""

    def counts(tables):
        book = xlsx.write([(f"table {i}", [[r or ""] for r in (t["rows"] if t is not None and t["rows"] is not None else [])]) for i, t in enumerate(tables)])
        cells = [v for _, rows in xlsx.read(book) for row in rows for v in row if v]
        return {"sheets": len(xlsx.read(book)), "records": len(cells), "characters": sum(map(len, cells))}

    kind = "sheets int, records int, characters bigint"

    @F.pandas_udf(kind)
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(x) for x in col], columns=["sheets", "records", "characters"])

    src = table(spark, d, "tables_results", "result_id", "tables").filter("size(tables) > 0")
    return src.select("result_id", run("tables").alias("k")).select("result_id", "k.*")


def pdf_split_merge(spark, d):
    """Pages 2 to 3 of the three regions' documents merged."""

    def run(keys, texts):
        merged = pdf.merge([pdf.from_markdown(t) for _, t in sorted(zip(keys, texts))])
        return pdf.pages(pdf.split(merged, 2, 3))

    one = _markdown(spark, d).agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "t"))).alias("a"))
    call = _arrow(lambda a: run([x["r_regionkey"] for x in a], [x["t"] for x in a]), "array<string>")
    return one.select(F.posexplode(call("a")).alias("page", "text"))


def image_roundtrip(spark, d):
    """PNG, GIF and PDF of a drawn picture per region, by their headers and embedded images."""

    def rows(key):
        png = images.snapshot([f"region {key}", "x " * 30], "t", 200 + key, 100)
        gif = images.to_gif(images.from_png(png))
        inner = pdf.embedded_images(pdf.from_images([png, gif]))
        return [{"kind": k, "width": m["width"], "height": m["height"]} for k, m in (("png", images.info(png)), ("gif", images.info(gif)), *((f"pdf{i}", images.info(b)) for i, (_, b) in enumerate(inner)))]

    call = _arrow(rows, "array<struct<kind:string,width:int,height:int>>")
    return table(spark, d, "region", "r_regionkey").select("r_regionkey", F.explode(call("r_regionkey")).alias("x")).select("r_regionkey", "x.*")


def image_info(spark, d):
    """Header scan of drawn pictures, and of one that is none."""
    draw = _arrow(lambda k: images.to_gif(images.from_png(images.snapshot([], "", 30 + k, 20))) if k % 2 else images.snapshot([], "", 30 + k, 20), "binary")
    src = table(spark, d, "region", "r_regionkey").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(".img")).alias("path"), draw("r_regionkey").alias("content"))
    src = src.union(spark.createDataFrame([("none.img", b"text")], "path string, content binary"))
    return decode.image_info(src).select("path", "format", "width", "height", "aspect_ratio", F.col("error").isNotNull().alias("failed"))


def media_extract(spark, d):
    """Pictures embedded in PDF and zip documents, by name and width."""

    def rows(key):
        png = images.snapshot([], "", 40 + key, 20)
        made = {f"{key}.pdf": pdf.from_images([png, png]), f"{key}.pptx": package.write({"ppt/media/a.png": png, "x/media/a.png": png, "ppt/slide.xml": "<a/>"})}
        return [{"path": k, "content": v} for k, v in made.items()]

    call = _arrow(rows, "array<struct<path:string,content:binary>>")
    docs = table(spark, d, "region", "r_regionkey").select(F.explode(call("r_regionkey")).alias("x")).select("x.*")
    width = _arrow(lambda b: images.info(bytes(b))["width"], "int")
    return decode.media(docs).select("path", "name", width("data").alias("width"))


def convert_matrix(spark, d):
    """Every conversion of the registry from a small document of its source format: the head of what comes out."""
    md = b"# T\n\nbody"
    png = images.snapshot([], "", 30, 20)
    px = images.from_png(png)
    start = {"md": md, "docx": docx.from_markdown(md.decode()), "pdf": pdf.from_markdown(md.decode()), "csv": b"a,b\n1,2\n", "xlsx": xlsx.from_csv("a,b\n1,2\n"), "png": png, "gif": images.to_gif(px), "jpg": images.to_jpeg(px), "jpeg": images.to_jpeg(px)}
    rows = [(a, b, start[a]) for a, b in convert.PAIRS]

    def head(x):
        out = convert.convert(bytes(x["data"]), f"x.{x['source']}", f"x.{x['target']}")
        return {b"PK": "zip", b"%P": "pdf", b"\x89P": "png", b"GI": "gif", b"\xff\xd8": "jpeg"}.get(out[:2], out.decode("utf-8", "replace").strip())

    @F.pandas_udf("string")
    def run(part: pd.DataFrame) -> pd.Series:
        return pd.Series([head(x) for x in part.to_dict("records")], dtype=object)

    src = spark.createDataFrame(rows, "source string, target string, data binary")
    return src.select("source", "target", run(F.struct("source", "target", "data")).alias("result"))


def jpeg_roundtrip(spark, d):
    """Pictures with a gradient per part, through JPEG on the executors, many at a time: size, and whether no sample is off by more than 8 in 255.

    A picture costs far more than its key: the keys are spread, as the table may be a single piece that one task reads.
    """

    def picture(key):
        w, h = 16 + key % 50, 9 + key % 23
        px = np.full((h, w, 4), 255, np.uint8)
        px[..., 0], px[..., 1], px[..., 2] = np.linspace(0, 255, w)[None], np.linspace(255, 0, h)[:, None], key % 256
        return px

    def run(batches):
        for batch in batches:
            pictures = [picture(key) for key in batch.column(0).to_pylist()]
            back = [(x.shape[1], x.shape[0], bool(np.abs(x.astype(int) - px).max() <= 8)) for x, px in zip(jpeg.decode_many(jpeg.encode_many(pictures, 95)), pictures, strict=True)]
            width, height, near = zip(*back) if back else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(near, pa.bool_())], names=["p_partkey", "width", "height", "near"])

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = table(spark, d, "part", "p_partkey").filter(F.col("p_partkey").isNotNull()).repartition(spread, "p_partkey")
    schema = T.StructType([keys.schema[0], *T._parse_datatype_string("width int, height int, near boolean").fields])
    return keys.mapInArrow(run, schema)


_FILES = ("a.js", "src/b.js", "src/c.css", "src/.hidden.js", "node_modules/d.js", "src/deep/e.js", "src/deep/deeper/f.js", ".git/g.js", "h.min.js")


def _folder(spark: SparkSession) -> str:
    """A small tree in the folder that all executors share."""
    root = os.path.join(shared_folder(spark).removeprefix("file:").replace("//", "/"), "docframe-sample-tree")
    for name in _FILES:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if not os.path.exists(path):
            files.write_atomic(path, f"// {name}\nlet x = 1;\n".encode())
    return root


def file_scan(spark, d):
    """Listing of a small folder with globs, exclusion and depth."""
    root = _folder(spark)
    tree = files.file_tree(spark, root, include="*.js", exclude="*.min.js", depth=2)
    return tree.select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("file"), "size", "is_dir", "is_binary")


def tool_schema(spark, d):
    """Every argument of every tool, with its type and whether it is required."""
    rows = [(t["name"], k, v["type"], k in t["inputSchema"].get("required", [])) for t in registry.export() for k, v in t["inputSchema"]["properties"].items()]
    return spark.createDataFrame(rows, "name string, argument string, type string, required boolean")


def batch_run(spark, d):
    steps = [{"tool": "text_tokens", "arguments": {"text": "one two three"}}, {"id": "x", "tool": "nothing"}, {"tool": "icon_search", "arguments": {"query": "noon", "limit": "no"}}]
    out = server.run_batch(steps)["data"]["steps"]
    return spark.createDataFrame([(s["id"], s["tool"], s["success"]) for s in out], "id string, tool string, success boolean")


def queries() -> dict:
    named = (sheet_roundtrip, sheet_info, sheet_edit, sheet_edit_keeps, jpeg_roundtrip, docx_text, docx_tables, docx_metadata, docx_markdown, pdf_pages, pdf_words, docx_stable, sheet_tables, pdf_split_merge, image_roundtrip, image_info, media_extract, convert_matrix, file_scan, tool_schema, batch_run)
    return {f.__name__: f for f in named}


# White space, and a record without the characters that XML cannot hold.
_BLANK = r"\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_KEPT = r"regexp_replace(coalesce(r, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"

# The tools and their arguments, ! where required.
_ARGUMENTS = """search_code query!:string,dir:string,regex:boolean,caseSensitive:boolean,ext:string,context:integer
search_files pattern:string,dir:string,depth:integer
read_lines filePath!:string,start:integer,end:integer,context:integer
replace_lines filePath!:string,start!:integer,end:integer,content!:string
insert_lines filePath!:string,line!:integer,content!:string,before:boolean
delete_lines filePath!:string,start!:integer,end:integer
concat_files patterns!:array,output:string,header:string,delimiter:string
clean_file filePath!:string,stripAnsi:boolean,stripBlank:boolean,trim:boolean,pattern:string,replace:string
sheets_info filePath!:string
sheets_set_cell filePath!:string,cell!:string,value!:string,sheet:string
sheets_get_cell filePath!:string,cell!:string,sheet:string
sheets_add_row filePath!:string,values!:array,sheet:string
docs_read filePath!:string,asMarkdown:boolean
docs_snapshot filePath!:string,outputPng!:string
pdf_read filePath!:string,byPage:boolean
pdf_snapshot filePath!:string,outputTarget!:string,page:integer,all:boolean,from:integer,to:integer
image_extract documentPath!:string,outputDir!:string,page:integer
convert input!:string,output!:string,sheet:string
search_docs query!:string,dir:string,regex:boolean,caseSensitive:boolean,ext:string,exclude:string,context:integer,max:integer
text_chunk filePath:string,maxTokens:integer,overlap:integer,bySentence:boolean
text_tokens filePath:string
extract_links filePath!:string
extract_tables filePath!:string
extract_metadata filePath!:string
icon_search query!:string,collection:string,limit:integer
icon_get icon!:string,color:string,size:integer,format:string,outputPath:string
icon_scrape source!:string,outputDir:string"""


def oracle_sql() -> dict[str, str]:
    nl = "chr(10)"
    cells = """c AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS r, n_nationkey, n_name || ' & "co"' AS n FROM nation),
      grid AS (SELECT DISTINCT n_regionkey, 1 AS r, 'key' AS k, 'name' AS n FROM nation UNION ALL SELECT n_regionkey, r, n_nationkey::VARCHAR, n FROM c)"""
    page = f"'Region ' || r_name || {nl} || chr(8226) || ' first item' || {nl} || 'key name' || {nl} || r_regionkey::VARCHAR || ' ' || r_name || {nl} || 'Its number is ' || r_regionkey::VARCHAR || '.'"
    return {
        "sheet_roundtrip": f"""WITH {cells} SELECT 'region' || n_regionkey::VARCHAR || '.xlsx' AS path, 'Sheet1' AS sheet, r::INTEGER AS "row", col, CASE WHEN col = 1 THEN k ELSE n END AS value FROM grid, (VALUES (1), (2)) v(col)""",
        "sheet_info": """SELECT 'region' || n_regionkey::VARCHAR || '.xlsx' AS path, 'Sheet1' AS name, 0 AS "index", (count(*) + 1)::INTEGER AS row_count, 2 AS col_count, ['key', 'name'] AS headers FROM nation GROUP BY n_regionkey""",
        "sheet_edit": f"""WITH {cells}, e AS (SELECT n_regionkey, r, k || ',' || CASE WHEN r = 2 THEN '12.5' WHEN r = 1 THEN n ELSE '"' || replace(n, '"', '""') || '"' END AS l FROM grid)
          SELECT 'region' || n_regionkey::VARCHAR || '.xlsx' AS path, string_agg(l, {nl} ORDER BY r) || {nl} || 'total,rows ' || count(*)::VARCHAR || {nl} AS csv FROM e GROUP BY n_regionkey""",
        "sheet_edit_keeps": """SELECT 'region' || n_regionkey::VARCHAR || '.xlsx' AS path, '42' AS value, 21 AS "row", 'end' AS last, true AS formula, true AS style, true AS merged, true AS others FROM nation GROUP BY n_regionkey""",
        "jpeg_roundtrip": "SELECT p_partkey, (16 + p_partkey % 50)::INTEGER AS width, (9 + p_partkey % 23)::INTEGER AS height, true AS near FROM part",
        "tool_schema": f"SELECT split_part(t, ' ', 1) AS name, rtrim(split_part(a, ':', 1), '!') AS argument, split_part(a, ':', 2) AS type, contains(a, '!') AS required FROM (SELECT t, unnest(string_split(split_part(t, ' ', 2), ',')) AS a FROM (SELECT unnest(string_split('{_ARGUMENTS}', chr(10))) AS t))",
        "docx_text": f"""SELECT r_regionkey::VARCHAR || '.docx' AS path, 'docx' AS format, 'Region ' || r_name || {nl} || 'first item' || {nl} || 'Its number is ' || r_regionkey::VARCHAR || '.' AS text FROM region""",
        "docx_tables": """SELECT r_regionkey::VARCHAR || '.docx' AS path, 0 AS "index", '[["key","name"],["' || r_regionkey::VARCHAR || '","' || r_name || '"]]' AS rows FROM region""",
        "docx_metadata": "SELECT r_regionkey::VARCHAR || '.docx' AS path, 3::BIGINT AS paragraphs, 1::BIGINT AS tables, (7 + len(string_split(r_name, ' ')))::BIGINT AS words FROM region",
        "docx_markdown": f"""SELECT r_regionkey::VARCHAR || '.docx' AS path, '# Region ' || r_name || {nl} || '- 1st <&> item' || {nl} || '| key | name |' || {nl} || '| ' || r_regionkey::VARCHAR || ' | ' || r_name || ' |' || {nl} || {nl} || 'Its number is ' || r_regionkey::VARCHAR || '.' || {nl} || '## The end' AS markdown FROM region""",
        "pdf_pages": f"SELECT r_regionkey::VARCHAR || '.pdf' AS path, 1 AS page, {page} AS text FROM region",
        "pdf_words": f"SELECT doc_id, len(regexp_extract_all(text, '[^{_BLANK}]+'))::INTEGER AS words FROM documents WHERE text IS NOT NULL",
        "docx_stable": "SELECT doc_id, true AS stable FROM documents WHERE text IS NOT NULL",
        "sheet_tables": f"""WITH t AS (SELECT result_id, len(tables)::INTEGER AS sheets, flatten(list_transform(tables, lambda x: coalesce(x.rows, []))) AS rows FROM tables_results WHERE len(tables) > 0)
          SELECT result_id, sheets, len(list_filter(rows, lambda r: {_KEPT} <> ''))::INTEGER AS records, coalesce(list_sum(list_transform(rows, lambda r: length({_KEPT}))), 0)::BIGINT AS characters FROM t""",
        "pdf_split_merge": f"SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INTEGER AS page, {page} AS text FROM region WHERE r_regionkey IN (SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 2 OFFSET 1)",
        "image_roundtrip": "SELECT r_regionkey, kind, (200 + r_regionkey)::INTEGER AS width, 100 AS height FROM region, (VALUES ('png'), ('gif'), ('pdf0'), ('pdf1')) v(kind)",
        "image_info": """SELECT r_regionkey::VARCHAR || '.img' AS path, CASE WHEN r_regionkey % 2 = 1 THEN 'gif' ELSE 'png' END AS format, (30 + r_regionkey)::INTEGER AS width, 20 AS height, (30 + r_regionkey) / 20.0::DOUBLE AS aspect_ratio, false AS failed FROM region
          UNION ALL SELECT 'none.img', NULL, NULL, NULL, NULL, true""",
        "media_extract": """SELECT r_regionkey::VARCHAR || ext AS path, name, (40 + r_regionkey)::INTEGER AS width FROM region, (VALUES ('.pdf', 'image_1.png'), ('.pdf', 'image_2.png'), ('.pptx', 'a.png'), ('.pptx', 'a_2.png')) v(ext, name)""",
        "convert_matrix": f"""SELECT * FROM (VALUES ('xlsx', 'csv', 'a,b' || {nl} || '1,2'), ('csv', 'xlsx', 'zip'), ('md', 'docx', 'zip'), ('md', 'pdf', 'pdf'), ('md', 'txt', '# T' || {nl} || {nl} || 'body'), ('docx', 'md', '# T' || {nl} || 'body'), ('docx', 'txt', 'T' || {nl} || 'body'), ('docx', 'pdf', 'pdf'),
          ('pdf', 'txt', 'T' || {nl} || 'body'), ('pdf', 'md', 'T' || {nl} || 'body'), ('pdf', 'docx', 'zip'), ('png', 'pdf', 'pdf'), ('png', 'png', 'png'), ('png', 'gif', 'gif'), ('gif', 'pdf', 'pdf'), ('gif', 'png', 'png'), ('gif', 'gif', 'gif')) v(source, target, result)
          UNION ALL SELECT a, b, CASE WHEN b IN ('jpg', 'jpeg') THEN 'jpeg' ELSE b END FROM (VALUES ('png'), ('gif'), ('jpg'), ('jpeg')) x(a), (VALUES ('pdf'), ('png'), ('gif'), ('jpg'), ('jpeg')) y(b)
          WHERE a IN ('jpg', 'jpeg') OR b IN ('jpg', 'jpeg')""",
        "file_scan": "SELECT * FROM (VALUES ('a.js', 19::BIGINT, false, false), ('src/b.js', 23::BIGINT, false, false), ('src/deep/e.js', 28::BIGINT, false, false)) v(file, size, is_dir, is_binary)",
        "batch_run": "SELECT * FROM (VALUES ('step_1', 'text_tokens', true), ('x', 'nothing', false), ('step_3', 'icon_search', false)) v(id, tool, success)",
    }
