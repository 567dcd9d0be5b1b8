import io
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.formats import convert, docx, images, jpeg, package, pdf, pdf_crypt, xlsx
from docframe.operators import icons, svg
from docframe.plans import format_queries
from docframe.sources import decode, files
from docframe.tools import cli, registry, server

MD = "# Head\n\nSome **bold** text.\n\n## Sub\n- one\n- two\n\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\nA paragraph (last)."


def test_docx():
    d = docx.from_markdown(MD)
    assert "# Head" in docx.to_markdown(d) and "| 1 | 2 |" in docx.to_markdown(d) and "- one" in docx.to_markdown(d)
    assert "1" not in docx.to_text(d) and docx.tables(d) == [[["A", "B"], ["1", "2"], ["3", "4"]]]
    d, n = docx.replace_text(d, "Some", "A < B &")
    assert n == 1 and "A < B & bold" in docx.to_text(d)
    assert docx.to_markdown(docx.append(d, "End", 2)).endswith("## End")
    assert docx.to_text(docx.from_markdown("")) == "" and docx.info(docx.from_markdown(""))["paragraph_count"] == 1


def test_docx_replace_across_runs():
    d = docx.from_markdown("Some **bold** text & more.\n\nSome bold text")
    d, n = docx.replace_text(d, "me bold te", "<X>")
    assert n == 2 and docx.to_text(d) == "So<X>xt & more.\nSo<X>xt"
    assert docx.replace_text(d, "amp", "zzz")[1] == 0 and docx.replace_text(d, "", "y")[1] == 0
    assert docx.to_text(docx.replace_text(d, "&", "and ")[0]).startswith("So<X>xt and  more.")


def test_pdf():
    p = pdf.from_markdown(MD)
    assert "Some bold text." in pdf.text(p) and pdf.info(p)["page_count"] == 1
    both = pdf.merge([p, p])
    assert len(pdf.pages(both)) == 2 and len(pdf.pages(pdf.split(both, 2))) == 1
    assert pdf.page_range(5, 0, 99) == (1, 5)
    with pytest.raises(ValueError):
        pdf.page_range(5, 4, 2)
    assert len(pdf.pages(pdf.from_markdown("\n\n".join(["word " * 40] * 80)))) > 1
    assert pdf.pages(b"no pdf") == [] and pdf.text(pdf.from_pages([""])) == ""


def test_xlsx():
    x = xlsx.from_csv("Name,Age,Role\nAnn,30,dev\nBob,41,ops\n")
    assert [(s["name"], s["row_count"]) for s in xlsx.info(x)] == [("Sheet1", 3)]
    x = xlsx.set_cell(x, "A3", "Rob")
    x, row = xlsx.add_row(x, ["Cy", "9", " qa "])
    assert row == 4 and xlsx.get_cell(x, "A3") == "Rob" and xlsx.to_csv(x).splitlines()[3] == "Cy,9,qa"
    assert xlsx.typed("1e3") == 1000.0 and xlsx.typed("true") is True and xlsx.typed(" 1") == " 1" and xlsx.typed("1d") == "1d"
    assert xlsx.address("AB12") == (12, 28) and xlsx.get_cell(x, "ZZ99") == ""
    with pytest.raises(ValueError):
        xlsx.from_csv("a,b\nc")
    with pytest.raises(KeyError):
        xlsx.get_cell(x, "A1", "nosheet")


def test_workbook_edits_keep_the_rest():
    """A formula, styles, a merged range, other parts and the order of cells survive; only the named cell changes."""
    parts = package.read(xlsx.from_csv("a,b\n1,2\n"))
    sheet = parts["xl/worksheets/sheet1.xml"].decode().replace("<sheetData>", '<dimension ref="A1:B2"/><sheetData>').replace("</sheetData>", '<row r="5" spans="1:3" ht="20"><c r="A5" s="7"><f>SUM(A2)</f><v>1</v></c><c r="C5" s="2"/></row></sheetData><mergeCells><mergeCell ref="A7:B7"/></mergeCells>')
    parts |= {"xl/worksheets/sheet1.xml": sheet.encode(), "xl/calcChain.xml": b'<calcChain><c r="A5" i="1"/></calcChain>', "xl/media/a.png": b"png"}
    book = package.write(parts)
    one = package.read(xlsx.set_cell(book, "B5", "x<y"))
    text = one.pop("xl/worksheets/sheet1.xml").decode()
    assert one == {k: v for k, v in parts.items() if k in one} and len(one) == len(parts) - 1
    assert '<row r="5" ht="20"><c r="A5" s="7"><f>SUM(A2)</f><v>1</v></c><c r="B5" t="inlineStr"><is><t xml:space="preserve">x&lt;y</t></is></c><c r="C5" s="2"/></row>' in text and '<mergeCell ref="A7:B7"/>' in text
    assert 'ref="A1:B5"' in text
    two = package.read(xlsx.set_cell(book, "A5", "3"))  # the formula goes, and with it the list of formula cells
    assert '<c r="A5" s="7"><v>3</v></c>' in two["xl/worksheets/sheet1.xml"].decode() and "xl/calcChain.xml" not in two
    three, row = xlsx.add_row(book, ["p", "", " q "])
    assert row == 6 and xlsx.read(three)[0][1][5] == ["p", "", "q"] and xlsx.get_cell(three, "A5") == "1"
    for cell in ("A3", "D1", "A1", "Z9"):
        assert xlsx.get_cell(xlsx.set_cell(book, cell, "new"), cell) == "new"
    empty = xlsx.write([("S", [])])
    assert xlsx.read(xlsx.set_cell(empty, "B2", "1"))[0][1] == [[], ["", "1"]] and xlsx.typed("t") is True
    with pytest.raises(ValueError):
        package.read(book, most=10)


def _jvm_jpeg(spark, px):
    """A JPEG written by another library, with chroma of half size."""
    jvm = spark.sparkContext._jvm
    out = jvm.java.io.ByteArrayOutputStream()
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(images.to_png(px[..., :3].copy())))
    jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    return bytes(out.toByteArray()), jvm


def test_jpeg(spark):
    """Both directions against the JVM's library, odd sizes, quality, grey, broken files."""
    y, x = np.mgrid[0:45, 0:70]
    px = np.stack([x * 3, y * 5, 255 - x * 2 - y, np.full_like(x, 255)], 2).clip(0, 255).astype(np.uint8)
    theirs, jvm = _jvm_jpeg(spark, px)
    assert np.abs(images.decode(theirs).astype(int) - px).mean() < 6
    ours = images.to_jpeg(px, 90)
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(ours))
    rgb = [[back.getRGB(i, j) & 0xFFFFFF for i in range(0, 70, 7)] for j in range(0, 45, 9)]
    want = px[::9, ::7, :3].astype(int)
    got = np.array([[((v >> 16) & 255, (v >> 8) & 255, v & 255) for v in row] for row in rgb])
    assert np.abs(got - want).max() <= 10 and (images.decode(ours)[..., :3].astype(int) - px[..., :3]).__abs__().max() <= 10
    assert len(images.to_jpeg(px, 20)) < len(ours) and images.info(ours)["width"] == 70
    noise = np.random.default_rng(3).integers(0, 255, (24, 17, 4), np.uint8)
    assert images.decode(images.to_jpeg(noise, 100)).shape == noise.shape
    for bad in (b"\xff\xd8\xff\xd9", ours[:100]):
        with pytest.raises(ValueError):
            images.decode(bad)
    assert images.decode(ours[: len(ours) // 2]).shape == px.shape


def test_jpegs_together(spark):
    """Pictures coded and decoded together are those coded and decoded alone, sampled, cut off or with restarts; sizes may differ widely."""
    rng = np.random.default_rng(7)
    pictures = [np.cumsum(rng.integers(0, 4, (int(h), int(w), c)), 1).astype(np.uint8) for h, w, c in zip(rng.integers(1, 40, 40), rng.integers(1, 40, 40), [3, 4] * 20)]
    pictures.append(rng.integers(0, 256, (300, 200, 4), np.uint8))
    for quality in (5, 100):
        files = list(jpeg.encode_many(pictures, quality))
        assert files == [images.to_jpeg(px, quality) for px in pictures]
        files += [f[: max(len(f) - n, f.index(b"\xff\xda") + 15)] for n, f in enumerate(files)]
        for f, px in zip(files, jpeg.decode_many(files), strict=True):
            assert np.array_equal(px, images.decode(f)) and px.shape[2] == 4
    near = jpeg.decode_many(jpeg.encode_many(pictures, 100))
    assert all(np.abs(a[..., :3].astype(int) - b).max() <= 3 for a, b in zip(near, pictures, strict=True) if b.shape[2] == 3)
    theirs = [_jvm_jpeg(spark, px)[0] for px in pictures[:20]]
    assert all(np.array_equal(a, images.decode(b)) for a, b in zip(jpeg.decode_many(theirs), theirs, strict=True))
    assert list(jpeg.encode_many([])) == [] and list(jpeg.decode_many([])) == []
    # the only block again and again, a restart before each
    one = images.to_jpeg(rng.integers(0, 256, (8, 8, 3), np.uint8), 90)
    frame, scan = one.index(b"\xff\xc0"), one.index(b"\xff\xda")
    row = one[: frame + 7] + struct.pack(">H", 160) + one[frame + 9 : scan] + b"\xff\xdd\x00\x04\x00\x01" + one[scan : scan + 14]
    row += b"".join(one[scan + 14 : -2] + bytes((0xFF, 0xD0 + n % 8)) for n in range(19)) + one[scan + 14 :]
    assert np.array_equal(images.decode(row), np.tile(images.decode(one), (1, 20, 1)))


def test_jpeg_roundtrip_is_spread(spark, tmp_path):
    """A table in a single piece is worked on by many tasks, every row once, each task's pictures together."""
    spark.range(7, 607).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = format_queries.jpeg_roundtrip(spark, str(tmp_path))
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    assert out.columns == ["p_partkey", "width", "height", "near"] and out.dtypes[1:] == [("width", "int"), ("height", "int"), ("near", "boolean")]
    assert sorted(map(tuple, out.collect())) == [(k, 16 + k % 50, 9 + k % 23, True) for k in range(7, 607)]


def test_png_depths():
    """1, 2, 4 and 16 bits, palettes, transparent values and interlace, from rows packed here."""
    rng = np.random.default_rng(5)

    def png(w, h, bits, color, rows, more=b"", interlace=0):
        head = images.struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, interlace)
        return images.PNG_MAGIC + images._chunk(b"IHDR", head) + more + images._chunk(b"IDAT", images.zlib.compress(rows)) + images._chunk(b"IEND", b"")

    def packed(px, bits):
        return b"".join(b"\0" + np.packbits(np.unpackbits(r.astype(np.uint8)[:, None], axis=1)[:, -bits:].reshape(-1)).tobytes() for r in px)

    for bits in (1, 2, 4, 8):
        px = rng.integers(0, 1 << bits, (5, 11))
        assert (images.from_png(png(11, 5, bits, 0, packed(px, bits)))[..., 0] == px * (255 // ((1 << bits) - 1))).all()
        passes = b"".join(packed(px[y::dy, x::dx], bits) for x, y, dx, dy in images._PASSES if px[y::dy, x::dx].size)
        assert (images.from_png(png(11, 5, bits, 0, passes, interlace=1))[..., 0] == px * (255 // ((1 << bits) - 1))).all()
    pal = images._chunk(b"PLTE", bytes(range(12))) + images._chunk(b"tRNS", b"\x07")
    got = images.from_png(png(4, 1, 2, 3, packed(np.array([[0, 1, 2, 3]]), 2), pal))
    assert got[0].tolist() == [[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255], [9, 10, 11, 255]]
    deep = images.from_png(png(2, 1, 16, 2, b"\0" + bytes((200, 1, 100, 2, 50, 3, 1, 2, 3, 4, 5, 6)), images._chunk(b"tRNS", bytes((1, 2, 3, 4, 5, 6)))))
    assert deep[0].tolist() == [[200, 100, 50, 255], [1, 3, 5, 0]]
    for kind in range(5):  # every filter against its definition
        raw = rng.integers(0, 256, (6, 12), np.uint8)
        body = b"".join(bytes((kind,)) + r.tobytes() for r in raw)
        out, prev = [], [0] * 12
        for r in raw.tolist():
            cur = []
            for i, v in enumerate(r):
                a, b, c = (cur[i - 3] if i > 2 else 0), prev[i], (prev[i - 3] if i > 2 else 0)
                p = a + b - c
                add = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda z: abs(p - z)))[kind]
                cur.append((v + add) & 255)
            out.append(cur)
            prev = cur
        assert images.unfilter(body, 6, 12, 3).tolist() == out


def test_images():
    px = np.random.default_rng(1).integers(0, 255, (40, 60, 4), np.uint8)
    png = images.to_png(px)
    assert (images.from_png(png) == px).all() and images.info(png)["aspect_ratio"] == 1.5
    gif = images.to_gif(px)
    assert images.from_gif(gif).shape == px.shape and images.info(gif)["format"] == "gif"
    flat = np.full((300, 300, 4), 255, np.uint8)
    assert (images.from_gif(images.to_gif(flat)) == flat).all()
    assert images.info(b"") is None and images.info(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00")["width"] == 32
    doc = pdf.from_images([png, gif])
    assert [images.info(b)["width"] for _, b in pdf.embedded_images(doc)] == [60, 60]
    assert images.info(images.snapshot(["x"] * 200))["height"] == 1100
    assert len(images._GLYPHS) == 69 and images.wrap("aaa " * 40, 20)[0] == "aaa aaa aaa aaa aaa"


def test_media_names():
    z = package.write({"word/media/a.png": b"1", "x/media/a.png": b"2", "word/b.png": b"3"})
    assert package.media(z) == [("a.png", b"1"), ("a_2.png", b"2")]


def test_convert(spark):
    for a, b in (("m.md", "m.docx"), ("m.md", "m.pdf"), ("m.md", "m.txt")):
        assert convert.convert(MD.encode(), a, b)
    d = convert.convert(MD.encode(), "m.md", "m.docx")
    assert b"# Head" in convert.convert(d, "m.docx", "m.md") and convert.convert(d, "m.docx", "m.pdf")[:5] == b"%PDF-"
    png = images.to_png(np.zeros((10, 12, 4), np.uint8))
    jpg = convert.convert(png, "a.png", "a.jpg")
    assert images.info(jpg) == {"format": "jpeg", "width": 12, "height": 10, "aspect_ratio": 1.2, "file_size": len(jpg)}
    assert images.info(convert.convert(jpg, "a.jpg", "a.png"))["format"] == "png"
    for bad in (("a.png", "b.csv"), ("a", "b.pdf")):
        with pytest.raises(ValueError):
            convert.convert(png, *bad)


@pytest.fixture
def folder(tmp_path):
    for name, body in {"src/app.js": "let Alpha = 1;\nuse(alpha);\n", "src/style.css": "a{}", "node_modules/x.js": "alpha", "doc.md": "# T\nalpha here\n", "bin.dat": "a\0b", "empty.txt": "", "t.csv": "a,b\n1,2\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body.encode())
    (tmp_path / "d.docx").write_bytes(docx.from_markdown(MD))
    return tmp_path


def test_file_tree(spark, folder):
    tree = files.file_tree(spark, str(folder), include="*.js")
    assert [r["name"] for r in tree.collect()] == ["app.js"]
    rows = {r["name"]: r for r in files.file_tree(spark, str(folder), dirs=True, content=True).collect()}
    assert rows["bin.dat"]["is_binary"] and rows["empty.txt"]["size"] == 0 and rows["src"]["is_dir"] and bytes(rows["t.csv"]["content"]) == b"a,b\n1,2\n"
    assert files.glob_regex("a[b-c]?.*").match("abx.js") and not files.glob_regex("{a,b}").match("a")
    assert files.extension_globs("js, *.ts,") == ["*.js", "*.ts"]


def test_file_tree_is_walked_by_tasks(spark, tmp_path, monkeypatch):
    """Below the level where the driver stops, tasks list the same entries."""
    for i in range(9):
        for j in range(4):
            p = tmp_path / f"d{i}" / f"e{j}" / "deep"
            p.mkdir(parents=True)
            (p / "f.txt").write_text("x")
            (p.parent / "g.md").write_text("y")
    (tmp_path / "top.txt").write_text("z")
    want = sorted(r["path"] for r in files.file_tree(spark, str(tmp_path), dirs=True).collect())
    assert len(want) == 9 + 36 * 4 + 1
    reader = files._Reader({"root": str(tmp_path), "dirs": "true"})
    monkeypatch.setattr(files, "FOLDERS", 5)
    monkeypatch.setattr(files, "GROUP_FILES", 3)
    parts = reader.partitions()
    assert sum(bool(p.value[1]) for p in parts) >= 5 and max(len(p.value[0]) for p in parts) <= 3
    assert sorted(r[0] for p in parts for r in reader.read(p)) == want
    shallow = files._Reader({"root": str(tmp_path), "depth": "1", "include": "*.txt,*.md"})
    assert sorted(r[1] for p in shallow.partitions() for r in shallow.read(p)) == ["top.txt"]


def test_decode(spark, folder):
    tree = files.file_tree(spark, str(folder), content=True).filter("not is_dir")
    docs = {os.path.basename(r["path"]): r for r in decode.documents(tree).collect()}
    assert docs["d.docx"]["format"] == "docx" and docs["doc.md"]["text"].startswith("# T")
    broken = spark.createDataFrame([("x.docx", b"nozip")], "path string, content binary")
    assert decode.documents(broken).first()["format"] == "unknown" and [(r["value"], r["error"] is None) for r in decode.cells(broken).collect()] == [(None, False)]
    meta = {os.path.basename(r["path"]): r for r in decode.metadata(tree).collect()}
    assert meta["d.docx"]["tables"] == 1 and meta["t.csv"]["words"] == 2


def test_tools(spark, folder):
    def call(name, **args):
        text, error = registry.dispatch(name, args)
        assert not error, text
        return json.loads(text)

    assert len(registry.TOOLS) == 27
    f = str(folder / "src/app.js")
    found = call("search_code", query="ALPHA", dir=str(folder), ext="js", context=1)
    assert found["total_matches"] == 2 and found["matches"][0]["after_context"] == ["use(alpha);"]
    assert found["files_scanned"] == 1 and call("search_code", query="alpha", dir=str(folder), exclude="*.js,*.md")["total_matches"] == 0
    assert call("search_docs", query="alpha", dir=str(folder))["files_matched"] == 1 and call("search_docs", query="alpha", dir=str(folder), exclude="*.md")["files_matched"] == 0
    assert call("search_code", query="alpha", dir=str(folder), max=1)["total_matches"] == 1
    (folder / "nothing").mkdir()
    for tool in ("search_code", "search_docs"):
        assert call(tool, query="alpha", dir=str(folder / "nothing"))["files_scanned"] == 0
    assert [x["name"] for x in call("search_files", pattern="*.js", dir=str(folder))] == ["app.js"]
    assert call("read_lines", filePath=f, start=2)["lines"][0]["content"] == "use(alpha);"
    call("insert_lines", filePath=f, line=1, content="// top", before=True)
    call("replace_lines", filePath=f, start=2, content="let b = 2;")
    call("delete_lines", filePath=f, start=3)
    assert open(f).read() == "// top\nlet b = 2;\n"
    assert call("concat_files", patterns=[f, f"{folder}/*.csv"], header="%b")["content"].startswith("app.js\n// top")
    call("clean_file", filePath=f, removeChars="/")
    assert call("text_tokens", text="a b c d e f g h i")["words"] == 9
    assert call("text_chunk", text="a b\n" * 40, maxTokens=10)["total_chunks"] > 1
    x = str(folder / "t.xlsx")
    call("convert", input=str(folder / "t.csv"), output=x)
    call("sheets_set_cell", filePath=x, cell="A2", value="5")
    assert call("sheets_get_cell", filePath=x, cell="A2")["value"] == "5" and call("sheets_add_row", filePath=x, values=["x", " y"])["row"] == 3 and call("sheets_info", filePath=x)["sheet_count"] == 1
    d = str(folder / "d.docx")
    assert "Head" in call("docs_read", filePath=d)["content"] and call("extract_tables", filePath=d)["table_count"] == 1 and call("extract_metadata", filePath=d)["tables"] == 1
    call("docs_snapshot", filePath=d, outputPng=str(folder / "s.png"))
    call("convert", input=d, output=str(folder / "d.pdf"))
    assert call("pdf_read", filePath=str(folder / "d.pdf"), byPage=True)["pages"][0].startswith("Head")
    assert call("pdf_snapshot", filePath=str(folder / "d.pdf"), outputTarget=str(folder / "p"), all=True)["outputs"][0].endswith("p/page_1.png")
    call("convert", input=str(folder / "s.png"), output=str(folder / "s.pdf"))
    assert call("image_extract", documentPath=str(folder / "s.pdf"), outputDir=str(folder / "out"))["count"] == 1
    (folder / "l.md").write_text("https://a.example m@b.org 2024-01-02.")
    assert call("extract_links", filePath=str(folder / "l.md")) == {"urls": ["https://a.example"], "emails": ["m@b.org"], "dates": ["2024-01-02"]}
    assert call("icon_search", query="wagon")["total"] == 1 and 'width="32"' in call("icon_get", icon="camp", size=32)["content"]
    (folder / "p.html").write_text('<svg id="logo"><g/></svg><svg class="a b"></svg>')
    assert [s["file_name"] for s in call("icon_scrape", source=str(folder / "p.html"), outputDir=str(folder / "svg"))["svgs"]] == ["logo.svg", "a.svg"]
    assert call("icon_get", icon="camp", format="jsx", outputPath=str(folder / "new/camp.jsx"))["saved_path"] and "CampIcon" in (folder / "new/camp.jsx").read_text()
    assert svg.load("https://x.example", lambda u: "<svg></svg>") == "<svg></svg>" and registry.dispatch("icon_scrape", {"source": "https://x.example"})[1]
    for name, args in (("nothing", {}), ("read_lines", {}), ("read_lines", {"filePath": 3}), ("read_lines", {"filePath": "/no/such"}), ("text_tokens", "{bad")):
        assert registry.dispatch(name, args)[1]


def test_rpc_and_batch(spark):
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "text_tokens", "arguments": {"text": "a"}}}, {"jsonrpc": "2.0", "id": 4, "method": "nope"}, {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": []}]
    out = io.StringIO()
    server.serve(io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5] and len(got[1]["result"]["tools"]) == 27 and not got[2]["result"]["isError"] and got[3]["error"]["code"] == -32601
    steps = [{"tool": "text_tokens", "arguments": {"text": "a"}}, {"tool": "none"}, {"tool": "text_tokens", "arguments": {"text": "b"}}]
    for data in (json.dumps(steps).encode("utf-8-sig"), json.dumps(steps).encode("utf-16")):
        assert server.manifest(data) == steps
    assert server.run_batch(steps)["data"]["succeeded"] == 2 and len(server.run_batch(steps, True)["data"]["steps"]) == 2
    assert {len(registry.export(k)) for k in ("plain", "function", "input_schema")} == {27} and registry.export("plain", "TEXT_TOKENS")[0]["name"] == "text_tokens"
    for uri in ("docframe://manual", "docframe://none"):
        assert server.answer({"id": 1, "method": "resources/read", "params": {"uri": uri}})["result"]["contents"][0]["text"]


def test_cli(spark, folder, capsys):
    assert cli.main(["--json", "text", "tokens", "--text", "one two"]) == 0
    assert json.loads(capsys.readouterr().out)["data"]["words"] == 2
    for argv in (["docs", "info", str(folder / "d.docx")], ["schema", "export", "--format", "function"], ["icon", "collections"], ["sheets", "csv2xlsx", str(folder / "t.csv"), "-o", str(folder / "u.xlsx")], ["sheets", "xlsx2csv", str(folder / "u.xlsx")], ["docs", "edit", "append", str(folder / "d.docx"), "More"]):
        assert cli.main(argv) == 0
    assert cli.main(["--json", "no", "such"]) == 1 and cli.main(["docs", "info", "/none"]) == 1


def test_icons(spark):
    cat = icons.catalogue(spark)
    assert icons.search(cat, "", limit=0).count() == 10 and icons.search(cat, "", "MARKS", 99).count() == 16
    assert icons.get(cat, "tide")[1] == "shore" and icons.get(cat, "x:y") is None
    assert icons.get(cat, "camp", fetch=lambda c, n: "<svg/>")[2] == "<svg/>"
    df = spark.createDataFrame([('<svg width="1" stroke-width="2" fill="currentColor"><path width="3"/></svg>',), ("<svg/>",)], "s string")
    got = [r["s"] for r in df.select(svg.adjust(df["s"], size=9, color="red").alias("s")).collect()]
    assert got == ['<svg height="9" width="9" stroke-width="2" fill="red"><path width="9"/></svg>', '<svg height="9" width="9"/>']


def test_pdf_any_letters(spark, tmp_path):
    """Letters beyond Windows-1252 come back as they were; every non-null document is counted."""
    many = " ".join(map(chr, range(0x4E00, 0x4E00 + 600)))  # more than one further font
    texts = ["Größe\tund\r\nMaße", "Таблица (ошибки) \\ №5", "文書を保存 \U0001f600 ok", many, "plain", ""]
    for t in texts:
        assert pdf.text(pdf.from_pages([t])).split() == t.split()
    rows = [*enumerate(texts), (99, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["words"] for r in format_queries.pdf_words(spark, str(tmp_path)).collect()}
    assert got == {i: len(t.split()) for i, t in enumerate(texts)}


def test_pdf_long_cells():
    """A cell longer than its column, and one longer than a page, keep all their words."""
    long, word = " ".join(f"cell{i}" for i in range(400)), "x" * 200
    got = pdf.text(pdf.from_markdown(f"| a | b | c |\n|---|---|---|\n| {long} | {word} | end |\n| 1 | 2 | 3 |")).split()
    assert sorted(got) == sorted(["a", "b", "c", *long.split(), word, "end", "1", "2", "3"])


def _encrypted(plain: bytes, aes: bool) -> bytes:
    """A PDF of the writer, its streams encrypted under the empty user password."""
    ident, owner, perm = b"0123456789abcdef", bytes(range(32)), -44
    h = pdf_crypt.hashlib.md5(pdf_crypt._PAD + owner + struct.pack("<I", perm & 0xFFFFFFFF) + ident).digest()
    for _ in range(50):
        h = pdf_crypt.hashlib.md5(h).digest()
    check = pdf_crypt.rc4(h, pdf_crypt.hashlib.md5(pdf_crypt._PAD + ident).digest())
    for i in range(1, 20):
        check = pdf_crypt.rc4(bytes(b ^ i for b in h), check)
    out = []
    for n, body in pdf._objects(plain).items():
        if b"stream" in body:
            data = pdf._payload(body, {})
            own = pdf_crypt.hashlib.md5(h + struct.pack("<I", n)[:3] + b"\0\0" + (b"sAlT" if aes else b"")).digest()
            if aes:
                keys, prev, enc = pdf_crypt._round_keys(own), b"v" * 16, b"v" * 16
                data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
                for i in range(0, len(data), 16):
                    prev = pdf_crypt.aes_encrypt_block(keys, pdf_crypt._xor(data[i : i + 16], prev))
                    enc += prev
                data = enc
            else:
                data = pdf_crypt.rc4(own, data)
            body = pdf.re.sub(rb"/Length \d+", b"/Length %d" % len(data), pdf._head(body)) + b"stream\n" + data + b"\nendstream"
        out.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
    how = b"/V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF" if aes else b"/V 2 /R 3 /Length 128"
    out.append(b"999 0 obj\n<< /Filter /Standard %s /O <%s> /U <%s> /P %d >>\nendobj\n" % (how, owner.hex().encode(), (check + b"\0" * 16).hex().encode(), perm))
    return b"%PDF-1.6\n" + b"".join(out) + b"trailer << /Root 1 0 R /Encrypt 999 0 R /ID [<%s> <%s>] >>" % (ident.hex().encode(), ident.hex().encode())


def test_encrypted_pdf():
    block = pdf_crypt.aes_encrypt_block(pdf_crypt._round_keys(bytes(range(16))), bytes.fromhex("00112233445566778899aabbccddeeff"))
    assert block.hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" and pdf_crypt.aes_decrypt_block(pdf_crypt._round_keys(bytes(range(16))), block).hex() == "00112233445566778899aabbccddeeff"
    assert pdf_crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    plain = pdf.from_pages(["Secret page Größe", "Второй лист"])
    for aes in (False, True):
        locked = _encrypted(plain, aes)
        assert b"Secret" not in locked and pdf.pages(locked) == pdf.pages(plain)
        with pytest.raises(ValueError):
            pdf.pages(locked.replace(b"/P -44", b"/P -45"))


def test_pdf_fonts_without_a_map():
    """A simple font with its own encoding, and a composite one whose letters only its embedded program tells."""
    assert [pdf.glyph_text(n) for n in ("a", "eacute", "Ccaron", "uni0416", "fi", "zero", "germandbls", "nothing", "g12")] == ["a", "é", "Č", "Ж", "fi", "0", "ß", "", ""]
    sub = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HH", 0x416, 0xFFFF) + b"\0\0" + struct.pack(">HH", 0x416, 0xFFFF) + struct.pack(">HH", (5 - 0x416) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub
    program = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap
    assert pdf.truetype_map(program)[5] == "Ж"

    def stream(n, body, head=b""):
        return b"%d 0 obj\n<< /Length %d %s >>\nstream\n%s\nendstream\nendobj\n" % (n, len(body), head, body)

    doc = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
    doc += b"3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>\nendobj\n"
    doc += stream(4, b"BT /F1 12 Tf 10 700 Td (\x01b\x02) Tj /F2 12 Tf 0 -20 Td <00050005> Tj ET")
    doc += b"5 0 obj\n<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /eacute /Zcaron] >> >>\nendobj\n"
    doc += b"6 0 obj\n<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [7 0 R] >>\nendobj\n7 0 obj\n<< /Type /Font /Subtype /CIDFontType2 /FontDescriptor 8 0 R /CIDToGIDMap /Identity >>\nendobj\n"
    doc += b"8 0 obj\n<< /Type /FontDescriptor /FontFile2 9 0 R >>\nendobj\n" + stream(9, program)
    assert pdf.pages(doc) == ["ébŽ\nЖЖ"]
