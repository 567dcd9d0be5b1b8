"""Word documents with the standard library: text, Markdown, tables, building from Markdown, and edits."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, unescape

from docframe.formats import package

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DOC = "word/document.xml"


def _body(data: bytes) -> ET.Element:
    root = ET.fromstring(package.read(data)[_DOC])
    body = root.find(f"{_W}body")
    return root if body is None else body


def _text(node: ET.Element) -> str:
    """Text of the runs below a node; tabs and breaks as characters."""
    out = []
    for n in node.iter():
        if n.tag == f"{_W}t":
            out.append(n.text or "")
        elif n.tag == f"{_W}tab" and n is not node:
            out.append("\t")
        elif n.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _style(p: ET.Element) -> str:
    s = p.find(f"{_W}pPr/{_W}pStyle")
    return s.get(f"{_W}val", "") if s is not None else ""


def _blocks(node: ET.Element):
    """Paragraphs and tables in order, also inside content controls and sections."""
    for child in node:
        if child.tag in (f"{_W}p", f"{_W}tbl"):
            yield child
        else:
            yield from _blocks(child)


def _rows(tbl: ET.Element) -> list[list[str]]:
    out = []
    for tr in tbl.findall(f"{_W}tr"):
        cells = [" ".join(filter(None, (_text(p).strip() for p in tc.iter(f"{_W}p")))) for tc in tr.findall(f"{_W}tc")]
        if cells:
            out.append(cells)
    return out


def to_text(data: bytes) -> str:
    """One non-empty trimmed paragraph per line; text in tables is left out."""
    return "\n".join(t for b in _blocks(_body(data)) if b.tag == f"{_W}p" and (t := _text(b).strip()))


def to_markdown(data: bytes) -> str:
    out = []
    for b in _blocks(_body(data)):
        if b.tag == f"{_W}tbl":
            out += ["| " + " | ".join(r) + " |" for r in _rows(b)] + [""]
            continue
        text = _text(b).strip()
        if not text:
            continue
        style = _style(b)
        if m := re.fullmatch(r"Heading([1-3])", style):
            out.append("#" * int(m[1]) + " " + text)
        elif style == "Code":
            out.append(f"```\n{text}\n```")
        elif style.startswith("ListBullet"):
            out.append("- " + text)
        else:
            out.append(text)
    return "\n".join(out).strip()


def tables(data: bytes) -> list[list[list[str]]]:
    return [_rows(b) for b in _blocks(_body(data)) if b.tag == f"{_W}tbl"]


def info(data: bytes) -> dict:
    text = to_text(data)
    return {"paragraph_count": text.count("\n") + 1, "table_count": len(tables(data)), "word_count": len(text.split()), "character_count": len(text.encode())}


def _run(text: str, bold: bool = False, mono: bool = False) -> str:
    props = ("<w:b/>" if bold else "") + ('<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>' if mono else "")
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def _runs(text: str) -> str:
    """Runs of a line; text between double asterisks is bold."""
    parts = re.split(r"\*\*(.+?)\*\*", text)
    return "".join(_run(p, bold=i % 2 == 1) for i, p in enumerate(parts) if p)


def _paragraph(runs: str, style: str = "") -> str:
    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}{runs}</w:p>'


def table_rows(lines: list[str]) -> list[list[str]]:
    """Cells of pipe rows; a row with ``---`` only parts header and body."""
    return [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines if "---" not in x]


def _table(rows: list[list[str]]) -> str:
    shade = '<w:shd w:val="clear" w:color="auto" w:fill="E8EDF3"/>'
    body = "".join("<w:tr>" + "".join(f'<w:tc><w:tcPr>{shade if i == 0 else ""}</w:tcPr>{_paragraph(_run(c, bold=i == 0) if c else "")}</w:tc>' for c in row) + "</w:tr>" for i, row in enumerate(rows))
    edges = "".join(f'<w:{e} w:val="single" w:sz="4" w:color="808080"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return f"<w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr>{body}</w:tbl>"


def markdown_blocks(text: str) -> list[tuple[str, object]]:
    """("h1".."h3" | "bullet" | "code" | "text", line) and ("table", rows) of a Markdown text; blank lines part blocks."""
    out: list[tuple[str, object]] = []
    rows: list[str] = []
    fenced = False
    for line in [*text.replace("\r\n", "\n").split("\n"), ""]:
        s = line.strip()
        if not fenced and s.startswith("|"):
            rows.append(s)
            continue
        if rows:
            out.append(("table", table_rows(rows)))
            rows = []
        if s.startswith("```"):
            fenced = not fenced
        elif fenced:
            out.append(("code", line))
        elif m := re.match(r"(#{1,3}) +(.*)", s):
            out.append((f"h{len(m[1])}", m[2]))
        elif m := re.match(r"[-*+] +(.*)", s):
            out.append(("bullet", m[1]))
        elif s:
            out.append(("text", s))
    return out


def _styles() -> str:
    heads = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:rPr><w:b/><w:sz w:val="{40 - 6 * n}"/></w:rPr></w:style>' for n in (1, 2, 3))
    more = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{i}"/></w:style>' for i in ("Code", "ListBullet"))
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:styles xmlns:w="{_W[1:-1]}">{heads}{more}</w:styles>'


def from_markdown(text: str) -> bytes:
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    body = []
    for kind, value in markdown_blocks(text):
        if kind == "table":
            body.append(_table(value))
        elif kind == "code":
            body.append(_paragraph(_run(value, mono=True), "Code"))
        elif kind == "bullet":
            body.append(_paragraph(_runs(value), "ListBullet"))
        else:
            body.append(_paragraph(_runs(value), f"Heading{kind[1]}" if kind[0] == "h" else ""))
    base = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    return package.write({
        "[Content_Types].xml": package.content_types({f"/{_DOC}": f"{base}.document.main+xml", "/word/styles.xml": f"{base}.styles+xml"}),
        "_rels/.rels": package.relationships([("rId1", "officeDocument", _DOC)]),
        "word/_rels/document.xml.rels": package.relationships([("rId1", "styles", "styles.xml")]),
        "word/styles.xml": _styles(),
        _DOC: f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>',
    })


_PARAGRAPH = re.compile(r"<w:p[\s>](?:(?!<w:p[\s>]).)*?</w:p>", re.S)
_TEXT = re.compile(r"<w:t((?: [^>]*)?)>([^<]*)</w:t>")


def replace_text(data: bytes, old: str, new: str) -> tuple[bytes, int]:
    """Occurrences within a paragraph replaced, and how many. One split across runs is found too; what replaces it stands in its first run."""
    parts = package.read(data)
    count = 0

    def paragraph(m: re.Match) -> str:
        nonlocal count
        nodes = [unescape(t[2], {"&quot;": '"', "&apos;": "'"}) for t in _TEXT.finditer(m[0])]
        whole = "".join(nodes)
        hits, at = [], whole.find(old)
        while at >= 0:
            hits.append(at)
            at = whole.find(old, at + len(old))
        if not hits:
            return m[0]
        count += len(hits)
        made, start = [], 0
        for text in nodes:
            end, out, at = start + len(text), "", start
            for h in hits:
                if h + len(old) <= start or h >= end:
                    continue
                out += whole[at : max(h, at)]
                if h >= start:
                    out += new
                at = min(max(h + len(old), at), end)
            made.append(out + whole[at:end])
            start = end
        texts = iter(made)

        def node(t: re.Match) -> str:
            text = next(texts)
            attrs = t[1] if "xml:space" in t[1] or text == text.strip() else t[1] + ' xml:space="preserve"'
            return f"<w:t{attrs}>{escape(text)}</w:t>"

        return _TEXT.sub(node, m[0])

    if not old:
        return package.write(parts), 0
    xml = _PARAGRAPH.sub(paragraph, parts[_DOC].decode())
    return package.write(parts | {_DOC: xml}), count


def append(data: bytes, text: str, heading: int = 0) -> bytes:
    """A paragraph, or a heading of level 1 to 3, before the end of the body."""
    parts = package.read(data)
    xml = parts[_DOC].decode()
    new = _paragraph(_run(text), f"Heading{min(heading, 3)}" if heading > 0 else "")
    at = max(xml.rfind("<w:sectPr"), -1)
    end = xml.rfind("</w:body>")
    if end < 0:
        raise ValueError("the document has no body")
    at = at if 0 <= at < end and xml.find("<w:p", at) < 0 else end
    return package.write(parts | {_DOC: xml[:at] + new + xml[at:]})
