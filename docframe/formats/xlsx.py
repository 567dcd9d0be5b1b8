"""Spreadsheet workbooks with the standard library: read, write, edit, and to and from CSV.

Cells are text: shared and inline strings as they are, booleans TRUE/FALSE, numbers and formula results as stored.
Rows are ragged: trailing empty cells and rows are dropped. Edits change only the cells they name: all other parts of the
package, and all other text of the sheet, stay byte for byte.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

from docframe.formats import package

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_ADDRESS = re.compile(r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]*)$")
_NUMBER = re.compile(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")

Sheet = tuple[str, list[list[str]]]


def column_name(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def address(text: str) -> tuple[int, int]:
    """(row, column), both from 1, of an address such as ``B7``."""
    m = _ADDRESS.match(text.strip())
    if not m:
        raise ValueError(f"no cell address: {text!r}")
    col = 0
    for ch in m[1].upper():
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def _value(cell: ET.Element, shared: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_M}is")
        return _texts(inline) if inline is not None else ""
    v = cell.find(f"{_M}v")
    raw = (v.text or "") if v is not None else ""
    if kind == "s":
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(raw, raw)
    return raw


def _sheet_paths(parts: dict[str, bytes]) -> list[tuple[str, str]]:
    """(name, part) of every sheet in workbook order."""
    rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(parts["xl/_rels/workbook.xml.rels"])}
    out = []
    for s in ET.fromstring(parts["xl/workbook.xml"]).iter(f"{_M}sheet"):
        target = rels.get(s.get(f"{_R}id"), "")
        out.append((s.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def read(data: bytes) -> list[Sheet]:
    """Sheets in workbook order; one whose part is missing or broken has no rows."""
    parts = package.read(data)
    shared = []
    if body := parts.get("xl/sharedStrings.xml"):
        shared = [_texts(si) for si in ET.fromstring(body).findall(f"{_M}si")]
    out = []
    for name, path in _sheet_paths(parts):
        rows: dict[int, dict[int, str]] = {}
        try:
            at = 0
            for row in ET.fromstring(parts[path]).iter(f"{_M}row"):
                at = int(row.get("r", at + 1))
                col = 0
                for c in row.findall(f"{_M}c"):
                    col = address(c.get("r"))[1] if c.get("r") else col + 1
                    rows.setdefault(at, {})[col] = _value(c, shared)
        except (KeyError, ET.ParseError):
            rows = {}
        table = []
        for r in range(1, max(rows, default=0) + 1):
            cells = rows.get(r, {})
            line = [cells.get(c, "") for c in range(1, max(cells, default=0) + 1)]
            while line and line[-1] == "":
                line.pop()
            table.append(line)
        while table and not table[-1]:
            table.pop()
        out.append((name, table))
    return out


def _cell(r: int, c: int, value: object, style: str = "", prefix: str = "") -> str:
    ref, p = f"{column_name(c)}{r}", prefix
    head = f'<{p}c r="{ref}"' + (f' s="{style}"' if style else "")
    if isinstance(value, bool):
        return f'{head} t="b"><{p}v>{int(value)}</{p}v></{p}c>'
    if isinstance(value, int | float):
        return f"{head}><{p}v>{value!r}</{p}v></{p}c>"
    safe = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))).replace("\r", "&#13;")  # a parser would drop the bare character
    return f'{head} t="inlineStr"><{p}is><{p}t xml:space="preserve">{safe}</{p}t></{p}is></{p}c>'


def write(sheets: list[tuple[str, list[list[object]]]]) -> bytes:
    names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
    base = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts: dict[str, bytes | str] = {
        "[Content_Types].xml": package.content_types({"/xl/workbook.xml": f"{base}.sheet.main+xml"} | {f"/xl/worksheets/sheet{i}.xml": f"{base}.worksheet+xml" for i in range(1, len(sheets) + 1)}),
        "_rels/.rels": package.relationships([("rId1", "officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_M[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": package.relationships([(f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)]),
    }
    for i, (_, rows) in enumerate(sheets, 1):
        body = "".join(f'<row r="{r}">{"".join(_cell(r, c, v) for c, v in enumerate(row, 1) if v is not None and v != "")}</row>' for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_M[1:-1]}"><sheetData>{body}</sheetData></worksheet>'
    return package.write(parts)


def _pick(sheets: list[Sheet], name: str | None) -> int:
    for i, (n, _) in enumerate(sheets):
        if not name or n == name:
            return i
    raise KeyError(f"no sheet {name!r}")


def typed(text: str) -> object:
    """A number, else a boolean, else the text."""
    if _NUMBER.match(text):
        f = float(text)
        return int(text) if re.fullmatch(r"[+-]?\d{1,15}", text) else f
    return {"true": True, "false": False, "TRUE": True, "FALSE": False, "True": True, "False": False, "t": True, "T": True, "f": False, "F": False}.get(text, text)


_SHEET_DATA = re.compile(r"<((?:[\w.-]+:)?)sheetData\b[^>]*?(?:/>|>(.*?)</\1sheetData\s*>)", re.S)
_ROW = re.compile(r"<((?:[\w.-]+:)?)row\b([^>]*?)(?:/>|>(.*?)</\1row\s*>)", re.S)
_C = re.compile(r"<((?:[\w.-]+:)?)c\b([^>]*?)(?:/>|>(.*?)</\1c\s*>)", re.S)
_ATTR_R, _ATTR_S = re.compile(r"""\br\s*=\s*["']([^"']+)["']"""), re.compile(r"""\bs\s*=\s*["']([^"']+)["']""")
_DIMENSION = re.compile(r"""(<(?:[\w.-]+:)?dimension\b[^>]*\bref=["'])([^"']+)(["'])""")


def _put_in_row(body: str, r: int, values: dict[int, object], prefix: str) -> tuple[str, bool]:
    """The cells of a row with some set, and whether a formula was replaced. Cells stay in order of their columns."""
    out, at, col, formula = [], 0, 0, False
    todo = sorted(values.items())
    for m in _C.finditer(body):
        ref = _ATTR_R.search(m[2])
        col = address(ref[1])[1] if ref else col + 1
        out.append(body[at : m.start()])
        at = m.start()
        while todo and todo[0][0] < col:
            c, v = todo.pop(0)
            out.append(_cell(r, c, v, "", prefix))
        if todo and todo[0][0] == col:
            c, v = todo.pop(0)
            style = _ATTR_S.search(m[2])
            formula |= bool(re.search(r"<(?:[\w.-]+:)?f\b", m[3] or ""))
            out.append(_cell(r, c, v, style[1] if style else "", prefix))
            at = m.end()
    out.append(body[at:])
    return "".join(out) + "".join(_cell(r, c, v, "", prefix) for c, v in todo), formula


def _put(xml: str, r: int, values: dict[int, object]) -> tuple[str, bool]:
    """The text of a sheet with cells of one row set, and whether a formula was replaced."""
    data = _SHEET_DATA.search(xml)
    if not data:
        raise ValueError("a sheet without cell data")
    p, body = data[1], data[2] or ""
    out, at, last, done, formula = [], 0, 0, False, False
    for m in _ROW.finditer(body):
        n = _ATTR_R.search(m[2])
        last = int(n[1]) if n else last + 1
        if last < r:
            continue
        if last == r:
            cells, formula = _put_in_row(m[3] or "", r, values, p)
            attrs = re.sub(r"""\s*\bspans=["'][^"']*["']""", "", m[2])
            out = [body[: m.start()], f"<{p}row{attrs}>{cells}</{p}row>"]
            at = m.end()
        else:
            out = [body[: m.start()], f'<{p}row r="{r}">{_put_in_row("", r, values, p)[0]}</{p}row>']
            at = m.start()
        done = True
        break
    if not done:
        out = [body, f'<{p}row r="{r}">{_put_in_row("", r, values, p)[0]}</{p}row>']
        at = len(body)
    xml = f"{xml[: data.start()]}<{p}sheetData>{''.join(out)}{body[at:]}</{p}sheetData>{xml[data.end() :]}"

    def wider(m: re.Match) -> str:
        ends = [address(x) for x in m[2].split(":")]
        ends += [(r, c) for c in values]
        lo, hi = (min(a for a, _ in ends), min(b for _, b in ends)), (max(a for a, _ in ends), max(b for _, b in ends))
        return f"{m[1]}{column_name(lo[1])}{lo[0]}:{column_name(hi[1])}{hi[0]}{m[3]}"

    return _DIMENSION.sub(wider, xml, count=1), formula


def _edit(data: bytes, sheet: str | None, r: int, values: dict[int, object]) -> bytes:
    parts = package.read(data)
    names = _sheet_paths(parts)
    path = names[_pick([(n, []) for n, _ in names], sheet)][1]
    xml, formula = _put(parts[path].decode("utf-8"), r, values)
    parts[path] = xml.encode()
    if formula and "xl/calcChain.xml" in parts:  # a list of formula cells that readers build anew; a stale one counts as damage
        del parts["xl/calcChain.xml"]
        for name, tag in (("[Content_Types].xml", "Override"), ("xl/_rels/workbook.xml.rels", "Relationship")):
            parts[name] = re.sub(rf"<{tag}\b[^>]*calcChain\.xml[^>]*/>".encode(), b"", parts[name])
    return package.write(parts)


def set_cell(data: bytes, cell: str, value: str, sheet: str | None = None) -> bytes:
    """The workbook with one cell set; its style stays, a formula in it goes."""
    r, c = address(cell)
    return _edit(data, sheet, r, {c: typed(value)})


def get_cell(data: bytes, cell: str, sheet: str | None = None) -> str:
    sheets = read(data)
    rows = sheets[_pick(sheets, sheet)][1]
    r, c = address(cell)
    return rows[r - 1][c - 1] if r <= len(rows) and c <= len(rows[r - 1]) else ""


def add_row(data: bytes, values: list[str], sheet: str | None = None) -> tuple[bytes, int]:
    """The workbook with a row of trimmed texts behind the last row that holds a value, and that row's number."""
    sheets = read(data)
    row = len(sheets[_pick(sheets, sheet)][1]) + 1
    cells = {c: v.strip() for c, v in enumerate(values, 1) if v.strip()}
    return _edit(data, sheet, row, cells) if cells else data, row


def info(data: bytes) -> list[dict]:
    return [{"name": n, "index": i, "row_count": len(rows), "col_count": len(rows[0]) if rows else 0, "headers": rows[0] if rows else []} for i, (n, rows) in enumerate(read(data))]


def to_text(data: bytes) -> str:
    """All sheets, cells parted by tabs."""
    return "\n".join("\t".join(r) for _, rows in read(data) for r in rows).rstrip("\n")


def to_csv(data: bytes, sheet: str | None = None, delimiter: str = ",") -> str:
    sheets = read(data)
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows(sheets[_pick(sheets, sheet)][1])
    return out.getvalue()


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Records of a CSV text; blank lines are no records, ragged records an error."""
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r]
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("wrong number of fields")
    return rows


def from_csv(text: str, sheet: str = "Sheet1", delimiter: str = ",") -> bytes:
    return write([(sheet or "Sheet1", parse_csv(text, delimiter))])
