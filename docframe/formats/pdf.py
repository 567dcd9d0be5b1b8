"""PDF with the standard library: a writer for text, tables and images, and a reader for text and images.

The reader handles classic and stream cross-references by scanning for objects, Flate streams with predictors,
object streams, the text operators and ToUnicode maps. It does not decrypt, and a font without a Unicode map is read as
Windows-1252. Pages that cannot be read are empty, their number is kept.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib

import numpy as np

from docframe.formats import images, pdf_crypt
from docframe.formats.docx import markdown_blocks

A4 = (595.28, 841.89)
_MARGIN = 50.0


# --- writer -----------------------------------------------------------------------------------------------------


class Writer:
    """Collects pages of drawing operators and image objects."""

    def __init__(self) -> None:
        self.pages: list[tuple[list[str], dict[str, int]]] = []
        self.images: list[bytes] = []
        self.extra: dict[str, int] = {}  # letters beyond Windows-1252, numbered
        self.y = 0.0

    def page(self) -> None:
        self.pages.append(([], {}))
        self.y = A4[1] - _MARGIN

    def text(self, text: str, size: float = 10, font: str = "F1", x: float = _MARGIN, advance: bool = True) -> None:
        if not self.pages or (advance and self.y - size * 1.4 < _MARGIN):
            self.page()
        if advance:
            self.y -= size * 1.4
        shown = " ".join(f"/{name} {size:g} Tf {self._string(run)} Tj" for name, run in self._runs(text, font))
        self.pages[-1][0].append(f"BT {x:.2f} {self.y:.2f} Td {shown} ET")

    def _runs(self, text: str, font: str) -> list[tuple[str, bytes]]:
        """(font, codes) of the text: letters beyond Windows-1252 are in further fonts of 255 letters each."""
        out: list[tuple[str, bytes]] = []
        try:
            return [(font, text.encode("cp1252"))]
        except UnicodeEncodeError:
            pass
        for c in text:
            try:
                name, code = font, c.encode("cp1252")
            except UnicodeEncodeError:
                n = self.extra.setdefault(c, len(self.extra))
                name, code = f"U{n // 255}", bytes([n % 255 + 1])
            if out and out[-1][0] == name:
                out[-1] = (name, out[-1][1] + code)
            else:
                out.append((name, code))
        return out

    @staticmethod
    def _string(raw: bytes) -> str:
        for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\n", b"\\n"), (b"\r", b"\\r")):
            raw = raw.replace(a, b)
        return f"({raw.decode('latin-1')})"

    def _extra_fonts(self, at: int) -> list[bytes]:
        """Objects of the further fonts from number ``at`` on, each followed by its Unicode map."""
        out, letters = [], list(self.extra)
        for i in range(0, len(letters), 255):
            part = letters[i : i + 255]
            glyphs = " ".join(f"/u{ord(c):04X}" if ord(c) > 0xFFFF else f"/uni{ord(c):04X}" for c in part)
            blocks = [list(enumerate(part, 1))[k : k + 100] for k in range(0, len(part), 100)]  # a block holds at most 100 codes
            pairs = "".join(f"{len(b)} beginbfchar\n" + "".join(f"<{n:02X}> <{c.encode('utf-16-be').hex().upper()}>\n" for n, c in b) + "endbfchar\n" for b in blocks)
            cmap = f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U{i // 255} def /CMapType 2 def\n1 begincodespacerange <00> <FF> endcodespacerange\n{pairs}endcmap end end"
            stream = zlib.compress(cmap.encode())
            out.append(f"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Type /Encoding /Differences [1 {glyphs}] >> /ToUnicode {at + len(out) + 1} 0 R >>".encode())
            out.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
        return out

    def image(self, body: bytes, box: tuple[float, float, float, float]) -> None:
        self.images.append(body)
        ops, used = self.pages[-1]
        used[f"I{len(self.images)}"] = len(self.images) - 1
        x, y, w, h = box
        ops.append(f"q {w:.3f} 0 0 {h:.3f} {x:.3f} {y:.3f} cm /I{len(self.images)} Do Q")

    def to_bytes(self) -> bytes:
        if not self.pages:
            self.page()
        fonts = {"F1": "Helvetica", "F2": "Helvetica-Bold", "F3": "Courier"}
        objs: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
        for name in fonts.values():
            objs.append(f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>".encode())
        first_image = len(objs) + 1
        objs += self.images
        first_extra = len(objs) + 1
        objs += self._extra_fonts(first_extra)
        numbers = {n: 3 + k for k, n in enumerate(fonts)} | {f"U{k}": first_extra + 2 * k for k in range((len(self.extra) + 254) // 255)}
        res = " ".join(f"/{n} {k} 0 R" for n, k in numbers.items())
        kids = []
        for ops, used in self.pages:
            stream = zlib.compress("\n".join(ops).encode("latin-1"))
            objs.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
            pics = " ".join(f"/{n} {first_image + i} 0 R" for n, i in used.items())
            objs.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {A4[0]} {A4[1]}] /Contents {len(objs)} 0 R /Resources << /Font << {res} >> /XObject << {pics} >> >> >>".encode())
            kids.append(len(objs))
        objs[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
        out, at = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
        for i, body in enumerate(objs, 1):
            at.append(len(out))
            out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
        xref = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objs) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
        out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objs) + 1, xref)
        return bytes(out)


def from_markdown(text: str) -> bytes:
    """A4 pages of headings, paragraphs, bullets, code and tables with as wide columns as the first row has; cells wrap, a longer word overflows."""
    w = Writer()
    w.page()
    for kind, value in markdown_blocks(text):
        if kind == "table":
            width = (A4[0] - 2 * _MARGIN) / max(1, len(value[0]) if value else 1)
            limit = max(1, int(width / 5.2))
            for n, row in enumerate(value):
                cells = [[cell] if len(cell) <= limit else images.wrap(cell, limit) for cell in row]
                for k in range(max(map(len, cells), default=1)):
                    if w.y - 14 < _MARGIN:
                        w.page()
                    w.y -= 14
                    for c, parts in enumerate(cells):
                        if k < len(parts):
                            w.text(parts[k], 10, "F2" if n == 0 else "F1", _MARGIN + c * width, advance=False)
            continue
        plain = value.replace("**", "")
        if kind[0] == "h":
            for part in images.wrap(plain, 60):
                w.text(part, 22 - 3 * int(kind[1]), "F2")
        elif kind == "code":
            for i in range(0, max(1, len(value)), 88):
                w.text(value[i : i + 88], 9, "F3")
        else:
            for n, part in enumerate(images.wrap(plain, 92)):
                w.text(("• " if n == 0 else "  ") + part if kind == "bullet" else part)
    return w.to_bytes()


def from_pages(pages: list[str]) -> bytes:
    """One or more A4 pages for every text."""
    w = Writer()
    for text in pages:
        w.page()
        for line in text.split("\n"):
            for part in images.wrap(line, 92):
                w.text(part)
    return w.to_bytes()


def _image_object(data: bytes) -> tuple[bytes, int, int]:
    meta = images.info(data)
    if not meta:
        raise ValueError("unknown image format")
    w, h = meta["width"], meta["height"]
    if meta["format"] == "jpeg":
        body, filt = data, "DCTDecode"
    else:
        px = images.decode(data)
        rgb = (px[..., :3].astype(np.uint16) * px[..., 3:] // 255 + 255 - px[..., 3:]).astype(np.uint8)
        body, filt = zlib.compress(rgb.tobytes()), "FlateDecode"
    head = f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /{filt} /Length {len(body)} >>\nstream\n"
    return head.encode() + body + b"\nendstream", w, h


def from_images(pictures: list[bytes]) -> bytes:
    """One A4 page per image, fitted into margins of 10 mm and centred."""
    doc, edge = Writer(), 10 / 25.4 * 72
    for data in pictures:
        body, w, h = _image_object(data)
        doc.page()
        scale = min((A4[0] - 2 * edge) / max(w, 1), (A4[1] - 2 * edge) / max(h, 1))
        doc.image(body, ((A4[0] - w * scale) / 2, (A4[1] - h * scale) / 2, w * scale, h * scale))
    return doc.to_bytes()


# --- reader -----------------------------------------------------------------------------------------------------

_OBJ = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"<<|>>|\[|\]|/[^\s<>\[\]()/%]*|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%]+|\(|%[^\r\n]*")


def _decrypted(data: bytes, objs: dict[int, bytes], generations: dict[int, int]) -> None:
    """Streams of an encrypted file made readable, in place; other files are left as they are."""
    m = re.search(rb"/Encrypt\s+(\d+)\s+\d+\s+R", data)
    inline = None if m else re.search(rb"/Encrypt\s*(<<.*?>>\s*(?:/|>>))", data, re.S)
    if not (m or inline):
        return
    ident = re.search(rb"/ID\s*\[\s*(<[0-9A-Fa-f\s]*>|\()", data)
    first = b""
    if ident:
        first = bytes.fromhex(re.sub(rb"\s", b"", ident[1][1:-1]).decode()) if ident[1][:1] == b"<" else literal(data, ident.end())[0]
    key, aes = pdf_crypt.file_key(objs.get(int(m[1]), b"") if m else inline[1], first)
    for n, body in objs.items():
        head = _head(body)
        if len(head) == len(body) or re.search(rb"/Type\s*/XRef\b", head):
            continue
        plain = pdf_crypt.decrypt(key, aes, n, generations[n], _payload(body, objs))
        objs[n] = re.sub(rb"/Length\s+\d+(\s+\d+\s+R)?", b"/Length %d" % len(plain), head) + b"stream\n" + plain + b"\nendstream"


def _objects(data: bytes) -> dict[int, bytes]:
    """Body of every object by number; the last definition counts. Streams are decrypted, object streams unpacked."""
    out: dict[int, bytes] = {}
    generations: dict[int, int] = {}
    at = 0
    while m := _OBJ.search(data, at):
        end = data.find(b"endobj", m.end())
        s = data.find(b"stream", m.end(), end if end >= 0 else len(data))
        if s >= 0:
            e = data.find(b"endstream", s)
            end = data.find(b"endobj", e) if e >= 0 else end
        end = len(data) if end < 0 else end
        out[int(m[1])] = data[m.end() : end]
        generations[int(m[1])] = int(m[2])
        at = end
    _decrypted(data, out, generations)
    for body in list(out.values()):
        if b"/ObjStm" in body[:300]:
            try:
                text = _stream(body, out)
                n, first = _int(body, b"N", out), _int(body, b"First", out)
                nums = list(map(int, text[:first].split()))[: 2 * n]
                ends = [*nums[3::2], len(text) - first]
                for num, off, stop in zip(nums[::2], nums[1::2], ends):
                    out.setdefault(num, text[first + off : first + stop])
            except (ValueError, TypeError, zlib.error):
                continue
    return out


def _head(body: bytes) -> bytes:
    s = body.find(b"stream")
    return body if s < 0 else body[:s]


def _int(body: bytes, key: bytes, objs: dict[int, bytes], default: int = 0) -> int:
    m = re.search(rb"/" + key + rb"\s+(\d+)(\s+\d+\s+R)?", _head(body))
    if not m:
        return default
    return int(objs.get(int(m[1]), b"0").strip() or 0) if m[2] else int(m[1])


def _payload(body: bytes, objs: dict[int, bytes]) -> bytes:
    """The bytes of a stream as they are stored."""
    s = body.find(b"stream")
    if s < 0:
        return b""
    at = s + 6
    at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] in b"\r\n" else 0
    n = _int(body, b"Length", objs)
    e = body.rfind(b"endstream")
    return body[at : at + n] if 0 < n <= len(body) - at else body[at : e if e >= 0 else len(body)]


def _stream(body: bytes, objs: dict[int, bytes]) -> bytes:
    s = body.find(b"stream")
    if s < 0:
        return b""
    raw = _payload(body, objs)
    if b"/FlateDecode" in body[:s] or b"/Fl " in body[:s]:
        raw = zlib.decompressobj().decompress(raw)
        if (pred := _int(body, b"Predictor", objs, 1)) >= 10 and pred <= 15:
            cols, colors = _int(body, b"Columns", objs, 1), _int(body, b"Colors", objs, 1)
            stride = cols * colors
            raw = images.unfilter(raw, len(raw) // (stride + 1), stride, colors).tobytes()
    return raw


def _follow(m: re.Match | None, objs: dict[int, bytes]) -> bytes:
    return objs.get(int(m[1]), b"") if m else b""


def _page_numbers(objs: dict[int, bytes]) -> list[int]:
    """Page objects in document order."""
    root = next((b for b in objs.values() if re.search(rb"/Type\s*/Catalog\b", b[:4000])), b"")
    out, seen = [], set()

    def walk(num: int) -> None:
        body = _head(objs.get(num, b""))
        if num in seen:
            return
        seen.add(num)
        if re.search(rb"/Type\s*/Pages\b", body):
            m = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            for r in _REF.finditer(m[1] if m else b""):
                walk(int(r[1]))
        elif body:
            out.append(num)

    if m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root):
        walk(int(m[1]))
    return out or [n for n, b in sorted(objs.items()) if re.search(rb"/Type\s*/Page\b(?!s)", _head(b))]


def _reachable(objs: dict[int, bytes], start: int) -> set[int]:
    """Objects a page refers to, directly or not, without its parents."""
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [int(r[1]) for r in _REF.finditer(re.sub(rb"/Parent\s+\d+\s+\d+\s+R", b"", _head(objs.get(n, b""))))]
    return seen


def _unicode_map(body: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(re.sub(r"\s", "", h)).decode("utf-16-be", "replace")
    s = body.decode("latin-1")
    for part in re.findall(r"beginbfchar(.*?)endbfchar", s, re.S):
        for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", part):
            out[int(a, 16)] = text(b)
    for part in re.findall(r"beginbfrange(.*?)endbfrange", s, re.S):
        for a, b, c in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + k] = chr(int(c, 16) + k) if len(c) <= 4 else text(c)
    return out


# Names of glyphs that are no letter with a mark.
_GLYPH_NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "Euro": "€", "section": "§", "degree": "°", "copyright": "©",
}
_MARKS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "ogonek": "OGONEK", "macron": "MACRON", "breve": "BREVE"}


def glyph_text(name: str) -> str:
    """Text of a glyph name, "" if it tells nothing: single letters, ``uniXXXX``, a letter with a mark, or a known name."""
    name = name.split(".")[0]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else ""
    if name[1:] in _MARKS and name[0].isalpha():
        try:
            return unicodedata.lookup(f"LATIN {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name[0].upper()} WITH {_MARKS[name[1:]]}")
        except KeyError:
            return ""
    return _GLYPH_NAMES.get(name, "")


def _differences(body: bytes, objs: dict[int, bytes]) -> dict[int, str]:
    """Characters of a simple font's own encoding."""
    enc = _follow(re.search(rb"/Encoding\s+(\d+)\s+\d+\s+R", body), objs) or body
    m = re.search(rb"/Differences\s*\[(.*?)\]", enc, re.S)
    if not m:
        return {}
    base = "mac-roman" if b"/MacRomanEncoding" in enc else "cp1252"
    out = {i: bytes([i]).decode(base, "replace") for i in range(32, 256)}
    code = 0
    for n, name in re.findall(rb"(\d+)|/([^\s/\[\]<>()]+)", m[1]):
        if n:
            code = int(n)
        else:
            if found := glyph_text(name.decode("latin-1")):
                out[code] = found
            code += 1
    return out


def truetype_map(data: bytes) -> dict[int, str]:
    """Character of every glyph, from the character map of a TrueType program."""
    out: dict[int, str] = {}
    count = struct.unpack(">H", data[4:6])[0]
    at = next((struct.unpack(">I", data[12 + 16 * i + 8 : 12 + 16 * i + 12])[0] for i in range(count) if data[12 + 16 * i : 12 + 16 * i + 4] == b"cmap"), 0)
    if not at:
        return out
    for i in range(struct.unpack(">H", data[at + 2 : at + 4])[0]):
        platform, _, off = struct.unpack(">HHI", data[at + 4 + 8 * i : at + 12 + 8 * i])
        t = data[at + off :]
        kind = struct.unpack(">H", t[:2])[0]
        if platform not in (0, 3):
            continue
        if kind == 4:
            n = struct.unpack(">H", t[6:8])[0] // 2
            ends, starts = struct.unpack(f">{n}H", t[14 : 14 + 2 * n]), struct.unpack(f">{n}H", t[16 + 2 * n : 16 + 4 * n])
            deltas, ranges = struct.unpack(f">{n}H", t[16 + 4 * n : 16 + 6 * n]), struct.unpack(f">{n}H", t[16 + 6 * n : 16 + 8 * n])
            for k in range(n):
                for c in range(starts[k], min(ends[k], 0xFFFE) + 1):
                    g = c
                    if ranges[k]:
                        place = 16 + 6 * n + 2 * k + ranges[k] + 2 * (c - starts[k])
                        g = struct.unpack(">H", t[place : place + 2])[0] if place + 2 <= len(t) else 0
                        if not g:
                            continue
                    out.setdefault((g + deltas[k]) & 0xFFFF, chr(c))
        elif kind == 12:
            for k in range(min(struct.unpack(">I", t[12:16])[0], 100_000)):
                lo, hi, g = struct.unpack(">III", t[16 + 12 * k : 28 + 12 * k])
                for c in range(lo, min(hi, 0x10FFFF) + 1):
                    out.setdefault(g + c - lo, chr(c))
    return out


def _embedded_map(body: bytes, objs: dict[int, bytes]) -> dict[int, str]:
    """Characters of a composite font without a Unicode map, from the font program it embeds."""
    below = _follow(re.search(rb"/DescendantFonts\s*\[?\s*(\d+)\s+\d+\s+R", body), objs)
    if below.lstrip().startswith(b"["):
        below = _follow(_REF.search(below), objs)
    program = _follow(re.search(rb"/FontFile2\s+(\d+)\s+\d+\s+R", _follow(re.search(rb"/FontDescriptor\s+(\d+)\s+\d+\s+R", below), objs)), objs)
    if not program or b"/Identity" not in body:
        return {}
    try:
        by_glyph = truetype_map(_stream(program, objs))
    except (struct.error, ValueError, zlib.error):
        return {}
    order = _follow(re.search(rb"/CIDToGIDMap\s+(\d+)\s+\d+\s+R", below), objs)
    if not order:
        return by_glyph
    table = _stream(order, objs)
    return {i: by_glyph[g] for i in range(len(table) // 2) if (g := int.from_bytes(table[2 * i : 2 * i + 2], "big")) in by_glyph}


def _fonts(page: bytes, objs: dict[int, bytes]) -> dict[bytes, tuple[dict[int, str], int]]:
    """Unicode map and bytes per code of the page's fonts, by resource name."""
    res = _follow(re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page), objs) or page
    block = _follow(re.search(rb"/Font\s+(\d+)\s+\d+\s+R", res), objs)
    if not block:
        m = re.search(rb"/Font\s*<<(.*?)>>", res, re.S)
        block = m[1] if m else b""
    out = {}
    for name, num in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", block):
        body = objs.get(int(num), b"")
        uni = _follow(re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body), objs)
        wide = b"/Type0" in body
        table = _unicode_map(_stream(uni, objs)) if uni else _embedded_map(body, objs) if wide else _differences(body, objs)
        out[name] = (table, 2 if wide else 1)
    return out


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins behind ``at``, and the position behind it."""
    out, depth, n = bytearray(), 1, len(data)
    simple = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    while at < n:
        c = data[at : at + 1]
        if c == b"\\":
            d = data[at + 1 : at + 2]
            if m := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(m[0], 8) & 255)
                at += 1 + len(m[0])
                continue
            if d not in b"\r\n":
                out += simple.get(d, d)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if depth == 0:
            break
        out += c
    return bytes(out), at


def _show(raw: bytes, font: tuple[dict[int, str], int]) -> str:
    table, width = font
    if not table:
        return raw.decode("cp1252", "replace") if width == 1 else raw.decode("utf-16-be", "replace")
    codes = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
    return "".join(table.get(c, chr(c) if width == 1 else "") for c in codes)


def _page_text(content: bytes, fonts: dict) -> str:
    """Text of a page: a new line wherever the position moves down, a space at wide gaps."""
    out: list[str] = []
    stack: list = []
    font: tuple[dict[int, str], int] = ({}, 1)
    last_y, y, at, fresh = None, 0.0, 0, False

    def put(text: str) -> None:
        nonlocal last_y, fresh
        if out and last_y is not None and abs(y - last_y) > 1:
            out.append("\n")
        elif out and fresh:
            out.append(" ")
        last_y, fresh = y, False
        out.append(text)

    def num(i: int) -> float:
        try:
            return float(stack[i])
        except (ValueError, IndexError, TypeError):
            return 0.0

    array: list | None = None
    while m := _TOKEN.search(content, at):
        tok, at = m[0], m.end()
        if tok == b"(":
            value, at = literal(content, at)
        elif tok[:1] == b"<" and tok != b"<<":
            h = re.sub(rb"\s", b"", tok[1:-1])
            value = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        else:
            value = None
        if value is not None:
            (stack if array is None else array).append(value)
        elif tok == b"[":
            array = []
        elif tok == b"]":
            stack.append(array or [])
            array = None
        elif re.fullmatch(rb"[+-]?[0-9.]+", tok):
            (stack if array is None else array).append(float(tok) if tok.count(b".") < 2 and tok.strip(b"+-.") else 0.0)
        elif tok[:1] == b"/":
            stack.append(tok[1:])
        else:
            if tok == b"Tf" and len(stack) > 1:
                font = fonts.get(stack[-2], ({}, 1))
            elif tok in (b"Td", b"TD"):
                y += num(-1)
            elif tok == b"Tm":
                y = num(-1)
            elif tok == b"BT":
                y, fresh = 0.0, True
            elif tok == b"T*":
                y -= 12
            elif tok in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                y -= 12 if tok != b"Tj" else 0
                put(_show(stack[-1], font))
            elif tok == b"TJ" and stack and isinstance(stack[-1], list):
                put("".join(" " if isinstance(x, float) and x < -200 else "" if isinstance(x, float) else _show(x, font) for x in stack[-1]))
            stack = []
    return "".join(out).strip()


def pages(data: bytes) -> list[str]:
    objs = _objects(data)
    out = []
    for num in _page_numbers(objs):
        try:
            page = objs[num]
            m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
            body = b"\n".join(_stream(objs.get(int(r[1]), b""), objs) for r in _REF.finditer(m[1])) if m else b""
            out.append(_page_text(body, _fonts(page, objs)))
        except (ValueError, KeyError, zlib.error, IndexError):
            out.append("")
    return out


def text(data: bytes) -> str:
    return "\n".join(pages(data)).strip()


def info(data: bytes) -> dict:
    found = pages(data)
    whole = "\n".join(found).strip()
    return {"page_count": len(found), "word_count": len(whole.split()), "character_count": len(whole.encode())}


def merge(files: list[bytes]) -> bytes:
    """The pages' texts in order, rendered anew; images and layout are not kept."""
    return from_pages([p for f in files for p in pages(f)])


def page_range(count: int, first: int, last: int) -> tuple[int, int]:
    """Inclusive range within 1..count; 0 or too large means the last page."""
    first = max(first, 1)
    last = count if last <= 0 or last > count else last
    if first > last:
        raise ValueError("the first page lies behind the last")
    return first, last


def split(data: bytes, first: int, last: int = 0) -> bytes:
    found = pages(data)
    a, b = page_range(len(found), first, last)
    return from_pages(found[a - 1 : b])


def embedded_images(data: bytes, page: int = 0) -> list[tuple[str, bytes]]:
    """Image objects, of one page or of all, as (name, bytes): JPEG as it is, Flate data of 1 to 16 bits as PNG; others are skipped."""
    objs = _objects(data)
    named = None
    if page > 0:
        every = _page_numbers(objs)
        named = _reachable(objs, every[page - 1]) if page <= len(every) else set()
    out = []
    for ref, body in objs.items():
        head = _head(body)
        if not re.search(rb"/Subtype\s*/Image\b", head) or (named is not None and ref not in named):
            continue
        w, h = _int(body, b"Width", objs), _int(body, b"Height", objs)
        try:
            raw = _stream(body, objs)
            if b"/DCTDecode" in head:
                out.append((f"image_{len(out) + 1}.jpg", raw))
            elif w and h:
                bits = 1 if re.search(rb"/ImageMask\s+true", head) else _int(body, b"BitsPerComponent", objs, 8)
                if bits == 16:
                    raw = raw[::2]
                elif bits < 8:  # rows are padded to whole bytes
                    stride = len(raw) // h
                    few = np.unpackbits(np.frombuffer(raw[: stride * h], np.uint8).reshape(h, stride), axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
                    depth = max(1, few.shape[1] // w) if few.shape[1] >= 3 * w else 1
                    raw = (few[:, : w * depth] * (255 // ((1 << bits) - 1))).astype(np.uint8).tobytes()
                depth = len(raw) // (w * h)
                px = np.frombuffer(raw[: w * h * depth], np.uint8).reshape(h, w, depth)
                if depth == 4:
                    k = 255 - px[..., 3:].astype(np.int32)
                    px = ((255 - px[..., :3].astype(np.int32)) * k // 255).astype(np.uint8)
                if depth in (1, 3, 4):
                    out.append((f"image_{len(out) + 1}.png", images.to_png(px[..., 0] if depth == 1 else px)))
        except (ValueError, zlib.error, struct.error):
            continue
    return out
