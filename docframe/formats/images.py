"""Raster images with the standard library and numpy: headers, PNG and GIF codecs, and a small text renderer."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from docframe.formats import jpeg

PNG_MAGIC, JPEG_MAGIC = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"


def info(data: bytes) -> dict | None:
    """format, width, height, aspect_ratio (0 without a height), file_size from the header alone; None if unknown."""
    kind = size = None
    if data[:8] == PNG_MAGIC and len(data) >= 24:
        kind, size = "png", struct.unpack(">II", data[16:24])
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        kind, size = "gif", struct.unpack("<HH", data[6:10])
    elif data[:2] == JPEG_MAGIC:
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
            elif 0xD0 <= mark <= 0xD9 or mark == 1:
                at += 2
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                kind, size = "jpeg", (w, h)
                break
            else:
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if kind is None:
        return None
    w, h = size
    return {"format": kind, "width": w, "height": h, "aspect_ratio": w / h if h else 0.0, "file_size": len(data)}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(pixels: np.ndarray) -> bytes:
    """PNG of an array (height, width), (height, width, 3) or (height, width, 4) of bytes."""
    h, w = pixels.shape[:2]
    depth = 1 if pixels.ndim == 2 else pixels.shape[2]
    rows = np.zeros((h, 1 + w * depth), np.uint8)
    rows[:, 1:] = pixels.reshape(h, w * depth)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[depth], 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG-filtered byte stream; ``step`` is the bytes of a pixel. Filters go by pixel, all bytes of one at once, or by whole rows."""
    out = np.zeros((height, stride), np.uint8)
    prev = np.zeros(stride, np.uint8)
    wide = -stride % step
    for y in range(height):
        row = raw[y * (stride + 1) : (y + 1) * (stride + 1)]
        if len(row) < stride + 1:
            break
        kind, line = row[0], np.frombuffer(row, np.uint8, offset=1).copy()
        if kind == 1:  # running sums by byte of the pixel
            line = np.add.accumulate(np.pad(line, (0, wide)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            line += prev
        elif kind in (3, 4):
            cur, up = line.tolist(), prev.tolist()
            left, corner = [0] * step + cur, [0] * step + up
            for x in range(stride):
                a, b = left[x], up[x]
                if kind == 3:
                    add = (a + b) // 2
                else:
                    c = corner[x]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    add = a if pa <= pb and pa <= pc else b if pb <= pc else c
                left[x + step] = (left[x + step] + add) & 255
            line = np.array(left[step:], np.uint8)
        out[y] = line
        prev = line
    return out


#: The passes of an interlaced PNG: first column and row, steps between them.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _samples(raw: bytes, w: int, h: int, depth: int, bits: int) -> tuple[np.ndarray, int]:
    """Samples (height, width, depth) of a filtered pass and the bytes it took."""
    stride = (w * depth * bits + 7) // 8
    rows = unfilter(raw, h, stride, max(1, depth * bits // 8))
    if bits == 16:
        px = rows.reshape(h, w * depth, 2).astype(np.uint16)
        px = px[..., 0] << 8 | px[..., 1]
    elif bits == 8:
        px = rows
    else:
        px = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
    return px[:, : w * depth].reshape(h, w, depth), h * (stride + 1)


def from_png(data: bytes) -> np.ndarray:
    """RGBA pixels of a PNG of 1 to 16 bits, interlaced or not; 16-bit samples keep their upper byte."""
    at, idat, palette, alpha, head = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, bits, color, _, _, interlace = head
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = zlib.decompress(b"".join(idat))
    px = np.zeros((h, w, depth), np.uint16)
    for x0, y0, dx, dy in _PASSES if interlace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw > 0 and ph > 0:
            px[y0::dy, x0::dx], used = _samples(raw, pw, ph, depth, bits)
            raw = raw[used:]
    out = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        full = np.zeros((1 << bits, 4), np.uint8)
        full[:, 3] = 255
        full[: len(palette), :3] = palette
        full[: len(alpha or b""), 3] = np.frombuffer(alpha or b"", np.uint8)
        return full[px[..., 0]]
    clear = None
    if alpha is not None and color in (0, 2):  # one sample value that stands for transparent
        clear = (px == np.frombuffer(alpha, ">u2")[:depth]).all(axis=2)
    px = (px >> 8 if bits == 16 else px * (255 // ((1 << bits) - 1))).astype(np.uint8)
    if color in (0, 4):
        out[..., :3] = px[..., :1]
        if color == 4:
            out[..., 3] = px[..., 1]
    else:
        out[..., :depth] = px
    if clear is not None:
        out[clear, 3] = 0
    return out


def to_gif(pixels: np.ndarray) -> bytes:
    """GIF of RGB(A) pixels, reduced to a palette of 6 x 7 x 6 colours."""
    rgb = pixels[..., :3].astype(np.int32)
    h, w = rgb.shape[:2]
    idx = ((rgb[..., 0] * 5 + 127) // 255) * 42 + ((rgb[..., 1] * 6 + 127) // 255) * 6 + (rgb[..., 2] * 5 + 127) // 255
    pal = bytes(v for r in range(6) for g in range(7) for b in range(6) for v in (r * 255 // 5, g * 255 // 6, b * 255 // 5))
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), pal.ljust(768, b"\0"), b",", struct.pack("<HHHHB", 0, 0, w, h, 0), b"\x08"]
    body = _lzw(idx.reshape(-1).tolist())
    for i in range(0, len(body), 255):
        part = body[i : i + 255]
        out.append(bytes([len(part)]) + part)
    return b"".join(out) + b"\0;"


def _lzw(codes: list[int]) -> bytes:
    clear, stop = 256, 257
    table: dict[tuple[int, int], int] = {}
    nxt, width, acc, have, out = 258, 9, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal acc, have
        acc |= code << have
        have += width
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8

    put(clear)
    cur = codes[0] if codes else stop
    for c in codes[1:]:
        key = (cur, c)
        if key in table:
            cur = table[key]
            continue
        put(cur)
        if nxt < 4096:
            table[key] = nxt
            nxt += 1
            if nxt > (1 << width) and width < 12:
                width += 1
        else:
            put(clear)
            table.clear()
            nxt, width = 258, 9
        cur = c
    if codes:
        put(cur)
    put(stop)
    if have:
        out.append(acc & 255)
    return bytes(out)


def from_gif(data: bytes) -> np.ndarray:
    """RGBA pixels of the first frame."""
    w, h, flags = struct.unpack("<HHB", data[6:11])
    at, pal, transparent = 13, None, None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        pal, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    out = np.zeros((h, w, 4), np.uint8)

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data):
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and body[0] & 1:
                transparent = body[3]
        elif data[at] == 0x2C:
            x, y, fw, fh, ff = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if ff & 0x80:
                n = 3 * (2 << (ff & 7))
                pal, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
            size = data[at]
            body, at = blocks(at + 1)
            px = np.array(_unlzw(body, size)[: fw * fh], np.int64)
            px = np.pad(px, (0, fw * fh - len(px))).reshape(fh, fw)
            if ff & 0x40:
                order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, fh, d)]
                flat = np.empty_like(px)
                flat[order] = px
                px = flat
            out[y : y + fh, x : x + fw, :3] = pal[np.minimum(px, len(pal) - 1)]
            out[y : y + fh, x : x + fw, 3] = 255 if transparent is None else np.where(px == transparent, 0, 255)
            break
        else:
            break
    return out


def _unlzw(body: bytes, size: int) -> list[int]:
    clear, stop = 1 << size, (1 << size) + 1
    out: list[int] = []
    table = [[i] for i in range(clear)] + [[], []]
    width, acc, have, prev = size + 1, 0, 0, None
    for byte in body:
        acc |= byte << have
        have += 8
        while have >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            have -= width
            if code == clear:
                table = [[i] for i in range(clear)] + [[], []]
                width, prev = size + 1, None
                continue
            if code == stop:
                return out
            if prev is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else [*prev, prev[0]]
                if len(table) < 4096:
                    table.append([*prev, entry[0]])
            out += entry
            prev = entry
            if len(table) >= (1 << width) and width < 12:
                width += 1
    return out


def decode(data: bytes) -> np.ndarray:
    kind = (info(data) or {}).get("format")
    if kind == "png":
        return from_png(data)
    if kind == "gif":
        return from_gif(data)
    if kind == "jpeg":
        return jpeg.decode(data)
    raise ValueError("unknown image format")


def to_jpeg(pixels: np.ndarray, quality: int = 0) -> bytes:
    return jpeg.encode(pixels, quality)


# --- text on a page ---------------------------------------------------------------------------------------------
# Glyphs are strokes on a 5 x 7 grid, as on a sixteen-segment display; lower case is drawn as small capitals.
_SEGMENTS = {
    "a": [(0, 0), (1, 0), (2, 0)], "A": [(2, 0), (3, 0), (4, 0)], "b": [(4, y) for y in range(4)], "c": [(4, y) for y in range(3, 7)], "d": [(0, 6), (1, 6), (2, 6)], "D": [(2, 6), (3, 6), (4, 6)],
    "e": [(0, y) for y in range(3, 7)], "f": [(0, y) for y in range(4)], "g": [(0, 3), (1, 3), (2, 3)], "G": [(2, 3), (3, 3), (4, 3)], "h": [(0, 0), (1, 1), (1, 2)], "i": [(2, y) for y in range(4)],
    "j": [(4, 0), (3, 1), (3, 2)], "k": [(3, 4), (3, 5), (4, 6)], "l": [(2, y) for y in range(3, 7)], "m": [(1, 4), (1, 5), (0, 6)], ".": [(2, 6)], ":": [(2, 2), (2, 5)], "'": [(2, 0), (2, 1)], "-": [(1, 3), (2, 3), (3, 3)],
}
# Segments of every printable character.
_GLYPHS = dict(
    zip(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
        "aAbcefgG aAbcdDGil aAdDef aAbcdDil aAdDefg aAefg aAdDefGc bcefgG aAdDil bcdDe efgjk dDef bcefhj bcefhk aAbcdDef aAbefgG aAbcdDefk aAbefgGk aAcdDfgG aAil bcdDef efmj bcefmk hjkm hjl aAdDjm "
        "aAbcdDefjm bcj aAbdDegG aAbcdDG bcfgG aAcdDfgG aAcdDefgG aAbc aAbcdDefgG aAbcdDfgG _ i. fi bcdDGil aAcdDfgGil cfjmai adDefghk ' jk hm hijkgGlm gGil m gG . jm : :m jk gGdD hm aAbGl aAbdDeGi Adl hk ail hj dD h Adlg il aDlG gG".split(),
    )
)


def _glyph(ch: str) -> np.ndarray:
    grid = np.zeros((7, 5), bool)
    small = ch.islower()
    name = _GLYPHS.get(ch.upper() if small else ch, _GLYPHS["?"])
    for s in name:
        for x, y in _SEGMENTS.get(s, ()):
            grid[y, x] = True
    if small:
        low = np.zeros_like(grid)
        low[2:] = grid[[0, 1, 3, 5, 6]]
        return low
    return grid


def draw_text(pixels: np.ndarray, x: int, y: int, text: str, scale: int = 2, ink: tuple[int, int, int] = (30, 30, 30)) -> None:
    for ch in text:
        big = np.kron(_glyph(ch), np.ones((scale, scale), bool))
        h, w = big.shape
        part = pixels[y : y + h, x : x + w]
        part[big[: part.shape[0], : part.shape[1]]] = ink
        x += 6 * scale
        if x >= pixels.shape[1]:
            return


def wrap(text: str, limit: int = 80) -> list[str]:
    """Words wrapped to lines of at most ``limit`` characters; a longer word has a line of its own."""
    out, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > limit:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*out, line] if line else out or [""]


def snapshot(lines: list[str], title: str = "", width: int = 800, height: int = 1100) -> bytes:
    """PNG of a page of text: a frame, a title bar, wrapped lines as far as they fit."""
    px = np.full((height, width, 3), 255, np.uint8)
    px[:4], px[-4:], px[:, :4], px[:, -4:] = 120, 120, 120, 120
    y = 30
    if title:
        px[10:50, 10:-10] = (232, 237, 243)
        draw_text(px, 20, 22, title[:60], 2, (20, 40, 90))
        y = 70
    per_line = (width - 60) // 6 - 1
    for line in lines:
        head = line.startswith("#")
        scale = 2 if head else 1
        for part in wrap(line.lstrip("# ") if head else line, min(80, per_line // scale)):
            if y + 10 * scale > height - 20:
                return to_png(px)
            draw_text(px, 30, y, part, scale)
            y += 10 * scale + 4
    return to_png(px)
