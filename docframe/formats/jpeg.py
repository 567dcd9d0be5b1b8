"""Baseline JPEG with numpy: decoding (grey, YCbCr, RGB, CMYK; any sampling, restarts) and encoding at a quality.

It runs wherever Python does, on executors too. Many small pictures are coded and decoded together (``encode_many``,
``decode_many``): the steps are numpy's over all of them. Progressive, lossless and arithmetic-coded files are refused with a
``ValueError``. A stream that ends early gives the blocks read so far, the rest grey.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# The usual quantisation tables at quality 50, by rows.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32)
DEFAULT_QUALITY = 85

#: Blocks of the pictures coded together (as of one plane) and of those decoded together, blocks in floating point at a time, entries of the code tables looked up together.
CODED, DECODED, SLICE, LOOKUP = 1 << 13, 1 << 16, 1 << 9, 1 << 23
#: Of so few streams each is decoded by itself.
FEW = 12

#: Places of an 8 x 8 block along its diagonals, from the corner out.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COS = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[int, bytes, bytes]:
    """Bits of the longest code; length and symbol for every such number of bits a code may begin."""
    width = max((n for n in range(1, 17) if counts[n - 1]), default=1)
    lengths = [n for n in range(1, 17) for _ in range(counts[n - 1])]
    size = b"".join(bytes((n,)) * (1 << (width - n)) for n in lengths)
    value = b"".join(bytes((s,)) * (1 << (width - n)) for n, s in zip(lengths, symbols))
    return width, size[: 1 << width].ljust(1 << width, b"\0"), value[: 1 << width].ljust(1 << width, b"\0")


def _lookups(tables: Iterable[tuple[bytes, bytes]], width: int) -> np.ndarray:
    """Length << 8 | symbol of all tables, for every ``width`` bits a code may begin; 0 where none does."""
    entries, times = [], []
    for counts, symbols in tables:
        room, at = 1 << width, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                fits = min(room, 1 << (width - n))
                entries.append(n << 8 | symbols[at])
                times.append(fits)
                room, at = room - fits, at + 1
        entries.append(0)
        times.append(room)
    return np.repeat(np.array(entries, np.uint16), times)


@dataclass
class _Stream:
    """An entropy-coded segment without stuffed bytes: the coefficients of its blocks, in order, and the codes of each."""

    data: bytes
    blocks: np.ndarray  # places in the picture
    parts: np.ndarray  # component of each, counted within the scan
    codes: list[tuple[tuple[bytes, bytes], tuple[bytes, bytes]]]  # of each component, for the first and the other coefficients
    unit: int  # blocks that belong together
    more: list[bytes] = field(default_factory=list)  # what goes on after restarts that were not announced


class _Bits:
    """Bits of an entropy-coded segment from the one at ``start``."""

    def __init__(self, data: bytes, start: int = 0) -> None:
        self.data, self.at, self.buf, self.n = data, start >> 3, 0, 0
        self.limit = len(self.data)
        self.need(start & 7)
        self.n -= start & 7

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at >= self.limit:
                raise EOFError
            self.buf = (self.buf << 8 | self.data[self.at]) & 0xFFFFFFFF
            self.at += 1
            self.n += 8

    def code(self, table: tuple[int, bytes, bytes]) -> int:
        self.need(16)
        top = self.buf >> (self.n - table[0]) & ((1 << table[0]) - 1)
        size = table[1][top]
        if not size:
            raise EOFError
        self.n -= size
        return table[2][top]

    def value(self, n: int) -> int:
        if not n:
            return 0
        if n > 15:
            raise EOFError
        self.need(n)
        self.n -= n
        v = self.buf >> self.n & ((1 << n) - 1)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _alone(s: _Stream, coefs: np.ndarray, b: int = 0, i: int = 0, at: int = 0, last: list[int] | None = None) -> None:
    """Coefficients of a stream from block ``b``, coefficient ``i`` and bit ``at`` on."""
    codes = [(_lookup(*dc), _lookup(*ac)) for dc, ac in s.codes]
    blocks, parts = s.blocks.tolist(), s.parts.tolist()
    for data in (s.data, *s.more):
        bits, last = _Bits(data, at), last or [0] * len(codes)
        try:
            while b < len(blocks):
                k = parts[b]
                dc, ac = codes[k]
                block = coefs[blocks[b]]
                if not i:
                    last[k] += bits.value(bits.code(dc))
                    block[0] = last[k]
                    i = 1
                while i < 64:
                    rs = bits.code(ac)
                    run, size = rs >> 4, rs & 15
                    if not size:
                        if run != 15:
                            break
                        i += 16
                        continue
                    i += run
                    if i > 63:
                        break
                    block[i] = bits.value(size)
                    i += 1
                b, i = b + 1, 0
            return
        except EOFError:
            b, i, at, last = (b // s.unit + 1) * s.unit, 0, 0, None


def _decode_streams(streams: list[_Stream], places: list[int], coefs: np.ndarray) -> None:
    """Coefficients of all streams, whose pictures' blocks begin at ``places``: a symbol of each at a time, until few are left."""
    many = [(s, p) for s, p in zip(streams, places) if not s.more]
    for s, p in zip(streams, places):
        if s.more or len(many) < FEW:
            _alone(s, coefs[p:])
    if len(many) < FEW:
        return
    numbers: dict[tuple[bytes, bytes], int] = {}
    for s, _ in many:
        for pair in s.codes:
            for t in pair:
                numbers.setdefault(t, len(numbers))
    width = max(n for counts, _ in numbers for n in range(1, 17) if n == 1 or counts[n - 1])
    if len(numbers) << width > LOOKUP and len(many) >= 2 * FEW:
        for half in (many[: len(many) // 2], many[len(many) // 2 :]):
            _decode_streams([s for s, _ in half], [p for _, p in half], coefs)
        return
    found = _lookups(numbers, width)
    raw = np.frombuffer(b"".join(s.data for s, _ in many) + b"\0" * 8, np.uint8).astype(np.int64)
    window = raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]  # the 40 bits from every byte on
    sizes = np.array([len(s.blocks) for s, _ in many])
    place = np.concatenate([s.blocks + p for s, p in many]) * 64
    wide = max(len(s.codes) for s, _ in many)
    part = np.concatenate([s.parts for s, _ in many]) + np.repeat(np.arange(len(many)) * wide, sizes)
    table = np.array([[[numbers[t] << width for t in s.codes[min(k, len(s.codes) - 1)]] for k in range(wide)] for s, _ in many]).reshape(-1, 2)
    first_code, other_code = table[part].T.copy()
    stop = np.cumsum(sizes)
    b, i, last = stop - sizes, np.zeros(len(many), np.int64), np.zeros(len(many) * wide, np.int64)
    end = np.cumsum([8 * len(s.data) for s, _ in many])
    at = np.append(0, end[:-1])
    own = np.arange(len(many))
    begin, began = at.copy(), b.copy()
    flat = coefs.reshape(-1)
    while len(own) >= FEW:
        first = i == 0
        bits = window[at >> 3] << (at & 7)
        code = found[np.where(first, first_code[b], other_code[b]) + (bits >> (40 - width) & ((1 << width) - 1))].astype(np.int64)
        n, symbol = code >> 8, code & 255
        size = np.where(first, symbol, symbol & 15)
        j = np.where(first, 0, i + (symbol >> 4))
        taken = np.where(j > 63, 0, size)
        used = at + n + taken
        ok = (n > 0) & (at + 16 <= end) & (used <= end) & (size < 16)
        size = np.minimum(size, 15)
        value = bits >> np.maximum(40 - n - size, 0) & ((1 << size) - 1)
        value = np.where(value < 1 << size >> 1, value - (1 << size) + 1, value)
        firsts = np.flatnonzero(first & ok)
        if len(firsts):
            sums = part[b[firsts]]
            last[sums] += value[firsts]
            value[firsts] = last[sums]
        put = np.flatnonzero(ok & (first | (taken > 0)))
        flat[place[b[put]] + j[put]] = value[put]
        i = np.where(first, 1, np.where(size > 0, j + 1, np.where(symbol == 0xF0, i + 16, 64)))
        at = used
        over = i > 63
        b = b + over
        i[over] = 0
        going = ok & (b < stop[own])
        if not going.all():
            own, at, end, b, i = own[going], at[going], end[going], b[going], i[going]
    for k, *state in zip(own.tolist(), (b - began[own]).tolist(), i.tolist(), (at - begin[own]).tolist()):
        s, p = many[k]
        _alone(s, coefs[p:], *state, last[k * wide : k * wide + len(s.codes)].tolist())


def _streams(segments: list[bytes], order: list[tuple[int, int, int, int]], codes: list, mcus: int, per_row: int, restart: int) -> Iterator[_Stream]:
    """The streams of a scan. order: of each block of a unit the component, the place of the first, and the blocks to the next one, the next unit and the next row of units."""
    row, col = np.divmod(np.arange(mcus), per_row)
    start, right, down = np.array([x[1:] for x in order]).T
    blocks = (start + col[:, None] * right + row[:, None] * down).reshape(-1)
    parts = np.tile([x[0] for x in order], mcus)
    unit = len(order)
    clean = [x.replace(b"\xff\x00", b"\xff") + b"\0" * 8 for x in segments]
    if not restart:
        yield _Stream(clean[0], blocks, parts, codes, unit, clean[1:])
        return
    for k, data in enumerate(clean):
        if k * restart < mcus:
            own = slice(k * restart * unit, (k + 1) * restart * unit)
            yield _Stream(data, blocks[own], parts[own], codes, unit)


@dataclass
class _Picture:
    size: tuple[int, int]
    adobe: int | None
    comps: list[dict]
    blocks: int
    streams: list[_Stream]


def _parse(data: bytes) -> _Picture:
    at, quant, tables, restart, adobe, comps, size = 2, {}, {}, 0, None, [], None
    total, streams = 0, []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark in (0, 1):
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                step = 129 if wide else 65
                quant[k] = np.frombuffer(body[1:step], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[step:]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("broken code table")
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark in (0xC0, 0xC1):
            bits, h, w, count = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not h or not w:
                raise ValueError("only 8-bit JPEG with a size")
            size = h, w
            comps = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(count)]
            total, streams = 0, []
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline JPEG is decoded")
        elif mark == 0xDA:
            if not comps:
                raise ValueError("no frame before the scan")
            h, w = size
            hm, vm = max(c["h"] for c in comps), max(c["v"] for c in comps)
            rows, cols = -(-h // (8 * vm)), -(-w // (8 * hm))
            if not total:
                for c in comps:
                    c |= {"first": total, "rows": rows * c["v"], "cols": cols * c["h"]}
                    total += c["rows"] * c["cols"]
            end, segments = at, []
            while True:  # up to the next marker that is no restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    segments.append(data[at:end])
                    break
                if data[end + 1] == 0:
                    end += 2
                elif 0xD0 <= data[end + 1] <= 0xD7:
                    segments.append(data[at:end])
                    at = end = end + 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    segments.append(data[at:end])
                    break
            named = [(next(i for i, c in enumerate(comps) if c["id"] == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            codes = [(tables[t >> 4], tables[16 | (t & 15)]) for _, t in named]
            if len(named) == 1:  # a scan of one component has only the blocks of its own size
                c = comps[named[0][0]]
                own = -(-(-(-w * c["h"] // hm)) // 8), -(-(-(-h * c["v"] // vm)) // 8)
                streams += _streams(segments, [(0, c["first"], 1, c["cols"])], codes, own[0] * own[1], own[0], restart)
            elif named:
                order = [(k, c["first"] + v * c["cols"] + x, c["h"], c["v"] * c["cols"]) for k, c in enumerate(comps[i] for i, _ in named) for v in range(c["v"]) for x in range(c["h"])]
                streams += _streams(segments, order, codes, rows * cols, cols, restart)
            at = end
    if not total:
        raise ValueError("no picture in the JPEG")
    for c in comps:
        c["quant"] = quant[c["q"]]
    return _Picture(size, adobe, comps, total, streams)


def decode(data: bytes) -> np.ndarray:
    """RGBA pixels of a baseline JPEG."""
    return next(decode_many([data]))


def decode_many(files: Iterable[bytes]) -> Iterator[np.ndarray]:
    """RGBA pixels of baseline JPEGs, in order; the files are decoded together until their blocks are many."""
    group, blocks = [], 0
    for data in files:
        picture = _parse(data)
        if group and blocks + picture.blocks > DECODED:
            yield from _decode(group)
            group, blocks = [], 0
        group.append(picture)
        blocks += picture.blocks
    yield from _decode(group)


def _decode(pictures: list[_Picture]) -> list[np.ndarray]:
    places = np.cumsum([0, *(p.blocks for p in pictures)]).tolist()
    coefs = np.zeros((places[-1], 64), np.int32)
    _decode_streams([s for p in pictures for s in p.streams], [at for p, at in zip(pictures, places) for _ in p.streams], coefs)
    out: list = [None] * len(pictures)
    alike: dict[tuple, list[int]] = {}
    for n, p in enumerate(pictures):
        if len({(c["h"], c["v"]) for c in p.comps}) == 1:  # all samples of a pixel stand at the same place of equal blocks
            alike.setdefault((len(p.comps), p.adobe), []).append(n)
            continue
        hm, vm = max(c["h"] for c in p.comps), max(c["v"] for c in p.comps)
        planes = []
        for c in p.comps:
            px = _pixels(coefs[places[n] + c["first"] :][: c["rows"] * c["cols"]], c["quant"])
            px = px.reshape(c["rows"], c["cols"], 8, 8).transpose(0, 2, 1, 3).reshape(c["rows"] * 8, c["cols"] * 8)
            planes.append(np.repeat(np.repeat(px, vm // c["v"], 0), hm // c["h"], 1)[: p.size[0], : p.size[1]])
        out[n] = _colours(planes, p.adobe)
    for (count, adobe), own in alike.items():
        sizes = [pictures[n].blocks // count for n in own]
        each = [np.concatenate([coefs[places[n] + k * m :][:m] for n, m in zip(own, sizes)]) for k in range(count)]
        quant = [np.array([pictures[n].comps[k]["quant"] for n in own]) for k in range(count)]
        picture = np.repeat(np.arange(len(own)), sizes)
        rgba = np.empty((len(picture), 8, 8, 4), np.uint8)
        for at in range(0, len(picture), SLICE):
            part = slice(at, at + SLICE)
            rgba[part] = _colours([_pixels(x[part], q[picture[part]]) for x, q in zip(each, quant)], adobe)
        at = 0
        for n, m in zip(own, sizes):
            (h, w), c = pictures[n].size, pictures[n].comps[0]
            tiles = rgba[at : at + m].reshape(c["rows"], c["cols"], 8, 8, 4).transpose(0, 2, 1, 3, 4)
            out[n] = tiles.reshape(c["rows"] * 8, c["cols"] * 8, 4)[:h, :w].copy()
            at += m
    return out


def _pixels(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples of blocks, from coefficients along the diagonals."""
    raw = np.empty((len(coefs), 64))
    raw[:, ZIGZAG] = coefs * quant
    return _COS.T @ raw.reshape(-1, 8, 8) @ _COS + 128


def _colours(planes: list[np.ndarray], adobe: int | None) -> np.ndarray:
    out = np.full((*planes[0].shape, 4), 255, np.uint8)
    if len(planes) == 1:
        rgb = [planes[0]] * 3
    elif len(planes) == 2 or (len(planes) == 3 and adobe == 0):
        rgb = (planes * 2)[:3]
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        if len(planes) == 4:
            if adobe != 2:
                rgb = planes[:3]
            k = planes[3]
            ink = [x if adobe is not None else 255 - x for x in (*rgb, k)]  # files of that maker hold inverted inks
            rgb = [np.clip(x, 0, 255) * np.clip(ink[3], 0, 255) / 255 for x in ink[:3]]
    out[..., :3] = np.clip(np.stack(rgb, -1) + 0.5, 0, 255)
    return out


def _code_lengths(freq: dict[int, int]) -> list[tuple[int, int]]:
    """(length, symbol) of a code of at most 16 bits; the code of all ones is left free, as the format asks."""
    while True:
        heap = [(n, s, k) for k, (s, n) in enumerate(freq.items())] + [(0, 256, len(freq))]
        heapq.heapify(heap)
        above = [0] * (2 * len(heap) - 1)
        for node in range(len(heap), len(above)):
            a, b = heapq.heappop(heap), heap[0]
            above[a[2]] = above[b[2]] = node
            heapq.heapreplace(heap, (a[0] + b[0], min(a[1], b[1]), node))
        depth = [0] * len(above)
        for node in range(len(above) - 2, -1, -1):
            depth[node] = depth[above[node]] + 1
        length = dict(zip([*freq, 256], depth))
        if max(length.values()) <= 16:
            longest = max(length.values())
            if length[256] != longest:  # the free code must be among the longest
                other = next(s for s, n in length.items() if n == longest)
                length[256], length[other] = length[other], length[256]
            return sorted((n, s) for s, n in length.items() if s != 256)
        freq = {s: n // 2 + 1 for s, n in freq.items()}


def _codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    out, code, size = {}, 0, 0
    for n, s in lengths:
        code <<= n - size
        size = n
        out[s] = code, n
        code += 1
    return out


@lru_cache(maxsize=100)
def quantisation(quality: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(np.int32) for t in (LUMINANCE, CHROMINANCE))


def encode(pixels: np.ndarray, quality: int = 0) -> bytes:
    """Baseline JPEG of RGB(A) pixels; transparent ones lie on white. A quality outside 1 to 100 means the usual one."""
    return next(encode_many([pixels], quality))


def encode_many(pictures: Iterable[np.ndarray], quality: int = 0) -> Iterator[bytes]:
    """JPEGs of pictures as ``encode`` makes them, in order; the pictures are coded together until their blocks are many."""
    group, blocks = [], 0
    for pixels in pictures:
        tiles = _tiles(pixels)
        if group and blocks + len(tiles) > CODED:
            yield from _encode(group, quality)
            group, blocks = [], 0
        group.append((pixels.shape[:2], tiles))
        blocks += len(tiles)
    if group:
        yield from _encode(group, quality)


def _tiles(pixels: np.ndarray) -> np.ndarray:
    """RGBA of the blocks by rows, the last row and column repeated."""
    h, w, channels = pixels.shape
    rows, cols = -(-h // 8), -(-w // 8)
    full = np.full((rows * 8, cols * 8, 4), 255, pixels.dtype)
    full[:h, :w, :channels] = pixels
    full[h:, :w] = full[h - 1, :w]
    full[:, w:] = full[:, w - 1 : w]
    return full.reshape(rows, 8, cols, 8, 4).transpose(0, 2, 1, 3, 4).reshape(-1, 8, 8, 4)


def _coefficients(tiles: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of every block three times 64 coefficients along the diagonals."""
    out = np.empty((len(tiles), 3, 64), np.int16)
    for at in range(0, len(tiles), SLICE):
        part = tiles[at : at + SLICE]
        r, g, b = (part[..., k].astype(np.float64) for k in range(3))
        if (part[..., 3] != 255).any():
            a = part[..., 3] / 255
            r, g, b = (x * a + 255 * (1 - a) for x in (r, g, b))
        planes = 0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b
        for k, p in enumerate(planes):
            coef = (_COS @ p @ _COS.T).reshape(-1, 64) / tables[min(k, 1)]
            out[at : at + SLICE, k] = np.take(np.rint(coef), ZIGZAG, 1)
    return out


def _encode(pictures: list[tuple[tuple[int, int], np.ndarray]], quality: int) -> Iterator[bytes]:
    quality = quality if 1 <= quality <= 100 else DEFAULT_QUALITY
    tables = quantisation(quality)
    sizes = np.array([len(tiles) for _, tiles in pictures])
    first = np.cumsum(sizes) - sizes
    coded = _coefficients(np.concatenate([tiles for _, tiles in pictures]), tables)
    steps = coded[:, :, 0].astype(np.int64)
    steps[1:] -= coded[:-1, :, 0]
    steps[first] = coded[first, :, 0]
    steps = steps.reshape(-1)
    # symbols first, so that the codes fit the picture: of each block the step from the last one, runs of zeros with what ends them, the end
    blocks = coded.reshape(-1, 64)
    blocks[:, 0] = 0
    places = np.flatnonzero(blocks.reshape(-1) != 0)
    row, col = places >> 6, places & 63
    value = blocks.reshape(-1)[places].astype(np.int64)
    run = col - 1
    run[1:] -= np.where(row[1:] == row[:-1], col[:-1], 0)
    ends = np.zeros(len(blocks), np.int64)
    ends[row] = col
    short = ends < 63
    own = (run >> 4) + 1
    inner = np.bincount(row, own, len(blocks)).astype(np.int64)
    count = 1 + inner + short
    start = np.cumsum(count) - count
    at = start[row] + np.cumsum(own) - (np.cumsum(inner) - inner)[row]
    # a key is the number of the picture, that of the table and the symbol
    chroma = np.tile([0, 256, 256], len(blocks) // 3) + np.repeat(np.arange(len(pictures)) * 1024, sizes * 3)
    key = np.repeat(chroma + 512 + 0xF0, count)
    bits, extra = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for to, base, v in ((start, chroma, steps), (at, (chroma + 512)[row] + ((run & 15) << 4), value)):
        n = np.frexp(np.abs(v))[1].astype(np.int64)
        key[to], bits[to], extra[to] = base + n, n, np.where(v < 0, v + (1 << n) - 1, v)
    key[(start + count - 1)[short]] = (chroma + 512)[short]
    freq = np.bincount(key, minlength=len(pictures) * 1024)
    used = np.flatnonzero(freq)
    bounds = np.searchsorted(used, np.arange(len(pictures) * 4 + 1) * 256).tolist()
    symbols, counts = (used & 255).tolist(), freq[used].tolist()
    lengths, codes = [], [0] * len(used)
    for a, b in zip(bounds, bounds[1:]):
        lengths.append(_code_lengths(dict(zip(symbols[a:b], counts[a:b]))))
        of = _codes(lengths[-1])
        codes[a:b] = (of[s][0] << 8 | of[s][1] for s in symbols[a:b])
    code = np.zeros(len(freq), np.int64)
    code[used] = codes
    code = code[key]
    # whole words of 32 bits for every picture; a word is the sum of what falls into it
    total = (code & 255) + bits
    upto = np.cumsum(total)
    last = np.append(start[3 * first[1:]], len(key)) - 1
    length = np.diff(upto[last], prepend=0)
    words = -(-length // 32)
    word = np.cumsum(words) - words
    at = upto - total + np.repeat(32 * word - (upto[last] - length), np.diff(last, prepend=-1))
    both = ((code >> 8) << bits | extra).astype(np.uint64) << (64 - (at & 31) - total).astype(np.uint64)
    at >>= 5
    size = int(words.sum()) + 2
    sums = np.bincount(at, both >> np.uint64(32), size) + np.bincount(at + 1, both & np.uint64(0xFFFFFFFF), size)
    stream = sums.astype(np.uint32).astype(">u4").tobytes()
    head = [b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"]
    for k, t in enumerate(tables):
        head.append(struct.pack(">BBHB", 0xFF, 0xDB, 67, k) + bytes(t[ZIGZAG].tolist()))
    for n, ((h, w), _) in enumerate(pictures):
        out = [*head, struct.pack(">BBHBHHB", 0xFF, 0xC0, 17, 8, h, w, 3) + bytes((1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1))]
        for t, own in zip((0, 1, 16, 17), lengths[4 * n : 4 * n + 4]):
            each = [0] * 17
            for m, _ in own:
                each[m] += 1
            out.append(struct.pack(">BBHB", 0xFF, 0xC4, 19 + len(own), t) + bytes(each[1:]) + bytes([s for _, s in own]))
        out.append(struct.pack(">BBHB", 0xFF, 0xDA, 12, 3) + bytes((1, 0, 2, 0x11, 3, 0x11, 0, 63, 0)))
        body = bytearray(stream[4 * int(word[n]) :][: -(-int(length[n]) // 8)])
        body[-1] |= (1 << -int(length[n]) % 8) - 1
        yield b"".join(out) + bytes(body).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
