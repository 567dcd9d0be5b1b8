"""Conversion between formats by extension pair."""

from __future__ import annotations

import os
from collections.abc import Callable

from docframe.formats import docx, images, pdf, xlsx

IMAGES = ("png", "jpg", "jpeg", "gif")


def _raster(to: str) -> Callable[[bytes], bytes]:
    make = {"png": images.to_png, "gif": images.to_gif, "jpg": images.to_jpeg, "jpeg": images.to_jpeg}[to]
    return lambda data: make(images.decode(data))


def _registry() -> dict[tuple[str, str], Callable[[bytes], bytes]]:
    utf8 = lambda f: lambda b: f(b.decode("utf-8", "replace"))
    out: dict[tuple[str, str], Callable[[bytes], bytes]] = {
        ("xlsx", "csv"): lambda b: xlsx.to_csv(b).encode(),
        ("csv", "xlsx"): utf8(xlsx.from_csv),
        ("md", "docx"): utf8(docx.from_markdown),
        ("md", "pdf"): utf8(pdf.from_markdown),
        ("md", "txt"): lambda b: b,
        ("docx", "md"): lambda b: docx.to_markdown(b).encode(),
        ("docx", "txt"): lambda b: docx.to_text(b).encode(),
        ("docx", "pdf"): lambda b: pdf.from_markdown(docx.to_markdown(b)),
        ("pdf", "txt"): lambda b: pdf.text(b).encode(),
        ("pdf", "md"): lambda b: pdf.text(b).encode(),
        ("pdf", "docx"): lambda b: docx.from_markdown(pdf.text(b)),
    }
    for a in IMAGES:
        out[a, "pdf"] = lambda b: pdf.from_images([b])
        for b in IMAGES:
            out[a, b] = _raster(b)
    return out


PAIRS = _registry()


def extension(path: str) -> str:
    return os.path.splitext(path)[1].lstrip(".").lower()


def convert(data: bytes, source: str, target: str, sheet: str = "", delimiter: str = ",", quality: int = 0) -> bytes:
    """``data`` of a file named ``source`` in the format of ``target``'s extension.

    ``sheet`` and ``delimiter`` hold between workbooks and CSV, ``quality`` (1 to 100, else the usual 85) for JPEG.
    """
    pair = extension(source), extension(target)
    if not all(pair):
        raise ValueError("both names need an extension")
    if pair not in PAIRS:
        raise ValueError(f"no conversion from {pair[0]} to {pair[1]}")
    if pair == ("xlsx", "csv"):
        return xlsx.to_csv(data, sheet, delimiter).encode()
    if pair == ("csv", "xlsx"):
        return xlsx.from_csv(data.decode("utf-8", "replace"), sheet or "Sheet1", delimiter)
    if pair[1] in ("jpg", "jpeg"):
        return images.to_jpeg(images.decode(data), quality)
    return PAIRS[pair](data)
