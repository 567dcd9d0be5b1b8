"""Zip packages of the office formats."""

from __future__ import annotations

import io
import zipfile

_STAMP = (2020, 1, 1, 0, 0, 0)


#: Bytes a package may unpack to; a larger one is refused before anything is unpacked.
MOST = 1 << 30


def read(data: bytes, most: int = MOST) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > most:
            raise ValueError(f"package unpacks to more than {most} bytes")
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}


def write(parts: dict[str, bytes | str]) -> bytes:
    """The package; equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, _STAMP), body if isinstance(body, bytes) else body.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


MEDIA = (".png", ".jpg", ".jpeg", ".gif", ".emf", ".wmf")


def media(data: bytes) -> list[tuple[str, bytes]]:
    """Embedded media as (name, bytes); a name that occurs again gets a number, so nothing is overwritten."""
    out, seen = [], {}
    for name, body in read(data).items():
        if "/media/" in f"/{name}" and name.lower().endswith(MEDIA):
            base = name.rsplit("/", 1)[-1]
            seen[base] = n = seen.get(base, 0) + 1
            stem, dot, ext = base.rpartition(".")
            out.append((base if n == 1 else f"{stem}_{n}{dot}{ext}", body))
    return out


def content_types(overrides: dict[str, str]) -> str:
    rows = "".join(f'<Override PartName="{k}" ContentType="{v}"/>' for k, v in overrides.items())
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{rows}</Types>'


def relationships(rows: list[tuple[str, str, str]]) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{t}" Target="{to}"/>' for i, t, to in rows)
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'
