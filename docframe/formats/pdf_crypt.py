"""Reading encrypted PDFs that open without a password: the standard handler with RC4 or AES of 128 bits.

Only streams are decrypted; text and images live in them. Other handlers, 256-bit keys and files that ask for a password
are refused with a ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct

# Fixed value: what passwords are filled up with.
_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray(len(data))
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution and its inverse, from their definition: the inverse element, then an affine map."""
    box = bytearray(256)
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        v = 0x63
        for k in range(5):
            v ^= (inv << k | inv >> (8 - k)) & 255
        box[x] = v
    back = bytearray(256)
    for x, v in enumerate(box):
        back[v] = x
    return bytes(box), bytes(back)


_BOX, _BACK = _boxes()
_MUL = {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}
_ROWS = [(r + 4 * ((c + r) % 4)) for c in range(4) for r in range(4)]
_ROWS_BACK = [(r + 4 * ((c - r) % 4)) for c in range(4) for r in range(4)]


def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words = [key[i : i + 4] for i in range(0, len(key), 4)]
    power = 1
    while len(words) < 4 * (n + 7):
        w = words[-1]
        if len(words) % n == 0:
            w = bytes((_BOX[w[1]] ^ power, _BOX[w[2]], _BOX[w[3]], _BOX[w[0]]))
            power = _times(power, 2)
        elif n > 6 and len(words) % n == 4:
            w = bytes(_BOX[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[-n], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b))


def _mix(s: bytes, by: tuple[int, int, int, int]) -> bytes:
    m = [_MUL.get(k) for k in by]
    out = bytearray(16)
    for c in range(0, 16, 4):
        for r in range(4):
            v = 0
            for k in range(4):
                x = s[c + (r + k) % 4]
                v ^= m[k][x] if m[k] else x
            out[c + r] = v
    return bytes(out)


def aes_encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[0])
    for k in keys[1:-1]:
        s = _xor(_mix(bytes(_BOX[s[i]] for i in _ROWS), (2, 3, 1, 1)), k)
    return _xor(bytes(_BOX[s[i]] for i in _ROWS), keys[-1])


def aes_decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[-1])
    for k in reversed(keys[1:-1]):
        s = _mix(_xor(bytes(_BACK[s[i]] for i in _ROWS_BACK), k), (14, 11, 13, 9))
    return _xor(bytes(_BACK[s[i]] for i in _ROWS_BACK), keys[0])


def aes_cbc_decrypt(key: bytes, data: bytes) -> bytes:
    """Data that begins with its initial vector; the padding is taken off."""
    keys, prev, out = _round_keys(key), data[:16], bytearray()
    for i in range(16, len(data) - len(data) % 16, 16):
        block = data[i : i + 16]
        out += _xor(aes_decrypt_block(keys, block), prev)
        prev = block
    return bytes(out[: -out[-1]]) if out and 1 <= out[-1] <= 16 else bytes(out)


def _text(body: bytes, key: bytes) -> bytes:
    """A string of a dictionary, written in parentheses or in hexadecimal."""
    if m := re.search(rb"/" + key + rb"\s*<([0-9A-Fa-f\s]*)>", body):
        return bytes.fromhex(re.sub(rb"\s", b"", m[1]).decode())
    m = re.search(rb"/" + key + rb"\s*\(", body)
    if not m:
        return b""
    from docframe.formats.pdf import literal

    return literal(body, m.end())[0]


def _number(body: bytes, key: bytes, default: int) -> int:
    m = re.search(rb"/" + key + rb"\s+(-?\d+)", body)
    return int(m[1]) if m else default


def file_key(encrypt: bytes, first_id: bytes) -> tuple[bytes, bool]:
    """(key of the file, is it AES) from the encryption dictionary."""
    version, revision = _number(encrypt, b"V", 0), _number(encrypt, b"R", 2)
    if not re.search(rb"/Filter\s*/Standard\b", encrypt) or version not in (1, 2, 4):
        raise ValueError("encrypted in a way that is not read")
    aes = version == 4 and b"/AESV2" in encrypt
    n = 5 if revision == 2 else 16 if version == 4 else _number(encrypt, b"Length", 40) // 8
    owner, user = _text(encrypt, b"O")[:32], _text(encrypt, b"U")
    h = hashlib.md5(_PAD + owner + struct.pack("<I", _number(encrypt, b"P", 0) & 0xFFFFFFFF) + first_id)
    if revision >= 4 and re.search(rb"/EncryptMetadata\s+false", encrypt):
        h.update(b"\xff\xff\xff\xff")
    key = h.digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:n]).digest()
    key = key[:n]
    if revision == 2:
        right = rc4(key, _PAD) == user[:32]
    else:
        check = rc4(key, hashlib.md5(_PAD + first_id).digest())
        for i in range(1, 20):
            check = rc4(bytes(b ^ i for b in key), check)
        right = check == user[:16]
    if not right:
        raise ValueError("a password is needed")
    return key, aes


def decrypt(key: bytes, aes: bool, number: int, generation: int, data: bytes) -> bytes:
    """A stream of an object."""
    own = hashlib.md5(key + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if aes else b"")).digest()[: min(len(key) + 5, 16)]
    return aes_cbc_decrypt(own, data) if aes else rc4(own, data)
