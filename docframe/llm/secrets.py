"""Find literal credentials in code and configuration lines and redact exactly their characters.

Every line is cut into lexical tokens; a linear-chain conditional random field with shape and context
features labels each token as secret or not, and the Viterbi spans are what is redacted. No filter stands
before the field. It is trained on the labelled lines of ``secret_lines`` (``EXAMPLES`` of them, a fixed bound), in a
few seconds on the driver, and broadcast (``DIMS`` numbers).

The score of a token is the sum of its own features, kept per token, and of the features of its context, kept per
context; contexts are combinations of a few names and signs, so a worker computes most of them once. A line in which no
token's score can outweigh the cost of a span has no span, which spares most lines the Viterbi pass; the
result is the same. Equal lines are not merged: a shuffle would cost more than it saves.

Private key blocks span lines. Marker lines are put in order within blocks of ``BLOCK`` lines of a file and the
open marker is handed from block to block, so one hot file is never sorted by one task. Between BEGIN and END every non-null
line counts, where most lines look like key material; otherwise, and without the other marker, the unbroken run of key lines next to the marker, however long.

Defined cases: null and empty texts hold nothing of their own; what is redacted already (``MASK``) is no secret. Repeated rows are each reported. Rows without
file or line number can hold secrets of their own line only. In tables of matches the context arrays take the
place of neighbouring lines. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docframe.llm.secret_lines import examples
from docframe.session import BROADCAST_ROWS, checkpoint

EXAMPLES = 40_000
DIMS = 1 << 18
MASK = "REDACTED"
BLOCK = 4096

BEGIN_LINE = r"^(?:[^-]*[=:(]\s*)?\W*-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\\[nr]|\W)*$"
END_LINE = r"^\W*-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\\[nr]|\W)*$"
ANY_MARK = r"^(?:[^-]*[=:(]\s*)?\W*-----(?:BEGIN|END) [A-Z0-9 ]+-----(?:\\[nr]|\W)*$"
BODY = r"^[\s>#*/|\"'+-]*(?:[A-Za-z0-9+/]+={0,2})?(?:\\[nr]|[\"',;+\\\s])*$"
BODY_SURE = r"^[\s>#*/|\"'+-]*[A-Za-z0-9+/]{16,}={0,2}(?:\\[nr]|[\"',;+\\\s])*$"
KEY_HEADER = r"^[\s>#*/|\"'+-]*[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*: "

_LEX = re.compile(
    r"-----(?:BEGIN|END)[A-Z0-9 ]+-----"  # armour
    r"|\\[nrt]"  # escapes
    r"|(?<!\S)-[A-Za-z](?=[^\s=-])"  # a short flag with its value attached
    r"|https?://|[a-z]+://"
    r"|[A-Za-z0-9+/]{12,}={1,2}(?![\w=])"
    r"|(?:[\w.+/~!#%*^?-]|\$(?![{(]))+"
    r"|\$\{|\{\{|\}\}|\$\(|[^\s\w]"
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
# Stems that name a credential in several languages.
STRONG = ("password", "passwd", "pass", "pwd", "pw", "secret", "token", "apikey", "auth", "credential", "credentials", "bearer", "basic", "jwt", "identified", "kennwort", "passwort", "geheim", "contrase", "clave", "passe", "motdepasse", "passphrase", "senha", "chave", "парол", "wachtwoord", "hasło", "heslo", "lösenord", "senord", "adgangskode", "salasana", "jelsz", "parola", "şifre", "pin")
# Other stems that tell secrets from harmless values.
_STEMS = (*STRONG, "key", "login", "cert", "private", "public", "sha", "md", "checksum", "commit", "etag", "integrity", "hash", "digest", "id", "uuid", "rsa", "ssh", "base", "fromhex", "client", "connect", "request", "set", "secure", "storage", "account", "count", "fingerprint", "signing", "encryption", "access", "value", "user", "uid", "admin", "root", "hint", "length", "type", "name", "serial", "version", "build", "session", "trace", "api", "shared", "master", "cookie", "url", "http", "https", "path", "example", "secretary", "tokens", "tokenizer", "passage", "passenger", "keyboard", "class", "func", "def", "import", "return", "for", "if")
_STEM_SET = frozenset(_STEMS)
#: Stems that also count within a longer part of a name, such as ``userpassword`` or a name read with the wrong code page.
_LONG_STEMS = tuple(s for s in _STEMS if len(s) > 5 or s in ("парол", "jelsz"))
_STRONG_SET = frozenset(STRONG)
_HEX = re.compile(r"[0-9a-f]+$|[0-9A-F]+$")
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
_VOWEL = re.compile(r"[aeiouyAEIOUY]")
_ALNUM = re.compile(r"[^\W_]")


def lex(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in _LEX.finditer(line)]


def token_names(tok: str) -> tuple[str, ...]:
    """Names a token lends to the context of those after it: the stems in it, at most the last three."""
    if tok.startswith("-----"):
        return ("armour-private",) if "PRIVATE KEY" in tok else ("armour-other",)
    parts = [p.lower() for p in _PARTS.findall(tok)]
    if len(parts) > 12:
        return ("long",)
    out = [p for p in parts if p in _STEM_SET]
    if not out:
        low = tok.lower()
        out = [s for s in _LONG_STEMS if s in low][:2]
    return tuple(out[-3:]) or (("word",) if any(p[0].isalpha() for p in parts) else ("number",) if parts else ())


def token_shape(tok: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """(class, structural features, other features) of a token; the class and the structural ones are combined with the context."""
    n = len(tok)
    low = sum(map(str.islower, tok))
    up = sum(map(str.isupper, tok))
    dig = sum(map(str.isdigit, tok))
    sym = n - low - up - dig
    size = "0" if n < 4 else "1" if n < 6 else "2" if n < 8 else "3" if n < 12 else "4" if n < 18 else "5" if n < 26 else "6" if n < 48 else "7"
    kinds = ("l" if low else "") + ("u" if up else "") + ("d" if dig else "") + ("s" if sym else "")
    structure = []
    flips = 0
    if n >= 8:
        if _UUID.match(tok):
            structure.append("uuid")
        elif _HEX.match(tok):
            structure.append("hex" + (str(n) if n in (32, 40, 64, 96, 128) else ""))
        flips = sum((a.islower(), a.isupper(), a.isdigit()) != (b.islower(), b.isupper(), b.isdigit()) for a, b in zip(tok, tok[1:]))
        structure.append(f"flip{min(9, flips * 10 // n)}")
        structure.append(f"vow{min(5, len(_VOWEL.findall(tok)) * 10 // max(1, low + up))}")
    if tok[-1] == "=":
        structure.append("pad")
    if "/" in tok or "." in tok:
        structure.append("path" if tok[0] in "/." or "//" in tok else "dots")
    if "_" in tok:
        structure.append("snake" if tok.islower() else "SNAKE" if tok.isupper() else "sn")
    if not tok.isascii():
        structure.append("wide")
    if tok[-1] in "!?#$%*":
        structure.append("mark")
    opaque = "O" if dig and (low or up) else "M" if low and up and flips * 10 >= 2 * n else "o"
    other = [f"div{min(9, len(set(tok)) * 10 // n)}", "p" + tok[:4]]
    if n < 20 and not dig:
        other.append("w" + tok.lower())
    return f"{kinds}{size}{opaque}", tuple(structure), tuple(other)


def _code(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % (DIMS - 1)  # the last stands for no feature


def own_features(tok: str) -> list[int]:
    """Features of a token by itself."""
    kind = sign(tok)
    if kind:
        return [_code("punct"), _code("punct" + kind)]
    cls, structure, other = token_shape(tok)
    return [_code(x) for x in ("bias", "c" + cls, "k" + cls[:-2], "n" + cls[-2:], *structure, *other)]


def context_features(cls: str, structure: tuple[str, ...], ctx: tuple) -> list[int]:
    """Features of a class of token in a context (see ``tokens``)."""
    b, a, lead, quoted, first, at, last, k1, k2, k3, far = ctx
    size, opaque = cls[-2], cls[-1]
    f = ["b" + b, "a" + a, f"ba{b}{a}", f"l{lead}{b}", f"q{quoted}", f"f{first}", f"i{at}", f"last{last}", f"far{far}{opaque}", f"far{far}{b}{opaque}", f"lb{lead}{b}{a}{opaque}", f"i{at}{b}{opaque}{last}"]
    for d, ks in enumerate((k1, k2, k3), 1):
        for k in ks:
            f += [f"{d}{k}", f"{d}{k}{opaque}{size}", f"{d}{k}b{b}", f"{d}{k}b{b}a{a}", f"{d}{k}b{b}{opaque}"]
    whole = "+".join(k1)
    strong = "S" if k1 and k1[-1] in _STRONG_SET else "s" if any(k in _STRONG_SET for k in k1) else "-"
    f += [f"w1{whole}{opaque}{size}", f"w1{whole}b{b}", f"S{strong}{cls}b{b}", f"S{strong}b{b}a{a}{opaque}", f"S{strong}{opaque}{size}"]
    for x in structure:
        f += [f"{x}b{b}", f"{x}w1{whole}", f"{x}S{strong}b{b}", *(f"{x}1{k}" for k in k1)]
    f += [f"c{cls}b{b}a{a}", f"{opaque}b{b}", f"f{first}{opaque}{b}", f"f{first}{opaque}{lead}{b}", *(f"f{first}1{k}" for k in k1), *(f"12{x}{y}" for x in k1 for y in k2)]
    return [_code(x) for x in f]


_FLAG = re.compile(r"-[A-Za-z]|\\[nrt]|[a-z]+://")


@lru_cache(maxsize=100_000)
def _short_sign(tok: str) -> str:
    if tok.endswith("://"):
        return "://"
    if _FLAG.fullmatch(tok):
        return tok
    return "" if _ALNUM.search(tok) or len(tok) > 3 else tok


def sign(tok: str) -> str:
    """What a token without a letter or digit, a flag, an escape or a scheme counts as in contexts; nothing for words."""
    return _short_sign(tok) if len(tok) < 16 else ""


def tokens(toks: list[str], info) -> list[tuple]:
    """The context of every word among the tokens, None for signs; ``info`` gives (sign, names, strong) of a token."""
    known = [info(t) for t in toks]
    n = len(toks)
    first = (known[0][0] or known[0][1][-1:] or "") if known else ""
    first = first if isinstance(first, str) else first[0]
    out, quote, far = [], "", ""
    k1 = k2 = k3 = ()
    for i, (mark, names, strong) in enumerate(known):
        if mark:
            out.append(None)
            if mark in "\"'`":
                quote = "" if quote == mark else (quote or mark)
            elif mark == ";" or mark == ",":
                k1, k2, k3 = (), k1, k2
            continue
        b = (known[i - 1][0] or "w") if i else "^"
        a = (known[i + 1][0] or "w") if i + 1 < n else "$"
        lead = (known[i - 2][0] or "w") if i > 1 and b in "\"'`" else ""
        out.append((b, a, lead, quote != "", first, i if i < 6 else 6, i + 1 == n, k1, k2, k3, far))
        k1, k2, k3 = names, k1, k2
        far = strong or far
    return out


def token_info(tok: str) -> tuple[str, tuple[str, ...], str]:
    mark = sign(tok)
    names = () if mark else token_names(tok)
    return mark, names, next((x for x in reversed(names) if x in _STRONG_SET), "")


def features(line: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """All features of every token, as the training wants them."""
    toks = [line[a:b] for a, b in spans]
    out = []
    for tok, ctx in zip(toks, tokens(toks, token_info)):
        own = own_features(tok)
        if ctx is not None:
            cls, structure, _ = token_shape(tok)
            own = own + context_features(cls, structure, ctx)
        out.append(own)
    return out


#: Tokens up to this length are kept between lines, up to so many of them; others are computed anew. No result depends on either.
_KEPT, _MANY = 64, 200_000


class Crf:
    """Two-label linear chain over hashed features. ``w``: how much each feature speaks for a secret."""

    def __init__(self, w: np.ndarray, trans: np.ndarray) -> None:
        self.w, self.trans = w.astype("float64").tolist(), trans.tolist()
        (t00, t01), (t10, t11) = self.trans
        # a span of n tokens gains its scores + n * step + one of the ends (whole line, at its begin, at its end, inside)
        self.step = t11 - t00
        self.ends = max(t00 - t11, t10 - t11, t01 - t11, t01 + t10 - t00 - t11)
        self.tok: dict[str, tuple] = {}
        self.ctx: dict[tuple, float] = {}

    def __reduce__(self):
        return Crf, (np.array(self.w, "float32"), np.array(self.trans))

    def _token(self, tok: str) -> tuple:
        """(sign, names, strong, own score, class and structure) of a token."""
        hit = self.tok.get(tok)
        if hit is None:
            w = self.w
            info = token_info(tok)
            hit = (*info, sum(w[i] for i in own_features(tok)), None if info[0] else token_shape(tok)[:2])
            if len(tok) <= _KEPT:
                if len(self.tok) >= _MANY:
                    self.tok.clear()
                self.tok[tok] = hit
        return hit

    def scores(self, toks: list[str]) -> list[float]:
        get, seen, w = self._token, self.ctx, self.w
        known = [get(t) for t in toks]
        at = iter(known)
        out = []
        for k, ctx in zip(known, tokens(toks, lambda _: next(at)[:3])):
            s = k[3]
            if ctx is not None:
                key = (k[4], ctx)
                c = seen.get(key)
                if c is None:
                    if len(seen) >= _MANY:
                        seen.clear()
                    seen[key] = c = sum(w[i] for i in context_features(*k[4], ctx))
                s += c
            out.append(s)
        return out

    def label(self, line: str) -> list[tuple[int, int]]:
        """Character spans of the secrets of a line."""
        toks, spans = [], []
        for m in _LEX.finditer(line):
            toks.append(m.group())
            spans.append(m.span())
        if not toks:
            return []
        d = self.scores(toks)
        top = max(d) + self.step
        if top <= 0 and top + self.ends <= 0:
            return []
        (t00, t01), (t10, t11) = self.trans
        s0, s1 = 0.0, d[0]
        back = []
        for e in d[1:]:
            b0, b1 = s1 + t10 > s0 + t00, s1 + t11 > s0 + t01
            back.append((b0, b1))
            s0, s1 = (s1 + t10 if b0 else s0 + t00), (s1 + t11 if b1 else s0 + t01) + e
        y = s1 > s0
        ys = [y]
        for b in reversed(back):
            y = b[y]
            ys.append(y)
        ys.reverse()
        out: list[tuple[int, int]] = []
        for i, on in enumerate(ys):
            if on:
                if i and ys[i - 1] and out and spans[i][0] == out[-1][1]:
                    out[-1] = (out[-1][0], spans[i][1])
                else:
                    out.append(spans[i])
        return [(a, b) for a, b in out if _ALNUM.search(line, a, b) and line[a:b] != MASK]


def _overlaps(span: tuple[int, int], marks: list[tuple[int, int]]) -> bool:
    return any(span[0] < b and a < span[1] for a, b in marks)


@lru_cache(maxsize=2)
def train(n: int = EXAMPLES, seed: int = 7, epochs: int = 10, rate: float = 0.15, l2: float = 1e-6, without: str = "") -> Crf:
    """Fit the field by stochastic gradient ascent of the conditional log-likelihood (Adagrad, batches of equal length), weights averaged over the second half.

    Only the difference of the two labels' weights matters, so one weight per feature is fitted.
    """
    data = []
    for line, marks in examples(n, seed, without):
        if spans := lex(line):
            fs = [np.array(f, np.int32) for f in features(line, spans)]
            data.append((fs, [_overlaps(x, marks) for x in spans]))
    data.sort(key=lambda x: len(x[1]))
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-3)
    trans, t2 = np.zeros((2, 2)), np.full((2, 2), 1e-3)
    packed = []
    for i in range(0, len(data), 64):
        b = data[i : i + 64]
        size = max(len(y) for _, y in b)
        width = max(len(f) for fs, _ in b for f in fs)
        x = np.full((len(b), size, width), DIMS - 1, np.int32)
        y = np.zeros((len(b), size), np.int8)
        mask = np.zeros((len(b), size), bool)
        for r, (fs, ys) in enumerate(b):
            for c, f in enumerate(fs):
                x[r, c, : len(f)] = f
            y[r, : len(ys)] = ys
            mask[r, : len(ys)] = True
        packed.append((x, y, mask))
        data[i : i + 64] = [None] * len(b)
    mean, mean_t = np.zeros(DIMS), np.zeros((2, 2))
    for epoch in range(epochs):
        for k in rng.permutation(len(packed)):
            x, y, mask = packed[k]
            n_, t_ = y.shape
            emit = np.stack([np.zeros((n_, t_)), w[x].sum(axis=2)], axis=2)
            alpha = np.zeros((n_, t_, 2))
            beta = np.zeros((n_, t_, 2))
            alpha[:, 0] = emit[:, 0]
            for t in range(1, t_):
                new = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + emit[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            for t in range(t_ - 2, -1, -1):
                nxt = emit[:, t + 1] + beta[:, t + 1]
                new = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            node = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None])
            grad = np.where(mask, y - node, 0)
            gold = np.eye(2)[y]
            gt = np.zeros((2, 2))
            for t in range(1, t_):
                m = mask[:, t]
                pair = np.exp(alpha[:, t - 1, :, None] + trans + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                gt += (gold[:, t - 1, :, None] * gold[:, t, None, :] - pair)[m].sum(axis=0)
            flat = np.bincount(x.reshape(-1), np.repeat(grad.reshape(-1), x.shape[2]), DIMS)
            flat[-1] = 0
            uniq = np.flatnonzero(flat)
            step = flat[uniq] - l2 * w[uniq]
            g2[uniq] += step**2
            w[uniq] += rate * step / np.sqrt(g2[uniq])
            t2 += gt**2
            trans += rate * gt / np.sqrt(t2)
            if epoch >= epochs // 2:
                mean += w
                mean_t += trans
    n_mean = len(packed) * (epochs - epochs // 2)
    return Crf((mean / n_mean).astype("float32"), mean_t / n_mean)


def redact_text(line: str, spans: list[tuple[int, int]], mask: str = MASK) -> str:
    """The line with the characters of the spans replaced; everything else is unchanged."""
    out, at = [], 0
    for a, b in spans:
        out += [line[at:a], mask]
        at = b
    return "".join(out) + line[at:]


def line_secrets(rec: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Rows of ``rec`` (source_table, row_id, text) whose own line holds a secret: + redacted, secrets (how many)."""
    shared = rec.sparkSession.sparkContext.broadcast(crf or train())
    src = rec.select("source_table", "row_id", "text").filter("text <> ''")
    schema = "source_table string, row_id bigint, text string, redacted string, secrets int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            keep, red, num = [], [], []
            for i, value in enumerate(batch.column(2)):
                line = value.as_py()
                if spans := crf.label(line):
                    keep.append(i)
                    red.append(redact_text(line, spans))
                    num.append(len(spans))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(red, pa.string()), pa.array(num, pa.int32())], names=["source_table", "row_id", "text", "redacted", "secrets"])

    return src.mapInArrow(run, schema)


def key_ranges(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """file, lo, hi, opened, closed, mark_lines: the lines between markers that private key material may fill.

    ``lines``: file, line, text. A range lies strictly between two neighbouring markers of a file, the one before
    it being a BEGIN (``opened``) or the one after it an END (``closed``) of a private key; at the ends of a file it is unbounded.
    """
    t = F.col("text")
    marks = lines.filter(t.contains("-----")).filter(t.rlike(ANY_MARK) & F.col("file").isNotNull() & F.col("line").isNotNull())
    kind = F.when(t.rlike(BEGIN_LINE), 1).when(t.rlike(END_LINE), 2).otherwise(0)
    marks = marks.groupBy("file", "line").agg(F.max(kind).alias("kind")).withColumn("blk", F.floor(F.col("line") / block))
    marks = checkpoint(marks)  # some lines in a thousand
    m = F.struct("line", "kind")
    edge = marks.groupBy("file", "blk").agg(F.min(m).alias("head"), F.max(m).alias("tail"))
    over = W.partitionBy("file").orderBy("blk")  # one row per block of lines that holds a marker
    edge = edge.select("file", "blk", F.lag("tail").over(over).alias("prev_m"), F.lead("head").over(over).alias("next_m"))
    inner = W.partitionBy("file", "blk").orderBy("line")
    marks = marks.withColumn("before", F.lag(m).over(inner)).withColumn("after", F.lead(m).over(inner)).join(edge, ["file", "blk"])
    before, after = F.coalesce("before", "prev_m"), F.coalesce("after", "next_m")
    far = 2**31 - 1
    ahead = marks.filter("kind = 1").select("file", (F.col("line") + 1).alias("lo"), (F.coalesce(after["line"], F.lit(far)) - 1).alias("hi"), F.lit(True).alias("opened"), F.coalesce(after["kind"] == 2, F.lit(False)).alias("closed"))
    behind = marks.filter("kind = 2").filter(before.isNull() | (before["kind"] != 1))
    behind = behind.select("file", (F.coalesce(before["line"], F.lit(-far)) + 1).alias("lo"), (F.col("line") - 1).alias("hi"), F.lit(False).alias("opened"), F.lit(True).alias("closed"))
    return ahead.unionByName(behind).filter("lo <= hi")


def key_blocks(lines: DataFrame, id_col: str, file_col: str, line_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """row_id, text of every line that belongs to a private key block."""
    t = F.col("text")
    src = lines.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(file_col).alias("file"), F.col(line_col).alias("line"), F.col(text_col).alias("text"))
    own = src.filter(t.contains("-----")).filter(t.rlike(BEGIN_LINE) | t.rlike(END_LINE)).select("row_id", "text")
    ranges = key_ranges(src, block).withColumn("range", F.monotonically_increasing_id())
    ranges = checkpoint(ranges)  # read three times below
    # Ranges of a file do not overlap, so their pieces by block are at most its blocks and its ranges.
    extent = ranges.groupBy("file").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    small = ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    few = src.filter("file is not null and line is not null and text is not null")
    few = few.join((F.broadcast if small else lambda d: d)(extent.select("file")), "file", "left_semi").withColumn("blk", F.floor(F.col("line") / block))
    last = few.groupBy("file").agg(F.min("blk").alias("b0"), F.max("blk").alias("b1"))
    cut = ranges.join(last, "file").select("file", "lo", "hi", "opened", "closed", "range", F.greatest(F.floor(F.col("lo") / block), "b0").alias("x0"), F.least(F.floor(F.col("hi") / block), "b1").alias("x1"))
    cut = cut.filter("x0 <= x1").withColumn("blk", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")
    cut = F.broadcast(cut) if small else cut
    inside = few.join(cut, ["file", "blk"]).filter("line between lo and hi")
    sure = t.rlike(BODY_SURE) | t.rlike(KEY_HEADER)
    inside = checkpoint(inside.select("row_id", "line", "text", "range", "opened", "closed", sure.alias("sure"), (t.rlike(BODY) | t.rlike(KEY_HEADER)).alias("like")))
    # the first line that breaks the run after BEGIN and the last one before END
    breaks = inside.groupBy("range").agg(F.min(F.when(~F.col("sure"), F.col("line"))).alias("first"), F.max(F.when(~F.col("sure"), F.col("line"))).alias("last"), F.avg(F.col("like").cast("int")).alias("share"))
    found = inside.join(breaks, "range").filter(
        (F.col("opened") & F.col("closed") & (F.col("share") >= 0.5))
        | (F.col("opened") & (F.col("first").isNull() | (F.col("line") < F.col("first"))))
        | (F.col("closed") & (F.col("last").isNull() | (F.col("line") > F.col("last"))))
    )
    return own.unionByName(found.select("row_id", "text"))


def context_blocks(matches: DataFrame, id_col: str, text_col: str, before_col: str, after_col: str) -> DataFrame:
    """row_id, text of matched lines that belong to a private key block, judged by their context arrays.

    Between BEGIN and END any line counts; with one of them in sight, a key line whose neighbours up to the marker are key lines.
    """
    t = F.col("text")
    none = F.array().cast("array<string>")
    src = matches.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"), F.coalesce(before_col, none).alias("before"), F.coalesce(after_col, none).alias("after"))
    src = src.filter("text is not null")

    def marks(c: str) -> Column:
        return F.filter(c, lambda x: x.contains("-----") & x.rlike(ANY_MARK))

    def key_line(x: Column) -> Column:
        return x.rlike(BODY_SURE) | x.rlike(KEY_HEADER)

    # lines between the marker and the matched line
    since = F.slice("before", F.greatest(F.size("before") - F.array_position(F.reverse("before"), F.try_element_at(marks("before"), F.lit(-1))).cast("int") + 2, F.lit(1)), F.size("before") + 1)
    until = F.slice("after", F.lit(1), F.greatest(F.array_position("after", F.try_element_at(marks("after"), F.lit(1))).cast("int") - 1, F.lit(0)))
    opened = F.coalesce(F.try_element_at(marks("before"), F.lit(-1)).rlike(BEGIN_LINE), F.lit(False))
    closed = F.coalesce(F.try_element_at(marks("after"), F.lit(1)).rlike(END_LINE), F.lit(False))
    body = (opened & closed) | (opened & (key_line(t) | t.rlike(BODY) & (t != "")) & F.forall(since, key_line)) | (closed & key_line(t) & F.forall(until, lambda x: key_line(x) | x.rlike(BODY)))
    marked = t.contains("-----") & (t.rlike(BEGIN_LINE) | t.rlike(END_LINE))
    return src.filter(marked | (~(t.contains("-----") & t.rlike(ANY_MARK)) & body)).select("row_id", "text")


def redact_block(text: Column) -> Column:
    """A line of a private key block without its key characters; markers and headers are unchanged."""
    marked = text.contains("-----") | text.rlike(KEY_HEADER)
    return F.when(marked, text).otherwise(F.regexp_replace(text, r"(?<![\\A-Za-z0-9+/])(?=\+*/*[A-Za-z0-9])[A-Za-z0-9+/]+={0,2}", MASK))


def find(line_items: DataFrame, match_locations: DataFrame, crf: Crf | None = None) -> DataFrame:
    """source_table, row_id, text, redacted of every row that holds a literal secret."""
    items = line_items.select(F.lit("line_items").alias("source_table"), F.col("line_id").cast("bigint").alias("row_id"), F.col("content").alias("text"))
    hits = match_locations.select(F.lit("match_locations").alias("source_table"), F.col("match_id").cast("bigint").alias("row_id"), F.col("line_text").alias("text"))
    own = line_secrets(items.unionByName(hits), crf).select("source_table", "row_id", "text", "redacted")
    blocks = key_blocks(line_items, "line_id", "file_path", "line_number", "content").select(F.lit("line_items").alias("source_table"), "row_id", "text")
    near = context_blocks(match_locations, "match_id", "line_text", "before_context", "after_context").select(F.lit("match_locations").alias("source_table"), "row_id", "text")
    block = blocks.unionByName(near).withColumn("redacted", redact_block(F.col("text")))
    # only found rows meet here: those in a key block may also hold a secret of their own
    best = F.min_by(F.struct("text", "redacted"), F.struct(F.length("redacted"), "redacted")).alias("b")
    return own.unionByName(block).groupBy("source_table", "row_id").agg(best).select("source_table", "row_id", "b.text", "b.redacted")
