"""Split texts over a token limit at natural boundaries, with overlap, by pointer doubling.

Every possible cut of a text gets its farthest legal successor: the end of the longest piece within
the limit, at the most natural kind of boundary that still gives a piece of at least half the limit
(paragraph, line, sentence, word; inside a word only where nothing else is left), and from there the
start of the next piece, which reaches back by the overlap. The successor tables of all texts of an Arrow batch are one array; squaring it
(``next = next[next]``) and following it from the marked cuts doubles the known cuts each time, so all greedy
cuts of the batch come out after log2(longest chain) vectorised steps. A text is one row, so the join of
boundaries with successors is a binary search over the running size inside its task, not a shuffle.

Size is the estimate floor((characters / 4 + words * 1.3) / 2). Pieces are verbatim stretches; without overlap they
concatenate to the text. The overlap is the longest stretch of whole words before the cut whose size
is within ``overlap_tokens``, and is shortened where a piece would not advance.

Defined cases: null and empty texts have size 0 and are never oversized. max_tokens null or below 1 means 512,
overlap_tokens null or negative 0, and at most a quarter of max_tokens where it is not smaller. A chunk without a result
row takes the defaults. Where start_line is null the pieces' lines are counted from end_line, or are null
when both are missing. Repeated rows are each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

DEFAULT_MAX = 512
# White space as Unicode's property has it.
_SPACE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: Runs without white space as Unicode defines it (U+001C to U+001F are none), the same in Python and the JVM.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？]")


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def size_of(text: Column) -> Column:
    """The project's token estimate of a text."""
    return F.floor((F.length(text) / F.lit(4.0) + words_of(text) * F.lit(1.3)) / F.lit(2.0)).cast("bigint")


def limits(chunks: DataFrame, chunk_results: DataFrame) -> DataFrame:
    """``chunks`` with the effective ``_max`` and ``_overlap`` of their result."""
    res = chunk_results.filter("result_id is not null").groupBy("result_id").agg(F.max_by(F.struct("max_tokens", "overlap_tokens"), F.struct("run_at", "max_tokens", "overlap_tokens")).alias("_r"))
    out = chunks.select("chunk_id", "result_id", "text", "start_line", "end_line").join(res, "result_id", "left")
    most = F.when(F.col("_r.max_tokens") > 0, F.col("_r.max_tokens")).otherwise(DEFAULT_MAX)
    lap = F.greatest(F.coalesce("_r.overlap_tokens", F.lit(0)), F.lit(0))
    return out.withColumn("_max", most.cast("int")).withColumn("_overlap", F.when(lap >= most, F.floor(most / 4)).otherwise(lap).cast("int")).drop("_r")


def oversized(chunks: DataFrame, chunk_results: DataFrame) -> DataFrame:
    return limits(chunks.filter("text is not null and text <> ''"), chunk_results).filter(size_of(F.col("text")) > F.col("_max"))


class Cuts:
    """Boundaries and running size of one text. Sizes are 40ths of a token, whole numbers."""

    def __init__(self, text: str, most: int, lap: int) -> None:
        self.text = text
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        space = np.isin(code, _SPACE)
        begins = ~space & np.concatenate(([True], space[:-1]))
        self.word = np.concatenate(([0], np.cumsum(begins)))  # word beginnings before a position
        self.inside = np.zeros(n + 1, bool)  # a cut here goes through a word
        self.inside[1:n] = ~space[1:] & ~space[:-1]
        pos = np.arange(n + 1)
        self.f = 5 * pos + 26 * self.word
        lf = np.flatnonzero(code == 10) + 1
        blank = lf[1:][np.add.reduceat(~space, lf[:-1])[: len(lf) - 1] == 0] if len(lf) > 1 else lf[:0]
        end = np.array([m.end() for m in _SENTENCE.finditer(text)], np.int64)
        word_end = np.flatnonzero(begins)
        self.kinds = [np.unique(np.concatenate((x, [n]))) for x in (blank, lf, self._skip_space(end, space), word_end)]
        self.n, self.most, self.lap = n, most, lap
        # a cut lands on a boundary, or on any position where a piece had to be cut inside a word
        starts = np.unique(np.concatenate(([0], *self.kinds)))
        self.starts = starts if self._fits(starts) else pos
        self.to, self.end = self._successors(self.starts)

    @staticmethod
    def _skip_space(end: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Boundaries moved behind the white space that follows them."""
        if not len(end):
            return end
        solid = np.flatnonzero(~space)
        at = np.searchsorted(solid, end)
        return np.where(at < len(solid), solid[np.minimum(at, len(solid) - 1)], len(space))

    def _fits(self, starts: np.ndarray) -> bool:
        """Is every stretch between two boundaries within the limit?"""
        return bool((self._size(starts[:-1], starts[1:]) <= 40 * self.most + 39).all()) and self.most > 0

    def _size(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.f[b] - self.f[a] + 26 * self.inside[a]

    def _successors(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of the next piece, end of this piece) for every start."""
        room = self.f[s] - 26 * self.inside[s]
        far = np.searchsorted(self.f, room + 40 * (self.most + 1), "left") - 1  # farthest legal end
        far = np.minimum(np.maximum(far, s + 1), self.n)
        least = np.searchsorted(self.f, room + 20 * self.most, "left")
        end = np.zeros(len(s), np.int64)
        for kind in self.kinds:
            at = np.searchsorted(kind, far, "right") - 1
            hit = np.where(at >= 0, kind[np.maximum(at, 0)], -1)
            end = np.where((end == 0) & (hit > s) & ((hit >= least) | (kind is self.kinds[-1])), hit, end)
        end = np.where(far >= self.n, self.n, np.where(end == 0, far, end))
        nxt = end.copy()
        if self.lap > 0:
            kind = self.kinds[-1]
            back = np.searchsorted(self.f, self.f[end] - 40 * (self.lap + 1), "right")  # earliest start within the overlap
            at = np.searchsorted(kind, np.maximum(back, s + 1), "left")
            cand = kind[np.minimum(at, len(kind) - 1)]
            nxt = np.where((cand < end) & (cand > s), cand, end)
        return np.where(end >= self.n, self.n, nxt), end


def double(nxt: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions reachable from ``first`` over the successor table, by squaring it until nothing is new."""
    seen = np.zeros(len(nxt), bool)
    seen[first] = True
    hop, known = nxt, int(seen.sum())
    while True:
        seen[hop[np.flatnonzero(seen)]] = True
        hop = hop[hop]
        if (now := int(seen.sum())) == known:
            return np.flatnonzero(seen)
        known = now


def split_texts(texts: list[str], most: list[int], laps: list[int]) -> list[list[tuple[int, int]]]:
    """Character spans of the pieces of every text; one successor table for all of them."""
    tables = [Cuts(t, m, o) for t, m, o in zip(texts, most, laps)]
    at, base = 0, []
    rows, ends = [], []
    for c in tables:
        base.append(at)
        own = np.searchsorted(c.starts, c.to)
        off = c.to != c.starts[np.minimum(own, len(c.starts) - 1)]
        if off.any():  # a successor that is no boundary: let every position be a start
            c.starts = np.arange(c.n + 1)
            c.to, c.end = c._successors(c.starts)
            own = c.to
        rows.append(own + at)
        ends.append(c.end)
        at += len(c.starts)
    if not tables:
        return []
    hit = double(np.concatenate(rows), np.array(base))
    out = []
    for c, b in zip(tables, base):
        mine = hit[np.searchsorted(hit, b) : np.searchsorted(hit, b + len(c.starts))] - b
        out.append([(int(c.starts[i]), int(c.end[i])) for i in mine if c.starts[i] < c.n])
    return out


def _cut_all(pdf: pd.DataFrame, characters: int = 500_000) -> Iterator[tuple]:
    """Rows with their text and cuts, worked off in groups of about ``characters`` to bound memory."""
    size = pdf["text"].str.len().to_numpy()
    group = (np.cumsum(size) // characters) if len(size) else size
    for g in np.unique(group):
        part = pdf[group == g]
        texts = part["text"].tolist()
        yield from zip(part.itertuples(index=False), texts, split_texts(texts, part["_max"].tolist(), part["_overlap"].tolist()))


PIECE = [("piece_index", T.IntegerType()), ("text", T.StringType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType()), ("characters", T.IntegerType()), ("tokens", T.IntegerType()), ("overlap_characters", T.IntegerType())]


def pieces(chunks: DataFrame, chunk_results: DataFrame) -> DataFrame:
    """The pieces of every oversized chunk: chunk_id, result_id, piece_index (from 0), text, start_line, end_line, characters, tokens, overlap_characters."""
    src = oversized(chunks, chunk_results).select("chunk_id", "result_id", "text", "start_line", "end_line", "_max", "_overlap")
    schema = T.StructType([src.schema["chunk_id"], src.schema["result_id"], *[T.StructField(n, t) for n, t in PIECE]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, text, cut in _cut_all(pdf):
                first = r.start_line
                if pd.isna(first) and not pd.isna(r.end_line):
                    first = r.end_line - text[:-1].count("\n")
                at, line, before = 0, 0, 0
                for k, (a, b) in enumerate(cut):
                    line += text.count("\n", at, a) if a >= at else -text.count("\n", a, at)
                    at = a
                    part = text[a:b]
                    down = part[:-1].count("\n")
                    words = len(_WORD.findall(part))
                    lines = (None, None) if pd.isna(first) else (int(first) + line, int(first) + line + down)
                    rows.append((r[0], r[1], k, part, *lines, len(part), int((len(part) / 4 + words * 1.3) / 2), before - a if k else 0))
                    before = b
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return src.mapInPandas(run, schema)
