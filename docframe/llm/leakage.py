"""Find passages of evaluation items in a corpus, report what leaked, and take it out.

The items' normalised word n-grams form a hash set that every Python worker gets once; its size is
checked (``MAX_GRAMS``) before anything is collected, beyond it items and documents are joined by n-gram hash. Documents are cut
into normalised words; windows whose n words all belong to items and whose hash is in the set are
seeds. Each seed is verified by aligning document and item in both directions, letting single words
be altered (replaced by one or two words, dropped, or inserted). A passage counts from ``min_words`` consecutive words
of the item on, with at most one altered word in ``per_altered``.

Any ``min_words`` = 18 words with at most 2 alterations hold 6 unaltered ones in a row, so n = 5 finds all.

Normal form of a word: letters and digits, NFKC, lower case, without markup (tags, emphasis,
entities, JSON escapes), soft hyphens and line-end hyphenation.

Every passage of an item is reported, also several of one document; one that lies within another of the same item is not.

Defined cases: null and empty texts leak nothing. Repeated items are each reported. Items shorter than ``min_words`` words cannot be found. Empty tables
give empty results.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from docframe.session import checkpoint

GRAM = 5
MIN_WORDS = 18
PER_ALTERED = 7
#: N-grams a worker holds at once, about 100 MB.
MAX_GRAMS = 400_000
#: Bits and partial maps of the filter for larger item sets.
BITS, MAPS = 1 << 25, 8

# markup that is no word, or a word with the ways a layout may break it
_TOKEN = re.compile(
    r"<[/!a-zA-Z][^<>\n]{0,80}>|\\u[0-9a-fA-F]{4}|\\[nrt\"\\/]|&#?\w{1,8};"
    "|([^\\W_]+(?:(?:[-‐]\\r?\\n[ \\t>|*#]*|\\\\-|[­​-‍⁠﻿]+(?:\\r?\\n[ \\t]*)?)[^\\W_]+)*)"
)
_JOINT = re.compile("[^\\w]+|_")


def _plain(word: str) -> str:
    if not word.isalnum():
        word = _JOINT.sub("", word)
    return word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).lower()


def words(text: str) -> list[str]:
    """Normalised words of a text."""
    if text.isascii():
        return [w if w.isalnum() else _JOINT.sub("", w) for w in filter(None, _TOKEN.findall(text.lower()))]
    return [_plain(w) for w in _TOKEN.findall(text) if w]


def spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the words of ``words``."""
    return [m.span(1) for m in _TOKEN.finditer(text) if m.group(1)]


def _extend(doc: list[str], item: list[str], p: int, k: int, step: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """Aligned runs (doc start, item start, length) from a matching position on, in the direction of ``step``."""
    runs, n = [], 0
    nd, ni = len(doc), len(item)
    moves = ((1, 1), (2, 1), (0, 1), (1, 0), (3, 1), (1, 2), (2, 2))

    def at(i: int, j: int) -> bool:
        return 0 <= i < nd and 0 <= j < ni and doc[i] == item[j]

    while True:
        while at(p + step * n, k + step * n):
            n += 1
        runs.append((p, k, n))
        p, k, n = p + step * n, k + step * n, 0
        # beyond an altered word two words must match again, or one that ends the item
        for dp, dk in moves[:6]:
            a, b = p + step * dp, k + step * dk
            if at(a, b) and (at(a + step, b + step) or not 0 <= b + step < ni):
                p, k = a, b
                break
        else:
            return runs, p, k


def passages(doc: list[str], item: list[str], p: int, k: int, min_words: int = MIN_WORDS, per_altered: int = PER_ALTERED) -> list[tuple[int, int, int, int]]:
    """Admissible passages along the alignment through a seed, the longest first and then what is left beside it: (words of the item, altered, first and last word in the document)."""
    right, _, _ = _extend(doc, item, p, k, 1)
    left, _, _ = _extend(doc, item, p - 1, k - 1, -1)
    # runs as (item first, item last, doc first, doc last), in order; the seed's run joins both sides
    line = [(b - n + 1, b, a - n + 1, a) for a, b, n in reversed(left) if n] + [(b, b + n - 1, a, a + n - 1) for a, b, n in right if n]
    runs: list[tuple[int, int, int, int]] = []
    for r in line:
        if runs and r[0] == runs[-1][1] + 1 and r[2] == runs[-1][3] + 1:
            runs[-1] = (runs[-1][0], r[1], runs[-1][2], r[3])
        else:
            runs.append(r)
    out, todo = [], [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        best = None
        for i in range(lo, hi):
            for j in range(i, hi):
                size, altered = runs[j][1] - runs[i][0] + 1, j - i
                if size >= min_words and altered * per_altered <= size and (best is None or size > best[0]):
                    best = (size, altered, runs[i][2], runs[j][3], i, j)
        if best:
            out.append(best[:4])
            todo += [(lo, best[4]), (best[5] + 1, hi)]
    return out


_HASHES: dict[str, int] = {}


def _word_hash(word: str) -> int:
    """A hash of a word that is the same in every worker."""
    hit = _HASHES.get(word)
    if hit is None:
        if len(_HASHES) >= 500_000:
            _HASHES.clear()
        _HASHES[word] = hit = xxhash.xxh64_intdigest(word)
    return hit


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the windows of ``gram`` word codes."""
    n = len(codes) - gram + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for g in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[g : g + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return h.view(np.int64)


def text_grams(text: str | None, gram: int = GRAM) -> np.ndarray:
    """Distinct n-gram hashes of a text."""
    ws = words(text or "")
    return np.unique(gram_hashes(np.fromiter(map(_word_hash, ws), np.uint64, len(ws)), gram))


class Finder:
    """Seeds and verification for a set of items; made once in every worker."""

    def __init__(self, items: list[tuple[int, str]], gram: int = GRAM, min_words: int = MIN_WORDS, per_altered: int = PER_ALTERED) -> None:
        self.items = [(i, words(t)) for i, t in items if t]
        self.gram, self.min_words, self.per_altered = gram, min_words, per_altered
        self.ids: dict[str, int] = {}
        for _, ws in self.items:
            for w in ws:
                self.ids.setdefault(w, len(self.ids) + 1)
        where: dict[int, list[tuple[int, int]]] = {}
        for n, (_, ws) in enumerate(self.items):
            codes = np.array([self.ids[w] for w in ws], np.int64)
            for k, h in enumerate(self._hashes(codes)):
                where.setdefault(int(h), []).append((n, k))
        self.where = where
        self.grams = np.array(sorted(where), np.int64)

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        return gram_hashes(codes.astype(np.uint64), self.gram)

    def seeds(self, ws: list[str]) -> list[int]:
        get = self.ids.get
        codes = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        n = len(codes) - self.gram + 1
        if n <= 0 or not len(self.grams):
            return []
        known = np.concatenate(([0], np.cumsum(codes > 0)))
        full = np.flatnonzero(known[self.gram :] - known[:-self.gram] == self.gram)
        if not len(full):
            return []
        h = self._hashes(codes)[full]
        at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        return full[self.grams[at] == h].tolist()

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, words, altered, first and last word in the document) of every passage of an item in a text."""
        if not text:
            return []
        ws = words(text)
        found: dict[int, list[tuple]] = {}
        done: dict[int, list[tuple[int, int, int]]] = {}
        for p in self.seeds(ws):
            code = int(self._hashes(np.fromiter((self.ids[w] for w in ws[p : p + self.gram]), np.int64, self.gram))[0])
            for n, k in self.where[code]:
                if any(h[2] <= p <= h[3] for h in found.get(n, ())) or any(a <= p <= b and (k - p) == d for a, b, d in done.get(n, ())):
                    continue
                item = self.items[n][1]
                if ws[p : p + self.gram] != item[k : k + self.gram]:
                    continue
                run = p + self.gram - 1
                while run + 1 < len(ws) and k + run + 1 - p < len(item) and ws[run + 1] == item[k + run + 1 - p]:
                    run += 1
                done.setdefault(n, []).append((p, run, k - p))
                mine = found.setdefault(n, [])
                for hit in passages(ws, item, p, k, self.min_words, self.per_altered):
                    if not any(h[2] <= hit[2] and hit[3] <= h[3] for h in mine):
                        mine[:] = [h for h in mine if not (hit[2] <= h[2] and h[3] <= hit[3])] + [hit]
        return [(self.items[n][0], *hit) for n, hits in sorted(found.items()) for hit in sorted(hits, key=lambda h: (h[2], h[3]))]


_LAST: dict[str, Finder] = {}


def _finder(token: str, items: list[tuple[int, str]], *options: int) -> Finder:
    """The finder of a scan; a reused Python worker keeps the one it made last."""
    if token not in _LAST:
        _LAST.clear()
        _LAST[token] = Finder(items, *options)
    return _LAST[token]


LEAK = T.StructType([T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("passage", T.IntegerType()), ("words", T.IntegerType()), ("altered", T.IntegerType()), ("span_start", T.IntegerType()), ("span_end", T.IntegerType()))])


def _rows(key, text: str, hits: list[tuple]) -> list[tuple]:
    """Result rows of a document: passages numbered within an item, spans in characters."""
    if not hits:
        return []
    sp, out, last = spans(text), [], None
    for i, n, alt, a, b in hits:
        at = 1 if i != last else at + 1
        last = i
        out.append((key, i, at, n, alt, sp[a][0], sp[b][1]))
    return out


def _batch(rows: list[tuple], key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    types = [key_type, pa.int64(), *[pa.int32()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _find_shared(src: DataFrame, items: list[tuple[int, str]], schema: T.StructType, options: tuple[int, int, int]) -> DataFrame:
    """One pass over the documents with the items' n-grams in every worker."""
    shared = src.sparkSession.sparkContext.broadcast(items)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(token, shared.value, *options)
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch.column(0), batch.column(1)):
                text = value.as_py()
                rows += _rows(key.as_py(), text, finder.leaks(text))
            yield _batch(rows, batch.schema.field(0).type, schema.names)

    return src.mapInArrow(run, schema)


def _find_joined(src: DataFrame, items: DataFrame, schema: T.StructType, options: tuple[int, int, int]) -> DataFrame:
    """The same for item sets beyond a worker's memory: n-grams joined by hash, candidates verified pair by pair.

    A bit map of the items' hashes (``BITS`` bits whatever the size of the set, merged from ``MAPS`` partial ones) spares the join most windows of the corpus.
    """
    gram = options[0]
    key = src.schema[0]

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_grams(x.as_py(), gram) for x in batch.column(1)]
            ids = np.repeat(np.arange(len(got)), [len(g) for g in got])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(np.concatenate(got) if got else np.empty(0, np.int64), pa.int64())], names=[batch.schema.names[0], "gram"])

    item_grams = checkpoint(items.mapInArrow(grams_of, "item_id bigint, gram bigint"))

    def bit_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    merged = np.zeros(BITS // 8, np.uint8)
    for row in item_grams.select("gram").repartition(MAPS).mapInArrow(bit_map, "bits binary").toLocalIterator():  # MAPS rows of BITS bits
        merged |= np.frombuffer(row["bits"], np.uint8)
    shared = src.sparkSession.sparkContext.broadcast(merged)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in grams_of(batches):
            keep = bits[batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(BITS)]
            yield batch.filter(pa.array(keep))

    hits = src.mapInArrow(windows, T.StructType([key, T.StructField("gram", T.LongType())]))
    pairs = hits.join(item_grams, "gram").select(key.name, "item_id").distinct()
    both = pairs.join(src, key.name).join(items.withColumnRenamed(items.columns[1], "_item"), "item_id").select(key.name, "_text", "item_id", "_item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, text, i, item in zip(*(batch.column(c).to_pylist() for c in range(4))):
                rows += _rows(k, text, Finder([(i, item)], *options).leaks(text))
            yield _batch(rows, batch.schema.field(0).type, schema.names)

    return both.mapInArrow(verify, schema)


def find(documents: DataFrame, eval_items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", gram: int = GRAM, min_words: int = MIN_WORDS, per_altered: int = PER_ALTERED, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per passage: id_col, item_id, passage (1, 2, ... within document and item), words, altered, span_start, span_end (characters)."""
    src = documents.select(F.col(id_col), F.col(text_col).alias("_text"))
    items = eval_items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("_item_text"))
    schema = T.StructType([src.schema[0], *LEAK.fields])
    # a word takes two characters at least
    size = items.agg(F.sum(F.length("_item_text") / 2 + 1)).first()[0] or 0
    if size <= max_grams:
        return _find_shared(src, [tuple(r) for r in items.collect()], schema, (gram, min_words, per_altered))  # bounded by max_grams
    return _find_joined(src, items, schema, (gram, min_words, per_altered))


def strip(documents: DataFrame, eval_items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` without the leaked passages; a document that leaks nothing keeps its text."""
    leaks = find(documents, eval_items, id_col, text_col, **options)
    cuts = leaks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("_cuts"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, c):
        kept = F.when(c["span_start"] > acc["at"], F.substring(F.col(text_col), acc["at"] + 1, c["span_start"] - acc["at"])).otherwise("")
        return F.struct(F.concat(acc["out"], kept).alias("out"), F.greatest(acc["at"], c["span_end"]).alias("at"))

    body = F.aggregate("_cuts", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return documents.join(cuts, id_col, "left").withColumn(text_col, F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(body)).drop("_cuts")
