"""Greedy chunking of texts into pieces of at most so many estimated tokens.

A unit (line or sentence) is refused only by a chunk that holds something already, so one large unit is never
cut. Leading empty units leave no trace in a chunk's text but set its start. The overlap goes back over
whole units and leaves out the one that would reach the asked size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from docframe.functions import text as X

_CHUNK = "array<struct<index:int,text:string,start_line:int,end_line:int,characters:int,tokens:int>>"


def limits(max_tokens: int, overlap: int) -> tuple[int, int]:
    most = max_tokens if max_tokens > 0 else 512
    lap = max(overlap, 0)
    return most, most // 4 if lap >= most else lap


def _folded(df: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """Lines without overlap: one ``aggregate`` over the line array, inside the JVM.

    The fold only marks where a chunk begins; a chunk's text is cut out once it is known, so no array is copied per line.
    """
    src = df.filter(F.col(text_col).isNotNull()).select(id_col, X.split_lines(F.col(text_col)).alias("_l"))
    src = src.withColumn("_n", F.transform("_l", X.tokens))
    start = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("sum"))

    def step(a, t):
        cut = (a["sum"] > 0) & (a["sum"] + t > most)
        return F.struct(F.when(cut, F.array_append(a["starts"], a["i"] + 1)).otherwise(a["starts"]).alias("starts"), (a["i"] + 1).alias("i"), F.when(cut, t).otherwise(a["sum"] + t).alias("sum"))

    src = src.select(id_col, "_l", F.aggregate("_n", start, step, lambda a: a["starts"]).alias("_s"))
    src = src.select(id_col, "_l", "_s", F.posexplode("_s").alias("_k", "start_line"))
    end = F.coalesce(F.try_element_at("_s", F.col("_k") + 2) - 1, F.size("_l"))
    src = src.select(id_col, F.col("_k").alias("index"), "start_line", end.alias("end_line"), F.slice("_l", F.col("start_line"), end - F.col("start_line") + 1).alias("_u"))
    # an empty buffer takes no separator: leading empty units vanish
    body = F.regexp_replace(F.array_join("_u", "\n"), "^\n+", "")
    return src.select(id_col, "index", body.alias("text"), "start_line", "end_line")


def cut(units: list[tuple[str, int]], sizes: list[int], most: int, lap: int) -> list[tuple[int, int]]:
    """Unit ranges [first, last] of the chunks."""
    out, i, n = [], 0, len(units)
    while i < n:
        total, j = 0, i
        while j < n and not (total > 0 and total + sizes[j] > most):
            total += sizes[j]
            j += 1
        out.append((i, j - 1))
        if j >= n:
            break
        nxt = j
        if lap:
            back, k = 0, j - 1
            while k > i:
                back += sizes[k]
                if back >= lap:
                    break
                k -= 1
            nxt = max(k + 1, i + 1)
        i = nxt
    return out


_SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_WORDS = re.compile(f"[^{_SPACES}]+")
_SENTENCE_END = re.compile(f"(?<=[.!?])(?=[{_SPACES}])")


def estimate(text: str) -> int:
    if not text:
        return 0
    return max(1, int((len(text) / 4.0 + len(_WORDS.findall(text)) * 1.3) / 2.0))


def split_sentences(line: str) -> list[str]:
    return [s for s in (p.strip(_SPACES) for p in _SENTENCE_END.split(line)) if s]


def chunk_text(text: str, max_tokens: int = 512, overlap: int = 0, by_sentence: bool = False) -> list[tuple[str, int, int]]:
    """(text, start_line, end_line) of every chunk."""
    most, lap = limits(max_tokens, overlap)
    lines = text.replace("\r\n", "\n").split("\n")
    units = [(s, i) for i, line in enumerate(lines, 1) for s in split_sentences(line)] if by_sentence else [(x, i) for i, x in enumerate(lines, 1)]
    sizes = [estimate(u) for u, _ in units]
    glue = " " if by_sentence else "\n"
    out = []
    for a, b in cut(units, sizes, most, lap):
        part = [u for u, _ in units[a : b + 1]]
        while part and part[0] == "":
            part.pop(0)
        out.append((glue.join(part), units[a][1], units[b][1]))
    return out


def chunks(df: DataFrame, id_col: str, text_col: str, max_tokens: int = 512, overlap: int = 0, by_sentence: bool = False) -> DataFrame:
    """id, index (from 0), text, start_line, end_line, characters, tokens (of the joined text) of every chunk."""
    most, lap = limits(max_tokens, overlap)
    if lap == 0 and not by_sentence:
        flat = _folded(df, id_col, text_col, most)
    else:
        src = df.filter(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_t"))
        schema = T.StructType([src.schema[0], T.StructField("index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(key, k, *c) for key, t in zip(pdf[id_col], pdf["_t"]) for k, c in enumerate(chunk_text(t, most, lap, by_sentence))]
                yield pd.DataFrame(rows, columns=schema.names)

        flat = src.mapInPandas(run, schema)
    return flat.select(id_col, "index", "text", "start_line", "end_line", F.length("text").alias("characters"), X.tokens(F.col("text")).alias("tokens"))


def chunk_summary(chunked: DataFrame, id_col: str) -> DataFrame:
    return chunked.groupBy(id_col).agg(F.count("*").cast("int").alias("total_chunks"), F.sum("tokens").alias("total_tokens"))
