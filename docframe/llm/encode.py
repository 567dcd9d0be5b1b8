"""Encode texts with a public byte-level BPE vocabulary.

The rank file is local and its path a parameter. Each Arrow batch is encoded by tiktoken in a Python
worker, which loads the ranks once. A text longer than ``PIECE`` characters is cut at safe places
first, where the pre-splitting pattern always starts a new token, so the ids of the pieces joined are those of the
whole text: before a space between two words, between a letter and a digit, between letter or digit and any sign but an
apostrophe, before a line break or tab behind a word or sign, and between a single one and a letter or digit. In a run of one kind of character
there is no such place (the vocabulary may merge across the whole run); it is encoded in one go.

Defined cases: an empty text has the ids ``[]``; a null text has ``NULL_IDS``, also ``[]``, so that every
row has a list. Lone surrogates are encoded as U+FFFD. Repeated rows are each encoded; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed value: pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the public vocabularies; a parameter of every function.
VOCABULARIES = "/opt/tokenizers"
PIECE = 50_000
NULL_IDS: list[int] = []
#: A cut must leave every token of the pattern on one side, and the part before it must read the same without what
#: follows. Runs of white space look ahead, so only a single one that stands behind a word or sign may end a part.
_SAFE = regex.compile(
    r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])"
    r"|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"
    r"|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])"
    r"|(?<=[!-&(-/:-@\[-`{-~])(?=\p{N})"
    r"|(?<=[\p{L}\p{N}!-~])(?=[\n\r\t])"
    r"|(?<=[\p{L}\p{N}!-~][\n\r\t])(?=[\p{L}\p{N}])"
)


@lru_cache(maxsize=4)
def load(path: str):
    """The encoder of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at safe places into parts of about ``size`` characters; longer where there is no such place."""
    out, at = [], 0
    while len(text) - at > size:
        hit = _SAFE.search(text, at + size)
        if hit is None:
            break
        out.append(text[at : hit.start()])
        at = hit.start()
    out.append(text[at:])
    return out


def encode_text(enc, text: str | None, size: int = PIECE) -> list[int]:
    if text is None:
        return NULL_IDS
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in enc.encode_ordinary(p)]


def rank_file(vocabulary: str, folder: str = VOCABULARIES) -> str:
    return f"{folder}/{vocabulary}.tiktoken"


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row."""
    path = rank_file(vocabulary, folder)
    src = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([src.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for batch in batches:
            parts, ends = [], [0]
            for value in batch.column(1):
                text, n = value.as_py(), 0
                for p in pieces(text) if text is not None else ():
                    parts.append(enc.encode_to_numpy(p, disallowed_special=()).view("int32"))
                    n += len(parts[-1])
                ends.append(ends[-1] + n)
            flat = np.concatenate(parts) if parts else np.empty(0, "int32")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    return src.mapInArrow(run, schema)


def decode(ids: Column, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Column:
    """Text of a list of ids, through its raw bytes, so a token that ends inside a character does no harm."""
    path = rank_file(vocabulary, folder)

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        enc = load(path)
        return col.map(lambda x: None if x is None else b"".join(enc.decode_tokens_bytes(list(x))).decode("utf-8", "replace"))

    return run(ids)
