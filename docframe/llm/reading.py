"""Reading level of documents from word acquisition grades.

1. Readers' labels give graded texts. For every word the share of each level's words that it makes up is
   its graded distribution; the median of that distribution is the grade at which it is acquired. Every word of the graded texts
   has a grade. The model is fitted on at most ``MAX_LABELLED`` labelled documents, picked by a hash of their ids, a bound of
   the model and not of the data it is applied to.
2. A document's score is a quantile of the grades of its known words, prose only. Which quantile, and the
   score at which each level begins, is calibrated on the labelled documents.
3. The two highest levels may share their words and differ in syntax. Among documents that the grades put at level 4 or above,
   the words per sentence at which level 5 begins are calibrated too, and used where they agree with more labels than the grades do.
4. All documents are scored in one Arrow pass; the grades are broadcast, their number bounded by the words of ``MAX_LABELLED`` documents.

Prose: fenced code, headings, table rows, code and log lines, lines without a sentence and data lists
do not count; a paragraph (lines between blank ones) counts where prose is at least half of it, and
paragraphs must outweigh the code and log lines outside fences 11 to 9. The median is hardly moved by an inserted foreign sentence. Runs of Chinese characters and kana are read as pairs.

Defined cases: null, empty and blank texts, texts without a prose paragraph and texts without a known
word have level null. Labels with a null level or of an unknown document are ignored; a rater's repeated
labels of a document count once, several raters by the median. Without labels every level is null. Repeated
documents are each scored. Ties between calibrations go to the lower quantile and threshold.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from docframe.session import checkpoint

LEVELS = (1, 2, 3, 4, 5)
QUANTILES = (0.25, 0.5, 0.75)
#: Labelled documents the model is fitted on.
MAX_LABELLED = 20_000
#: Score bins of the calibration histogram.
BINS = 400
#: Words per sentence that one bin of the second calibration stands for.
SENTENCE_BIN = 0.5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]+")
_BULLET = re.compile(r"(?:[-*•]|\d{1,3}[.)])\s+")
_ENDS = frozenset(".!?。！？…;；:")
_SYMBOL = re.compile(r"[{}<>=|\\\[\]@#$%^&~]|(?<=\w)\(|;$|^\w+: *\d")
_FENCE = ("```", "~~~")


def _prose_words(s: str, bullet: bool) -> list[str] | None:
    """Words of a line of prose, None where it is none. One pass of the word pattern serves both."""
    ended = s.rstrip("\"'»”’)]*_`")[-1:] in _ENDS
    if not s.isascii() and _CJK.search(s):
        return _WORD.findall(s) if ended else None
    n = s.count(" ") + 1
    if n < 4 or not (bullet or ended) or len(_SYMBOL.findall(s)) * 12 > n:
        return None
    found = _WORD.findall(s)
    return found if sum(map(len, found)) >= 0.7 * (len(s) - n + 1) else None


def prose(text: str) -> list[tuple[str, list[str]]]:
    """(line, words) of the paragraphs that are prose for at least half of their characters.

    None where prose is less than 55 in 100 of it and the code, data and log lines outside fences: sentences strewn in code.
    """
    out: list[tuple[str, list[str]]] = []
    good: list[tuple[str, list[str]]] = []
    prose_n = other_n = taken = code = 0
    fenced = False

    def close() -> None:
        nonlocal prose_n, other_n, taken
        if good and prose_n >= other_n:
            out.extend(good)
            taken += prose_n
        good.clear()
        prose_n = other_n = 0

    for line in text.splitlines():
        s = line.strip()
        if s.startswith(_FENCE):
            fenced = not fenced
            close()
        elif fenced:
            continue
        elif not s:
            close()
        elif s[0] in "#|{[<=>`}" or line.startswith(("    ", "\t")):
            other_n += len(s)
            code += len(s) if s[0] not in "#|" else 0
        else:
            b = _BULLET.match(s)
            body = s[b.end() :] if b else s
            found = _prose_words(body, bool(b))
            if found is not None:
                prose_n += len(body)
                good.append((body, found))
            else:
                other_n += len(s)
                code += len(s) if _SYMBOL.search(s) else 0
    close()
    return out if taken * 9 >= code * 11 else []


_SENTENCE_END = re.compile(r"[.!?。！？]+(?=\s|$|[^\s\w.])")


def measure(text: str | None) -> tuple[list[str], int]:
    """Lower-case words of the prose of a text, and how many sentences end in it."""
    if not text:
        return [], 0
    flat: list[str] = []
    ends = 0
    for line, found in prose(text.lower()):
        ends += len(_SENTENCE_END.findall(line))
        if line.isascii() or not _CJK.search(line):
            flat += found
            continue
        for w in found:
            runs = _CJK.findall(w)
            flat += [run[i : i + 2] for run in runs for i in range(max(1, len(run) - 1))] if runs else [w]
    return flat, ends


def words(text: str | None) -> list[str]:
    """Lower-case words of the prose of a text."""
    return measure(text)[0]


def true_levels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One level per labelled document: the median over raters, each counted once."""
    rated = labels.filter(F.col("level").isNotNull() & F.col(id_col).isNotNull())
    rated = rated.groupBy(id_col, F.lower(F.trim(F.coalesce("rater", F.lit("")))).alias("r")).agg(F.percentile("level", 0.5).alias("l"))
    return rated.groupBy(id_col).agg(F.percentile("l", 0.5).alias("level"))


def graded_texts(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Labelled documents as word counts: id, level, words, counts, length (words per sentence)."""
    levels = true_levels(labels, id_col).orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    src = documents.select(id_col, F.col(text_col).alias("_t")).join(F.broadcast(levels), id_col)  # at most max_labelled rows
    schema = T.StructType([src.schema[id_col], T.StructField("level", T.DoubleType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("length", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [measure(t) for t in pdf["_t"]]
            counted = [Counter(ws) for ws, _ in got]
            yield pd.DataFrame({id_col: pdf[id_col], "level": pdf["level"], "words": [list(c) for c in counted], "counts": [list(c.values()) for c in counted], "length": [len(ws) / max(1, n) for ws, n in got]})

    return src.mapInPandas(run, schema)


def word_grades(graded: DataFrame) -> DataFrame:
    """word, grade, n: the median of each word's distribution over levels, interpolated within a level."""
    flat = graded.select(F.least(F.greatest(F.round("level").cast("int"), F.lit(LEVELS[0])), F.lit(LEVELS[-1])).alias("lv"), F.explode(F.arrays_zip("words", "counts")).alias("x"))
    flat = flat.groupBy(F.col("x.words").alias("word"), "lv").agg(F.sum("x.counts").alias("n"))
    total = flat.groupBy("lv").agg(F.sum("n").alias("total"))
    share = flat.join(total, "lv").select("word", "lv", "n", (F.col("n") / F.col("total")).alias("p"))
    by = W.partitionBy("word")  # at most one row per level
    cum = share.withColumn("all", F.sum("p").over(by)).withColumn("c", F.sum("p").over(by.orderBy("lv")))
    half = F.col("all") / 2
    hit = cum.filter((F.col("c") >= half) & (F.col("c") - F.col("p") < half))
    hit = hit.select("word", (F.col("lv") - 1 + (half - (F.col("c") - F.col("p"))) / F.col("p")).alias("grade"))
    return hit.join(flat.groupBy("word").agg(F.sum("n").alias("n")), "word")


def _scores(ws, cs, grades: dict[str, float]) -> list[float] | None:
    got = [(grades[w], c) for w, c in zip(ws, cs) if w in grades]
    if not got:
        return None
    g = np.repeat([x for x, _ in got], [c for _, c in got])
    return np.quantile(g, QUANTILES).tolist()


class Model:
    """Grades and calibration: plain values, small enough to broadcast. ``long_from``: words per sentence from which level 5 begins, None where the grades decide it."""

    def __init__(self, grades: dict[str, float], quantile: float, cuts: list[float], long_from: float | None = None) -> None:
        self.grades, self.quantile, self.cuts, self.long_from = grades, quantile, cuts, long_from

    def score(self, text: str | None) -> tuple[float | None, int, float]:
        """(score, known words, words per sentence) of a text."""
        get = self.grades.get
        ws, ends = measure(text)
        g = [x for x in map(get, ws) if x is not None]
        if not g:
            return None, 0, 0.0
        return float(np.quantile(np.array(g), self.quantile)), len(g), len(ws) / max(1, ends)

    def level(self, score: float | None, length: float = 0.0) -> int | None:
        if score is None:
            return None
        level = LEVELS[bisect.bisect_right(self.cuts, score)]
        if level >= LEVELS[-2] and self.long_from is not None:
            return LEVELS[-1] if length >= self.long_from else LEVELS[-2]
        return level


def calibrate_length(hist: list[tuple[int, int, float, int]], cut: float) -> float | None:
    """Words per sentence at which level 5 begins, from rows (length bin, score bin, level, count) of documents at level 4 or above by their grades.

    None where cutting by the score, as before, agrees with at least as many labels.
    """
    top = LEVELS[-1] - 0.25
    by_score = sum(n for _, sb, lv, n in hist if (sb * LEVELS[-1] / BINS >= cut) == (lv >= top))
    best, at = by_score, None
    for b in sorted({lb for lb, *_ in hist}):
        right = sum(n for lb, _, lv, n in hist if (lb >= b) == (lv >= top))
        if right > best:
            best, at = right, b * SENTENCE_BIN
    return at


def calibrate(hist: list[tuple[int, int, float, int]]) -> tuple[float, list[float]]:
    """(quantile, score at which level 2, 3, 4, 5 begins) from rows (quantile index, bin, level, count)."""
    best = None
    for qi, q in enumerate(QUANTILES):
        mine = [(b, lv, n) for k, b, lv, n in hist if k == qi]
        cuts, right = [], 0
        for lv in LEVELS[1:]:
            up = np.zeros(BINS + 2)
            down = np.zeros(BINS + 2)
            for b, true, n in mine:
                (up if true >= lv - 0.25 else down)[b] += n
            # right decisions when documents from bin b on are put at lv or above
            good = np.concatenate(([0], np.cumsum(down)))[: BINS + 2] + np.cumsum(up[::-1])[::-1]
            # the middle of the widest stretch that is as good as the best but for a few labels: labels err, gaps do not
            fine = np.flatnonzero(good >= good.max() - 0.004 * sum(n for _, _, n in mine))
            runs = np.split(fine, np.flatnonzero(np.diff(fine) > 1) + 1)
            widest = max(runs, key=len)
            b = int(widest[len(widest) // 2])
            cuts.append(max(b * LEVELS[-1] / BINS, cuts[-1] if cuts else 0.0))
            right += int(good.max())
        if best is None or right > best[0]:
            best = (right, q, cuts)
    return best[1], best[2]


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Word grades and calibration from the labelled documents, at most ``max_labelled``."""
    graded = checkpoint(graded_texts(documents, labels, id_col, text_col, max_labelled))
    grades = {w: g for w, g in zip(*word_grades(graded).select("word", "grade").toPandas().to_dict("list").values())}  # words of max_labelled documents
    shared = documents.sparkSession.sparkContext.broadcast(grades)
    schema = "qi int, bin int, length int, level double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ws, cs, lv, length in zip(pdf["words"], pdf["counts"], pdf["level"], pdf["length"]):
                s = _scores(ws, cs, shared.value)
                if s:
                    rows += [(k, min(BINS, max(0, int(x * BINS / LEVELS[-1]))), min(BINS, int(length / SENTENCE_BIN)), lv) for k, x in enumerate(s)]
            yield pd.DataFrame(rows, columns=["qi", "bin", "length", "level"])

    hist = [tuple(r) for r in graded.mapInPandas(run, schema).groupBy("qi", "bin", "length", "level").count().toLocalIterator()]  # at most quantiles x max_labelled
    if not hist:
        return Model(grades, QUANTILES[1], [2.0, 3.0, 4.0, 5.0])
    quantile, cuts = calibrate([(k, b, lv, n) for k, b, _, lv, n in hist])
    mine = [(length, b, lv, n) for k, b, length, lv, n in hist if QUANTILES[k] == quantile and b * LEVELS[-1] / BINS >= cuts[-2]]
    return Model(grades, quantile, cuts, calibrate_length(mine, cuts[-1]))


def levels(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id, level (1 to 5, null where there is no graded prose), score, known_words of every document."""
    model = model or fit(documents, labels, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    src = documents.select(F.col(id_col), F.col(text_col).alias("_t"))
    schema = T.StructType([src.schema[0], T.StructField("level", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("known_words", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.score(x.as_py()) for x in batch.column(1)]
            cols = [batch.column(0), pa.array([m.level(s, n) for s, _, n in got], pa.int32()), pa.array([s for s, _, _ in got], pa.float64()), pa.array([n for _, n, _ in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)
