"""Find and restore text that was decoded with the wrong character encoding.

The operator learns the wrong decodings from the corpus itself:

1. Lines are cut into words (runs of characters from ``@`` up; digits, blanks and most
   punctuation separate them). Words with a non-ASCII character form the vocabulary, each
   with its context key: the ASCII letters of the word and of both neighbours. That key is
   the text stripped of its non-ASCII characters, so a garbled word and its clean twin share it.
2. Garbled words are joined with clean near-twins: equal key and equal shape (the word with each non-ASCII run as one
   mark). Every group of key and shape has one twin, its shortest and then most frequent word, so a hot key never pairs its words.
   The runs of both words are aligned, and within them the characters; each pair votes for a mapping (garbled sequence to
   character). Mappings that most votes for their sequence agree on are learned, whether or not a known code page explains them.
3. Learned mappings are applied to all words until nothing changes, so text garbled several times over is restored layer by
   layer. What comes out must consist of characters that clean words hold.
4. Code pages that explain learned mappings (UTF-8 read as W) go on to sequences no twin showed: the words the mappings
   left are read through those pages, layer by layer.
5. Encodings of one byte a letter, and East Asian ones, keep the number of characters or have no ASCII skeleton; they are joined with
   clean words on key and restored form (``legacy_guesses``), the rarer spelling counting as garbled, and go on to words without a
   twin where ``stands_alone`` believes them. Replacement characters (U+FFFD) are restored from a twin where there is one.

``fixes`` names the route that decided each word. Nulls and empty texts are never affected. Repeated rows are each reported, rows of one id once; a repeated
line counts once in the statistics. An empty table gives an empty result. Extra columns are ignored except for the
named ones. Ties between hypotheses go to the one with more votes, then by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docframe.session import checkpoint

# Code pages that text is wrongly read as.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "cp852", "cp1250", "cp1251", "cp1253", "cp1254",
           "mac-roman", "iso8859-2", "iso8859-15", "koi8-r", "cp866")
# Single-byte and East Asian encodings that text was written in.
WRITTEN_SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "iso8859-7", "cp1254", "iso8859-2", "koi8-r", "koi8-u",
                  "cp866", "cp437", "cp850", "mac-roman", "mac-cyrillic", "iso8859-5")
WRITTEN_WIDE = ("shift_jis", "gb18030", "big5", "euc_jp", "euc_kr")
READ_FOR_LEGACY = ("cp1252", "latin-1", "cp1251", "mac-roman", "cp437", "cp850", "koi8-r", "cp866", "cp1250")

#: Words whose letters may be used in restored text even where their bytes happen to form UTF-8.
ONE_SCRIPT = r"^(?:\p{IsCyrillic}+|\p{IsGreek}+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+|\p{IsHangul}+|\p{IsArabic}+|\p{IsHebrew}+|\p{IsThai}+)$"
LOST = "�"
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_HIGH = re.compile(r"[^\x00-\x7f]+")


def _byte_map(codec: str) -> dict[int, int]:
    """Character to byte for the upper half of ``codec``; undefined bytes stand for their C1 control."""
    out: dict[int, int] = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


_MAPS = {c: _byte_map(c) for c in dict.fromkeys(READ_AS + READ_FOR_LEGACY)}
_LOW = {c: c for c in range(128)}


def _utf8_pass(word: str, codec: str, alphabet: frozenset[str] | None) -> tuple[str, int]:
    """``word`` with every UTF-8 sequence read through ``codec`` decoded, and how many there were."""
    table, found = _MAPS[codec], 0

    def run(m: re.Match) -> str:
        nonlocal found
        out, data = [], []
        text = m.group()
        for ch in text:
            data.append(table.get(ord(ch), 0x20))
        raw, at = bytes(data), 0
        for hit in _UTF8.finditer(raw):
            try:
                ch = hit.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            if alphabet is not None and ch not in alphabet:
                continue
            found += 1
            out.append(text[at : hit.start()] + ch)
            at = hit.end()
        return "".join(out) + text[at:]

    return _HIGH.sub(run, word), found


def utf8_guess(word: str, codecs: tuple[str, ...], alphabet: frozenset[str]) -> tuple[str, str] | None:
    """(read as, restored) of a word as UTF-8 read through some of ``codecs``, any number of layers deep.

    The layers in between may hold any character; what comes out must consist of known ones. Where no
    chain restores the whole word, the sequences of one layer that stand for known characters are.
    """

    def known(text: str) -> bool:
        return all(c in alphabet for c in text if c > "\x7f")

    best = None
    layer, seen = [(0, word, None)], {word}
    while layer:  # every pass shortens the text, so this ends
        found = {}
        for done, text, first in layer:
            passes = [(*_utf8_pass(text, c, None), i, c) for i, c in enumerate(codecs)]
            # beyond the first layer only by the pages that explain most of the text: what they read is the text of the layer before
            least = max(n for _, n, _, _ in passes) if first and passes else 1
            for out, n, i, c in passes:
                if n and n >= least and out not in found and out not in seen:
                    found[out] = (done + n, -i, out, first or c)
        for n, i, out, first in found.values():
            if known(out) and (best is None or (n, i) > best[0]):
                best = ((n, i), first, out)
        seen.update(found)
        layer = [(n, out, first) for n, _, out, first in found.values()]
    if best:
        return best[1], best[2]
    part = max(((n, -i, c, t) for i, c in enumerate(codecs) for t, n in [_utf8_pass(word, c, alphabet)] if n), default=None)
    return (part[2], part[3]) if part else None


_LETTER_RUNS = {name: re.compile(rf"[{chars}]+") for name, chars in (("cyrillic", "Ѐ-ӿ"), ("greek", "Ͱ-Ͽἀ-῿"), ("latin", "A-Za-zÀ-ÖØ-öø-ɏẞ"))}
_EDGES = "'\"’.,;:!?()[]{}<>@\\\\_^`|~"
#: What clean text holds between letters: dashes, quotes, dots, bullets.
_JOINTS = frozenset("–—‘’‚“”„…•·«»‹›¡¿")


def _script(text: str) -> str | None:
    """The one script of a run of letters, if its capitals stand as words have them."""
    name = next((n for n, p in _LETTER_RUNS.items() if p.fullmatch(text)), None)
    return name if name and (text.islower() or text.isupper() or text == text[0] + text[1:].lower()) else None


def stands_alone(word: str, restored: str) -> bool:
    """Is a one-byte restoration believable without a twin: no word as it stands, one of a single script when restored?

    A Latin run of four or more letters without an ASCII one among them is no word either, nor are letters around a
    symbol other than ``_JOINTS``. Words that are well formed in both readings are not decided.
    """
    a, b = word.strip(_EDGES), restored.strip(_EDGES)
    script = _script(b) if a and b else None
    high = sum(c > "\x7f" for c in b)
    if script is None or len(b) < 4 or (script != "latin" and high < 4):
        return False
    was = _script(a)
    if script == "latin":
        inner = [c for c in a[1:-1] if c > "\x7f" and not c.isalpha()]
        return was is None and not any(c in _JOINTS for c in a) and (bool(inner) or a.isalpha()) and high * 2 <= len(b)
    if any(c in _JOINTS for c in a):
        was = None if sum(c.isalpha() and c > "\x7f" for c in a) >= 3 and not any(_script(x) for x in re.split(f"[{''.join(_JOINTS)}]+", a)) else "latin"
    return was is None or (was == "latin" and not any(c < "\x80" for c in a))


def legacy_guesses(word: str) -> list[tuple[str, str, str]]:
    """(read as, written as, restored) for every non-UTF-8 hypothesis that turns the whole word into letters."""
    out = []
    for w in READ_FOR_LEGACY:
        table = _MAPS[w]
        data = [c if c < 128 else table.get(c, -1) for c in map(ord, word)]
        if min(data) < 0:
            continue
        raw = bytes(data)
        for r in WRITTEN_SINGLE:
            if r == w:
                continue
            try:
                text = raw.decode(r)
            except UnicodeDecodeError:
                continue
            if text != word and text.isprintable():
                out.append((w, r, text))
        if len(raw) >= 4 and w in ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251"):
            for r in WRITTEN_WIDE:
                try:
                    text = raw.decode(r)
                except UnicodeDecodeError:
                    continue
                if sum("぀" <= c <= "鿿" or "가" <= c <= "힣" for c in text) * 2 >= len(_HIGH.sub("", word)) + 2 and text.isprintable():
                    out.append((w, r, text))
    return out


def records(*parts: tuple[str, DataFrame, str, str]) -> DataFrame:
    """One relation (source_table, row_id, text) of several tables given as (name, df, id column, text column)."""
    out = None
    for name, df, id_col, text_col in parts:
        one = df.select(F.lit(name).alias("source_table"), F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def _lines(rec: DataFrame) -> DataFrame:
    keep = rec.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    lines = F.filter(F.split("text", r"\n"), lambda x: x.rlike(r"[^\x00-\x7F]"))
    return keep.select("source_table", "row_id", F.explode(lines).alias("line"))


_TOKENS = re.compile(r"[\x00-\x3f]+")
_LETTERS = re.compile(r"[^A-Za-z]+")
_WORDS = T.StructType([T.StructField(n, T.StringType()) for n in ("line_key", "word", "key")])


@lru_cache(maxsize=200_000)
def _skeleton(token: str) -> str:
    return _LETTERS.sub("", token)


def context_words(line: str) -> set[tuple[str, str | None]]:
    """The distinct (word, context key) of the words of a line that hold a non-ASCII character."""
    toks = _TOKENS.split(line)
    out = set()
    for i, t in enumerate(toks):
        if t.isascii():
            continue
        before = _skeleton(toks[i - 1]) if i else ""
        own, after = _skeleton(t), _skeleton(toks[i + 1]) if i + 1 < len(toks) else ""
        out.add((t, f"{before}\1{own}\1{after}" if len(before) + len(own) + len(after) >= 3 else None))
    return out


def _line_words(lines: DataFrame) -> DataFrame:
    """line_key (digest of the line), word, key of every distinct line. Arrow, as the JVM needs ten times as long."""
    src = lines.select("line").distinct().select(F.md5("line").alias("line_key"), "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, contexts = [], [], []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, k in context_words(line):
                    keys.append(key)
                    words.append(w)
                    contexts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (keys, words, contexts)], names=_WORDS.names)

    return src.mapInArrow(run, _WORDS)


_GUESS = T.StructType([T.StructField(n, T.StringType()) for n in ("word", "kind", "read_as", "written_as", "restored")])


def _guess_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for word in pdf["word"]:
            if LOST in word:
                continue
            for w in READ_AS:
                text, n = _utf8_pass(word, w, None)
                if n:
                    rows.append((word, "utf8", w, "utf-8", text))
            rows += [(word, "legacy", w, r, text) for w, r, text in legacy_guesses(word)]
        yield pd.DataFrame(rows, columns=_GUESS.names)


def aligned(word: str, twin: str) -> list[tuple[str, str]]:
    """(garbled sequence, character) pairs of a word and its twin, whose non-ASCII runs stand in the same places.

    A run of the twin that is one character long takes the whole garbled run; a longer one takes equal parts of it, and says
    nothing where the lengths do not divide.
    """
    out = []
    for got, want in zip(_HIGH.findall(word), _HIGH.findall(twin)):
        if got == want:
            continue
        n, k = len(want), len(got)
        if n == 1 and k > 1:
            out.append((got, want))
        elif n > 1 and k % n == 0 and k > n:
            out += [(got[i * k // n : (i + 1) * k // n], want[i]) for i in range(n)]
    return [(g, c) for g, c in out if g != c]


_ALIGNED = T.StructType([T.StructField(n, T.StringType()) for n in ("got", "want")])


def _align_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([p for w, t in zip(pdf["word"], pdf["twin"]) for p in aligned(w, t)], columns=_ALIGNED.names)


def explained(got: str, want: str, codecs: tuple[str, ...] = READ_AS) -> bool:
    """Does UTF-8 read through a known code page turn the character into the sequence?"""
    return any(_utf8_pass(got, c, None)[0] == want for c in codecs)


def learned_mappings(votes: list[tuple[str, str, int]], least: int = 3, share: float = 0.9) -> dict[str, str]:
    """Garbled sequence to character: those most votes for the sequence agree on.

    A mapping that a known code page explains needs one vote; any other ``least`` votes, and that the
    character is a letter and no part of the sequence.
    """
    total: dict[str, int] = {}
    for got, _, n in votes:
        total[got] = total.get(got, 0) + n
    out = {}
    for got, want, n in sorted(votes, key=lambda v: (v[2], v[0], v[1])):
        known = explained(got, want)
        if n >= share * total[got] and (known or (n >= least and want.isalpha() and want not in got)):
            out[got] = want
    return out


def apply_mappings(word: str, pattern: re.Pattern, table: dict[str, str]) -> str:
    """The word with learned sequences replaced until nothing changes."""
    while True:
        out = pattern.sub(lambda m: table[m.group()], word)
        if out == word:
            return out
        word = out


@F.pandas_udf(T.BooleanType())
def _fills(word: pd.Series, twin: pd.Series) -> pd.Series:
    """Is the twin the word with its replacement characters filled in?"""

    def one(w: str, t: str | None) -> bool:
        parts = re.split(f"{LOST}+", w)
        return t is not None and re.fullmatch(r"[^\x00-\x7f]{1,6}".join(map(re.escape, parts)), t) is not None

    return pd.Series([one(w, t) for w, t in zip(word, twin)], dtype="bool")


def learn(rec: DataFrame, min_votes: int = 1, min_legacy_votes: int = 3, min_mapping_votes: int = 3) -> dict[str, DataFrame]:
    """Learn the wrong decodings of a corpus.

    Returns ``line_words`` (line_key, word, key), ``vocab`` (word, key, n), ``pairs`` (kind, read_as, written_as, votes, against, learned),
    ``mappings`` (got, want, votes, learned), ``fixes`` (word, key or null, restored, read_as, written_as, route). What several joins use
    is cut through the checkpoint folder.
    """
    line_words = checkpoint(_line_words(_lines(rec)))
    vocab = checkpoint(line_words.groupBy("word", "key").agg(F.count("*").alias("n")))
    words = vocab.groupBy("word").agg(F.sum("n").alias("n"))
    # guessing costs far more than the words' bytes suggest: keep AQE from merging its partitions
    spread = int(rec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    guesses = checkpoint(words.select("word").repartition(spread).mapInPandas(_guess_all, _GUESS))

    # near-twins first: one clean form per key and shape, aligned with the longer forms of the group
    # (a word without letters of its own that survive would be a twin of whatever stands between the same neighbours)
    shaped = vocab.filter("key is not null").filter(~F.col("word").contains(LOST) & (F.length(F.regexp_replace("word", "[^A-Za-z]", "")) >= 2)).withColumn("shape", F.regexp_replace("word", r"[^\x00-\x7F]+", "\x01"))
    one = shaped.groupBy("key", "shape").agg(F.min_by("word", F.struct(F.length("word"), -F.col("n"), "word")).alias("twin"), F.max(F.length("word")).alias("longest"))
    near = shaped.join(one.filter("longest > length(twin)"), ["key", "shape"]).filter("length(word) > length(twin)").select("word", "twin")
    mapped = checkpoint(near.mapInPandas(_align_all, _ALIGNED).groupBy("got", "want").agg(F.count("*").alias("votes")))
    # sequences seen once and explained by no code page are of no use; what is left is bounded by the characters of all alphabets
    votes_of = [(r["got"], r["want"], r["votes"]) for r in mapped.filter(F.length("got") <= 24).toLocalIterator()]
    table = learned_mappings(votes_of, min_mapping_votes)

    seen = ["kind", "read_as", "written_as"]

    def align(part: DataFrame, clean: DataFrame) -> DataFrame:
        """Guesses joined with clean near-twins: equal key and equal restored word; or, for longer words, equal restored word."""
        keys = vocab.join(clean, "word", "left_semi").filter("key is not null").select("key", F.col("word").alias("restored"), F.col("n").alias("n_clean"))
        keyed = part.join(vocab.filter("key is not null").select("word", "key", "n"), "word").join(keys, ["key", "restored"])
        alone = words.join(clean, "word", "left_semi").select(F.col("word").alias("restored"), F.col("n").alias("n_clean"))
        worded = part.filter(F.length("restored") >= 3).join(words, "word").join(alone, "restored")
        cols = [*seen, "key", "word", "restored", "n", "n_clean"]
        return keyed.select(*cols).unionByName(worded.withColumn("key", F.lit(None).cast("string")).select(*cols))

    def vote(aligned: DataFrame) -> DataFrame:
        utf8 = F.col("kind") == "utf8"
        out = aligned.groupBy(*seen).agg(
            F.count(F.when(utf8 | (F.col("n_clean") > F.col("n")), 1)).alias("votes"),
            F.count(F.when(~utf8 & (F.col("n_clean") < F.col("n")), 1)).alias("against"),
        )
        # UTF-8 and the East Asian encodings have a structure that does not come about by chance
        least = F.when(utf8 | F.col("written_as").isin(*WRITTEN_WIDE), F.lit(min_votes)).otherwise(F.lit(min_legacy_votes))
        return out.withColumn("learned", (F.col("votes") >= least) & (F.col("votes") > 2 * F.col("against")))

    # UTF-8 first: a garbled word holds valid sequences, its twin none
    dirty = guesses.filter("kind = 'utf8'").select("word").distinct()
    clean = checkpoint(words.join(dirty, "word", "left_anti").filter(~F.col("word").contains(LOST)).select("word"))
    pairs = vote(align(guesses.filter("kind = 'utf8'"), clean))
    known = pairs.filter("learned").orderBy(F.desc("votes"), *seen).collect()  # at most one row per code page
    codecs = tuple(r["read_as"] for r in known)
    # characters of clean words: what a restored text may consist of
    # (a word all in one script that is not Latin counts as such too, although its bytes may happen to look like UTF-8)
    plain = words.filter(F.col("word").rlike(ONE_SCRIPT)).select("word")
    letters = clean.union(plain).select(F.explode(F.array_distinct(F.split(F.regexp_replace("word", r"[\x00-\x7F]", ""), ""))).alias("c"))
    alphabet = frozenset(r["c"] for r in letters.distinct().collect() if r["c"])  # at most all of Unicode

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("word", "restored", "read_as", "written_as")])

    def structural(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word in pdf["word"]:
                if LOST not in word and (hit := utf8_guess(word, codecs, alphabet)) and hit[1] != word:
                    rows.append((word, hit[1], hit[0], "utf-8"))
            yield pd.DataFrame(rows, columns=schema.names)

    null_key = F.lit(None).cast("string")
    pattern = re.compile("|".join(map(re.escape, sorted(table, key=lambda g: (-len(g), g)))) or r"(?!)")

    def mapping(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word in pdf["word"]:
                if LOST not in word and pattern.search(word):
                    out = apply_mappings(word, pattern, table)
                    # a word with further sequences, which no twin showed, is read through the code pages as a whole
                    if out != word and all(c in alphabet for c in out if c > "\x7f") and not any(_utf8_pass(out, c, None)[1] for c in codecs):
                        rows.append((word, out, None, None))
            yield pd.DataFrame(rows, columns=schema.names)

    by_map = checkpoint(words.select("word").mapInPandas(mapping, schema)).withColumn("key", null_key)
    left = dirty.join(by_map.select("word"), "word", "left_anti")
    by_page = checkpoint(left.repartition(spread).mapInPandas(structural, schema)).withColumn("key", null_key)
    by_rule = by_map.unionByName(by_page)

    # then other encodings, among the words that UTF-8 does not explain
    rest = words.select("word").join(by_rule.select("word"), "word", "left_anti")
    legacy = checkpoint(align(guesses.filter("kind = 'legacy'").join(rest, "word", "left_semi"), rest))
    votes = vote(legacy)
    pairs = pairs.unionByName(votes)
    ranks = {(r["read_as"], r["written_as"]): (i, r["votes"]) for i, r in enumerate(votes.filter("learned").orderBy(F.desc("votes"), *seen).collect())}  # at most one row per pair of code pages
    rank = rec.sparkSession.createDataFrame([(w, r, v) for (w, r), (_, v) in ranks.items()] or [("", "", 0)], "read_as string, written_as string, votes long")
    letters_left = F.length(F.regexp_replace("word", r"[^A-Za-z]", ""))
    sure = F.col("key").isNotNull() | (letters_left >= 2) | (F.length("word") >= 4) | ((F.length("word") == 3) & (letters_left == 0))
    by_twin = (
        legacy.join(F.broadcast(rank), ["read_as", "written_as"])  # one row per learned pair of code pages
        .filter((F.col("n_clean") > F.col("n")) & sure)
        .groupBy("word", "key")
        .agg(F.max_by(F.struct("restored", "read_as", "written_as"), F.struct("votes", "n_clean", "restored")).alias("best"))
        .select("word", "best.restored", "best.read_as", "best.written_as", "key")
    )

    # what holds in most contexts of a word holds in those without a twin as well
    seen_in = by_twin.filter("key is not null").join(vocab, ["word", "key"]).groupBy("word").agg(F.sum("n").alias("k"), F.max_by(F.struct("restored", "read_as", "written_as"), F.struct("n", "restored")).alias("b"))
    mostly = seen_in.join(words, "word").filter((F.length("word") >= 2) & (F.col("k") * 2 > F.col("n"))).select("word", "b.*").withColumn("key", null_key)

    def wide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """East Asian text without a twin: long runs that decode to known characters only."""
        for pdf in batches:
            rows = []
            for word, w, r, text in zip(pdf["word"], pdf["read_as"], pdf["written_as"], pdf["restored"]):
                if (w, r) in ranks and len(text) >= 3 and sum(c > "\x7f" for c in word) >= 6 and all(c in alphabet for c in text if c > "\x7f"):
                    rows.append((ranks[w, r][0], word, text, w, r))
            yield pd.DataFrame(rows, columns=["rank", *schema.names])

    east = guesses.filter(F.col("written_as").isin(*WRITTEN_WIDE)).join(rest, "word", "left_semi").mapInPandas(wide, "rank int, word string, restored string, read_as string, written_as string")
    east = east.groupBy("word").agg(F.min_by(F.struct("restored", "read_as", "written_as"), "rank").alias("b")).select("word", "b.*").withColumn("key", null_key)
    east = east.join(by_twin.select("word"), "word", "left_anti")

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One-byte text without a twin: no word as it stands, one of known letters and a single script when restored."""
        for pdf in batches:
            rows = []
            for word, w, r, text in zip(pdf["word"], pdf["read_as"], pdf["written_as"], pdf["restored"]):
                if (w, r) in ranks and all(c in alphabet for c in text if c > "\x7f") and stands_alone(word, text):
                    rows.append((ranks[w, r][0], word, text, w, r))
            yield pd.DataFrame(rows, columns=["rank", *schema.names])

    single = guesses.filter(F.col("written_as").isin(*WRITTEN_SINGLE)).join(rest, "word", "left_semi").mapInPandas(narrow, "rank int, word string, restored string, read_as string, written_as string")
    single = single.groupBy("word").agg(F.min_by(F.struct("restored", "read_as", "written_as"), "rank").alias("b")).select("word", "b.*").withColumn("key", null_key)
    single = single.join(by_twin.select("word").union(east.select("word")), "word", "left_anti")
    twins = vocab.filter("key is not null").withColumn("good", ~F.col("word").contains(LOST)).join(by_rule.select("word"), "word", "left_anti")
    best = twins.filter("good").groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("restored"))
    lost = vocab.filter(F.col("word").contains(LOST)).join(best, "key", "left")
    lost = lost.select("word", F.when(_fills(F.col("word"), F.col("restored")), F.col("restored")).alias("restored"), F.lit("utf-8").alias("read_as"), null_key.alias("written_as"), "key")
    cols = ["word", "key", "restored", "read_as", "written_as"]
    routes = {"mapping": by_map, "code page": by_page, "one-byte twin": by_twin, "one-byte twin elsewhere": mostly, "east asian": east, "one-byte alone": single, "lost characters": lost}
    fixes = None
    for name, part in routes.items():
        part = part.select(*cols, F.lit(name).alias("route"))
        fixes = part if fixes is None else fixes.unionByName(part)
    learned = rec.sparkSession.createDataFrame(list(table.items()) or [("", "")], "got string, want string").withColumn("learned", F.lit(True))
    mappings = mapped.join(learned, ["got", "want"], "left").withColumn("learned", F.coalesce("learned", F.lit(False)))
    return {"line_words": line_words, "vocab": vocab, "pairs": pairs, "mappings": mappings, "fixes": checkpoint(fixes)}


def affected(rec: DataFrame, **options) -> DataFrame:
    """Rows (source_table, row_id, fixes) of ``records`` that hold a garbled sequence.

    ``fixes`` is a map from garbled word to restored word; a word that cannot be recovered maps to
    itself.
    """
    learned = learn(rec, **options)
    fixes = learned["fixes"].select("word", "key", F.coalesce("restored", "word").alias("restored"))
    free = fixes.filter("key is null").groupBy("word").agg(F.max("restored").alias("by_word"))
    bound = fixes.filter("key is not null").groupBy("word", "key").agg(F.max("restored").alias("by_key"))
    occ = learned["line_words"].join(fixes.select("word").distinct(), "word", "left_semi")
    hit = occ.join(free, "word", "left").join(bound, ["word", "key"], "left")
    lost = F.when(F.col("word").contains(LOST), F.col("word"))
    hit = hit.select("line_key", "word", F.coalesce("by_key", "by_word", lost).alias("restored")).filter("restored is not null")
    garbled = hit.groupBy("line_key").agg(F.collect_set(F.struct("word", "restored")).alias("fixes"))
    # one row per distinct garbled line: small enough, it is broadcast; else a line that fills a third of the corpus is split by the skew join
    rows = _lines(rec).select("source_table", "row_id", F.md5("line").alias("line_key")).join(garbled, "line_key")
    words = F.array_distinct(F.flatten(F.collect_list("fixes")))
    ordered = F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x["word"])).alias("o"), x["word"].alias("word"), x["restored"].alias("restored"))))
    return rows.groupBy("source_table", "row_id").agg(ordered.alias("fixes"))


def routes(rec: DataFrame, **options) -> DataFrame:
    """How many words, and distinct lines, each route decided: route, words, lines."""
    learned = learn(rec, **options)
    fixes = learned["fixes"].select("word", "route").distinct()
    found = learned["line_words"].join(fixes, "word")
    return found.groupBy("route").agg(F.count_distinct("word").alias("words"), F.count_distinct("line_key").alias("lines"))


def restore(rec: DataFrame, **options) -> DataFrame:
    """Affected rows with ``text``, ``restored`` and ``complete`` (nothing unrecoverable is left)."""
    # a text of ASCII letters alone is never affected: such texts are left out before the join moves them
    rows = affected(rec, **options).join(rec.filter(F.col("text").rlike(r"[^\x00-\x7F]")), ["source_table", "row_id"])
    fixed = F.aggregate("fixes", F.col("text"), lambda t, x: F.replace(t, x["word"], x["restored"]))
    return rows.select("source_table", "row_id", "text", fixed.alias("restored"), (~F.coalesce(fixed.contains(LOST), F.lit(False))).alias("complete"))
