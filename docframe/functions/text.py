"""Text functions as column expressions: line models, token estimate, cleaning, line edits, links.

Two line models must not be mixed. *Scan lines* (reading, editing, code search, concatenation) lose one
trailing carriage return each and have no empty line after a final newline; an empty text has none.
*Split lines* (document search, cleaning, chunking) turn CRLF into LF and keep the empty line after a final
newline; an empty text has one. A null text gives null throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from docframe.functions.regex import replacement, to_java

# Patterns of links, of ANSI control sequences and the marks trimmed from matches.
URL = r"https?://[^\s<>\"')\]]+"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_DATE_FORMS = r"(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})"
DATE = rf"\b{_DATE_FORMS}\b"
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]"
TRIMMED = ".,;:)"


def scan_lines(text: Column) -> Column:
    parts = F.split(text, "\n", -1)
    kept = F.when(text.endswith("\n") | (text == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.transform(kept, lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def split_lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def words(text: Column) -> Column:
    """Number of runs without Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def tokens(text: Column) -> Column:
    """The token estimate: a mean of characters and words, at least 1 for any text."""
    raw = F.floor((F.length(text) / F.lit(4.0) + words(text) * F.lit(1.3)) / F.lit(2.0)).cast("int")
    return F.when(F.length(text) > 0, F.greatest(raw, F.lit(1))).otherwise(F.when(text.isNotNull(), 0))


def token_estimate(text: Column) -> Column:
    return F.struct(F.length(text).alias("characters"), words(text).alias("words"), tokens(text).alias("tokens"))


def sentences(line: Column) -> Column:
    """Sentences of a line: they end at ``. ! ?`` before white space; trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(line, r"(?U)(?<=[.!?])(?=\s)"), unicode_trim), lambda x: x != "")


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def right_trim(text: Column) -> Column:
    """Without trailing spaces and tabs."""
    return F.regexp_replace(text, r"[ \t]+$", "")


def line_ending(content: Column) -> Column:
    """CRLF when the first 4096 bytes hold one, else LF."""
    head = F.substring(content.cast("binary"), 1, 4096)
    return F.when(F.contains(head, F.lit(b"\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


@dataclass(frozen=True)
class Clean:
    """Options of ``clean``; they take effect in the order given here."""

    strip_ansi: bool = False
    remove_chars: str = ""
    ascii_only: bool = False
    pattern: str = ""
    replace_with: str = ""
    trim_lines: bool = False
    drop_blank: bool = False
    crlf: bool = False


def clean(text: Column, o: Clean) -> Column:
    """struct(text, original_lines, resulting_lines, chars_removed, patterns_matched).

    Line endings become LF, CRLF only when asked for. An invalid pattern is ignored. chars_removed counts bytes
    of ANSI sequences and characters of the other removals.
    """
    removed = F.lit(0)
    if o.strip_ansi:
        bare = F.regexp_replace(text, ANSI, "")
        removed = removed + F.octet_length(text) - F.octet_length(bare)
        text = bare
    if o.remove_chars:
        less = F.translate(text, o.remove_chars, "")
        removed = removed + F.length(text) - F.length(less)
        text = less
    if o.ascii_only:
        plain = F.regexp_replace(text, r"[^\x00-\x7F]", "")
        removed = removed + F.length(text) - F.length(plain)
        text = plain
    matched = F.lit(0)
    if o.pattern:
        try:
            java = to_java(o.pattern)
        except ValueError:
            java = ""
        if java:
            matched = F.regexp_count(text, F.lit(java))
            text = F.regexp_replace(text, F.lit(java), F.lit(replacement(o.replace_with)))
    lines = split_lines(text)
    shown = lines
    if o.trim_lines:
        shown = F.transform(shown, right_trim)
    if o.drop_blank:
        shown = F.filter(shown, lambda x: unicode_trim(x) != "")
    joined = F.array_join(shown, "\r\n" if o.crlf else "\n")
    return F.struct(joined.alias("text"), F.size(lines).alias("original_lines"), F.size(shown).alias("resulting_lines"), removed.cast("int").alias("chars_removed"), F.when(text.isNotNull(), matched).cast("int").alias("patterns_matched"))


def _edited(text: Column, lines: Column, affected: Column) -> Column:
    """struct(text, lines_affected, total_lines, bytes_written) of edited lines, in the text's own line ending."""
    ending = line_ending(text)
    out = F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, F.lit("\n")).otherwise(F.lit("")))
    out = F.when(ending == "\r\n", F.replace(out, F.lit("\n"), F.lit("\r\n"))).otherwise(out)
    return F.struct(out.alias("text"), affected.alias("lines_affected"), F.size(lines).alias("total_lines"), F.octet_length(out).alias("bytes_written"))


def _content(content: str) -> Column:
    return F.split(F.lit(content.replace("\r\n", "\n")), "\n", -1) if content else F.array().cast("array<string>")


def replace_lines(text: Column, start: int, end: int, content: str) -> Column:
    """Lines start..end replaced; beyond the end of the text the content is appended, "" deletes."""
    end = start if end == 0 else end
    if start < 1 or end < start:
        raise ValueError("start must be 1 or more and end not before it")
    old = scan_lines(text)
    new = F.concat(F.slice(old, 1, start - 1), _content(content), F.slice(old, end + 1, F.greatest(F.size(old), F.lit(1))))
    return _edited(text, new, F.lit(end - start + 1))


def insert_lines(text: Column, line: int, content: str, before: bool = True) -> Column:
    """Content before or after a line; beyond the end of the text it is appended."""
    at = max(line, 1) - (1 if before else 0)
    old = scan_lines(text)
    new = F.concat(F.slice(old, 1, at) if at else F.array().cast("array<string>"), _content(content) if content else F.array(F.lit("")), F.slice(old, at + 1, F.greatest(F.size(old), F.lit(1))))
    return _edited(text, new, F.lit(1))


def delete_lines(text: Column, start: int, end: int = 0) -> Column:
    return replace_lines(text, start, end, "")


def unique_matches(text: Column, pattern: str, needs: str = "", java: str = "") -> Column:
    """Distinct matches without the trailing marks, in byte order. ``needs`` is a literal every match holds: a cheap test before the pattern runs."""
    found = F.regexp_extract_all(text, F.lit(f"({java or to_java(pattern)})"), F.lit(1))
    if needs:
        found = F.when(~text.contains(needs), F.array().cast("array<string>")).otherwise(found)
    cut = F.transform(found, lambda x: F.rtrim(x, F.lit(TRIMMED)))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda x: x != "")))


#: DATE begins and ends with a word character, so its boundaries need to look at one side only.
_DATE_JAVA = f"(?d)(?<![A-Za-z0-9_]){to_java(_DATE_FORMS).removeprefix('(?d)')}(?![A-Za-z0-9_])"


def links(text: Column) -> Column:
    return F.struct(unique_matches(text, URL, "http").alias("urls"), unique_matches(text, EMAIL, "@").alias("emails"), unique_matches(text, DATE, java=_DATE_JAVA).alias("dates"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def csv_rows(text: Column) -> Column:
    """Rows of a CSV text split at every comma, quotes or not; empty lines are dropped."""
    lines = F.filter(split_lines(text), lambda x: x != "")
    return F.transform(lines, lambda x: F.split(x, ",", -1))


def column_name(n: Column) -> Column:
    """Spreadsheet name of a 1-based column number, up to ZZZ."""
    a, b, c = (n - 1) % 26, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    letter = lambda x: F.char(x.cast("int") + 65)
    return F.concat(F.when(n > 702, letter(c)).otherwise(""), F.when(n > 26, letter(b % 26)).otherwise(""), letter(a))


def fit(width: Column, height: Column, max_width: float, max_height: float) -> Column:
    """struct(width, height) of an image scaled to a frame, its proportions kept; null without an extent."""
    scale = F.when((width > 0) & (height > 0), F.least(F.try_divide(F.lit(max_width), width), F.try_divide(F.lit(max_height), height)))
    return F.struct((width * scale).alias("width"), (height * scale).alias("height"))
