"""User patterns in RE2 syntax, rewritten for the JVM's regex engine."""

from __future__ import annotations

import re

_WORD = "[A-Za-z0-9_]"
# What the shorthand classes mean in RE2.
_CLASSES = {"d": "0-9", "w": "A-Za-z0-9_", "s": r"\t\n\f\r "}


class PatternError(ValueError):
    """The pattern is not valid RE2 syntax."""


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Java form of an RE2 pattern; raises PatternError for what RE2 itself rejects."""
    out, i, n = [], 0, len(pattern)
    depth = 0
    multiline = bool(re.match(r"\(\?[a-z]*m[a-z]*\)", pattern))
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("trailing backslash")
            d = pattern[i + 1]
            if d.isdigit():
                raise PatternError("back-references are not supported")
            if d == "Q":
                end = pattern.find(r"\E", i + 2)
                text = pattern[i + 2 : end if end >= 0 else n]
                out.append("".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in text))
                i = n if end < 0 else end + 2
                continue
            if d == "b":
                out.append(f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")
            elif d == "B":
                out.append(f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))")
            elif d in _CLASSES:
                out.append(f"[{_CLASSES[d]}]")
            elif d.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[d.lower()]}]")
            elif d in "CGZkKRXhHNV":
                raise PatternError(f"\\{d} is not supported")
            else:
                out.append(pattern[i : i + 2])
            i += 2
        elif c == "[":
            text, i = _char_class(pattern, i)
            out.append(text)
        elif c == "(":
            depth += 1
            if pattern.startswith("(?P<", i):
                end = pattern.find(">", i)
                name = pattern[i + 4 : end] if end > 0 else ""
                if not re.fullmatch(r"\w+", name):
                    raise PatternError("bad group name")
                out.append(f"(?<{_group_name(name)}>")
                i = end + 1
            elif re.match(r"\(\?<?[=!]|\(\?>", pattern[i:]):
                raise PatternError("look-around is not supported")
            elif m := re.match(r"\(\?([a-z-]*)([:)])", pattern[i:]):
                if "U" in m[1] or set(m[1]) - set("imsU-"):
                    raise PatternError(f"unsupported flag in {m[0]}")
                flags = m[1].replace("i", "iu")
                out.append(f"(?{flags}{m[2]}")
                depth -= m[2] == ")"
                i += m.end()
            elif pattern.startswith("(?U", i):
                raise PatternError("ungreedy flag is not supported")
            else:
                out.append("(")
                i += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unmatched )")
            out.append(c)
            i += 1
        elif c == "$" and not multiline:
            out.append(r"\z")
            i += 1
        elif c in "*+?}" and i + 1 < n and pattern[i + 1] == "+":
            raise PatternError("possessive quantifiers are not supported")
        else:
            out.append(c)
            i += 1
    if depth:
        raise PatternError("missing )")
    return ("(?iud)" if ignore_case else "(?d)") + "".join(out)


def _group_name(name: str) -> str:
    return "g" + "".join(ch if ch.isalnum() and ch.isascii() else f"x{ord(ch):x}x" for ch in name)


def _char_class(pattern: str, i: int) -> tuple[str, int]:
    """A bracket expression from position ``i``: (Java form, position behind it)."""
    out, n = ["["], len(pattern)
    i += 1
    if i < n and pattern[i] == "^":
        out.append("^")
        i += 1
    first = True
    while i < n and (first or pattern[i] != "]"):
        c = pattern[i]
        first = False
        if c == "[" and pattern.startswith("[:", i) and ":]" in pattern[i:]:
            end = pattern.index(":]", i)
            name = pattern[i + 2 : end].lstrip("^").capitalize()
            out.append(rf"\{'P' if '^' in pattern[i:end] else 'p'}{{{'XDigit' if name == 'Xdigit' else name}}}")
            i = end + 2
        elif c == "\\" and i + 1 < n:
            d = pattern[i + 1]
            out.append(_CLASSES.get(d) or (f"&&[^{_CLASSES[d.lower()]}]" if d.lower() in _CLASSES else pattern[i : i + 2]))
            i += 2
        elif c in "[&":
            out.append("\\" + c)
            i += 1
        else:
            out.append("\\]" if c == "]" else c)
            i += 1
    if i >= n:
        raise PatternError("missing ]")
    return "".join(out) + "]", i + 1


def literal(text: str, ignore_case: bool = True) -> str:
    """Java pattern that finds a text as it is."""
    quoted = r"\E\\E\Q".join(text.split(r"\E"))
    return f"(?iud)\\Q{quoted}\\E" if ignore_case else f"\\Q{quoted}\\E"


def search_pattern(query: str, is_regex: bool, case_sensitive: bool) -> str:
    return to_java(query, not case_sensitive) if is_regex else literal(query, not case_sensitive)


def replacement(template: str) -> str:
    """A ``$1``/``${name}`` template as a Java replacement; ``$1x`` names the group "1x", which is empty."""
    out = []
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$|\\|[^$\\]+", template):
        name = m[1] or m[2]
        if m[0] == "$$" or m[0] == "$":
            out.append(r"\$")
        elif m[0] == "\\":
            out.append(r"\\")
        elif name is None:
            out.append(m[0])
        elif name.isdigit():
            out.append(f"$" + name)
        elif name[0].isdigit():
            continue
        else:
            out.append("${" + _group_name(name) + "}")
    return "".join(out)
