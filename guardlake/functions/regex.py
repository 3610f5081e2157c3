"""Rewrite JavaScript regular expressions for the JVM.

Rule files and pattern tables use the JavaScript dialect. The two engines disagree on word boundaries
(ASCII there, Unicode here), white space, the dot, anchors and character-class syntax; everything else
passes through. Named groups, look-around and quantifiers are the same.
"""

from __future__ import annotations

import re
from functools import lru_cache

WORD = "[A-Za-z0-9_]"
# Members of the JavaScript white-space class, for use inside brackets.
ANY_SPACE = r"\s\x{FEFF}\p{Z}"
LINE_END = r"\n\r\x{2028}\x{2029}"

WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
NO_BOUNDARY = f"(?:(?<!{WORD})(?!{WORD})|(?<={WORD})(?={WORD}))"

_OPTIONAL = re.compile(r"[?*]|\{0")
_WORD_ONLY_CLASS = re.compile(r"\[(?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\[dw])+\]")
_KNOWN_LETTERS = set("dDwWtnrfvcxuk")


def _atom_end(src: str, i: int) -> int:
    """Index just after the group, class, escape or character that starts at ``i``."""
    if src[i] == "\\":
        return i + 2
    if src[i] not in "([":
        return i + 1
    depth, in_class = 0, False
    while i < len(src):
        c = src[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        i += 1
        if depth == 0 and not in_class:
            break
    return i


def _branches(body: str) -> list[str]:
    parts, start, i = [], 0, 0
    while i < len(body):
        if body[i] == "|":
            parts.append(body[start:i])
            start = i + 1
        i = _atom_end(body, i)
    return parts + [body[start:]]


def _rest_of_branch(src: str, i: int) -> str:
    """From ``i`` to the end of the group that holds it."""
    start = i
    while i < len(src) and src[i] != ")":
        i = _atom_end(src, i)
    return src[start:i]


def _first_chars(src: str) -> str | None:
    """Characters a match can begin with, as the inside of a bracket; None when unknown or empty."""
    chars, i = [], 0
    while i < len(src):
        end = _atom_end(src, i)
        atom = src[i:end]
        if atom.startswith("(?:") or (atom.startswith("(") and not atom.startswith("(?")):
            body = atom[3:-1] if atom.startswith("(?:") else atom[1:-1]
            inner = [_first_chars(b) for b in _branches(body)]
            if None in inner:
                return None
            chars += inner
        elif atom in ("\\d", "\\w"):
            chars.append("0-9" if atom == "\\d" else "A-Za-z0-9_")
        elif re.fullmatch(r"\[(?!\^)(?:[^\\\]\[&]|\\[dw])+\]", atom):
            inside = atom[1:-1].replace("\\d", "0-9").replace("\\w", "A-Za-z0-9_")
            # A dash at either end would turn into a range next to its neighbours.
            chars.append(re.sub(r"^-|-$", r"\\-", inside))
        elif re.fullmatch(WORD, atom):
            chars.append(atom)
        elif re.fullmatch(r"\\[+.*?()\[\]{}|/$^]", atom):
            chars.append("\\" + atom[1])
        elif atom in (" ", "@", ":", "#", "<", ">", "=", "-", "'", '"', "/", "`"):
            chars.append("\\-" if atom == "-" else atom)
        else:
            return None
        if not _OPTIONAL.match(src, end):
            return "".join(dict.fromkeys(chars))
        quantifier = re.match(r"(?:[?*]|\{0,?\d*\})\??", src[end:])
        i = end + len(quantifier.group())
    return None


def _opens_with_word(src: str) -> str | None:
    """First characters if all of them are word characters: then a boundary before them is a start."""
    first = _first_chars(_branches(src)[0])
    return first if first and re.fullmatch(r"[A-Za-z0-9_-]+", first) and "\\-" not in first else None


@lru_cache(maxsize=None)
def java_regex(source: str, flags: str = "") -> str:
    """The Java pattern that matches what ``/source/flags`` matches in JavaScript."""
    unknown = set(flags) - set("gimsu")
    if unknown:
        raise ValueError(f"unsupported regex flags: {''.join(sorted(unknown))}")
    out: list[str] = []
    i, in_class = 0, False
    closes_with_word = False
    while i < len(source):
        c = source[i]
        if in_class:
            if c == "\\" and i + 1 < len(source):
                e = source[i + 1]
                out.append({"s": ANY_SPACE, "b": r"\x08", "/": "/"}.get(e, _plain_escape(e)))
                i += 2
                continue
            if c == "]":
                in_class = False
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
            i += 1
            continue
        was_word, closes_with_word = closes_with_word, False
        if c == "\\":
            if i + 1 == len(source):
                raise ValueError("pattern ends with a backslash")
            e = source[i + 1]
            if e == "b":
                first = _opens_with_word(_rest_of_branch(source, i + 2))
                if first:
                    # The look-ahead is redundant but cheap; it spares most positions the look-behind.
                    out.append(f"(?=[{first}]){WORD_START}")
                else:
                    out.append(WORD_END if was_word else BOUNDARY)
            elif e == "B":
                out.append(NO_BOUNDARY)
            elif e == "s":
                out.append(f"[{ANY_SPACE}]")
            elif e == "S":
                out.append(f"[^{ANY_SPACE}]")
            else:
                out.append("/" if e == "/" else _plain_escape(e))
                closes_with_word = e in "dw"
            i += 2
        elif c == "[":
            if source.startswith("[^]", i):
                out.append(r"[\s\S]")
                i += 3
            elif source.startswith("[]", i):
                out.append("(?!)")
                i += 2
            else:
                closes_with_word = bool(_WORD_ONLY_CLASS.fullmatch(source[i : _atom_end(source, i)]))
                in_class = True
                out.append("[^" if source.startswith("[^", i) else "[")
                i += 2 if source.startswith("[^", i) else 1
        elif c == ".":
            out.append(r"[\s\S]" if "s" in flags else f"[^{LINE_END}]")
            i += 1
        elif c == "^":
            out.append(f"(?:^|(?<=[{LINE_END}]))" if "m" in flags else "^")
            i += 1
        elif c == "$":
            out.append(f"(?=[{LINE_END}]|\\z)" if "m" in flags else r"\z")
            i += 1
        else:
            quantifier = re.match(r"\{\d+,?\d*\}\??|\+\??", source[i:])
            if quantifier and was_word and not _OPTIONAL.match(quantifier.group()):
                closes_with_word = True
                out.append(quantifier.group())
                i += len(quantifier.group())
            else:
                closes_with_word = bool(re.match(WORD, c)) and not _OPTIONAL.match(source, i + 1)
                out.append(c)
                i += 1
    prefix = ("i" if "i" in flags else "") + ("u" if "u" in flags and "i" in flags else "")
    # Most positions of a text fail on the first character, so test it before anything else.
    starts = [_first_chars(b) for b in _branches(source)]
    ahead = "" if None in starts or "\\b" in source[:2] else f"(?=[{''.join(starts)}])"
    body = "".join(out)
    return (f"(?{prefix})" if prefix else "") + (f"{ahead}(?:{body})" if len(starts) > 1 and ahead else ahead + body)


def _plain_escape(e: str) -> str:
    if e == "0":
        return r"\x00"
    if e.isalpha() and e not in _KNOWN_LETTERS and e not in "SB":
        return e
    return "\\" + e
