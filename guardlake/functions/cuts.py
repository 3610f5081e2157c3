"""Where a text can be cut so that no match of any rule is cut: pairs of neighbouring characters that no match holds.

A pattern tells which character can follow which inside a match. A place between two characters that cannot follow each
other in any rule is safe: each side can be scanned by itself. A rule that lets everything follow everything between a
head and a tail (a key block) is found by its heads and tails instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from re import _constants as op
from re import _parser

from guardlake.functions.regex import java_regex

# Characters on either side that a piece sees beyond its own; look-around that sees further forbids every cut.
CONTEXT = 32
# Sets of characters are bits: one each for ASCII, one for other blanks, one for all others.
BLANK, OTHER = 1 << 128, 1 << 129
EVERY = (1 << 130) - 1
_SPACE = sum(1 << ord(c) for c in "\t\n\v\f\r ") | BLANK
_DIGIT = sum(1 << ord(c) for c in "0123456789")
_WORD = sum(1 << i for i in range(128) if chr(i).isalnum() or chr(i) == "_")
_KINDS = {
    op.CATEGORY_DIGIT: _DIGIT,
    op.CATEGORY_NOT_DIGIT: EVERY & ~_DIGIT,
    op.CATEGORY_WORD: _WORD,
    op.CATEGORY_NOT_WORD: EVERY & ~_WORD,
    op.CATEGORY_SPACE: _SPACE,
    op.CATEGORY_NOT_SPACE: EVERY & ~_SPACE,
}
# Ways to write "anything, as little as possible".
_ANYTHING = re.compile(r"\[\\s\\S\]\*\?|\[\\S\\s\]\*\?|\[\\d\\D\]\*\?|\[\\w\\W\]\*\?|\[\^\]\*\?")
MOST_ALTERNATIVES = 64


class Unknown(Exception):
    """The pattern has a part whose reach is not known."""


@dataclass(frozen=True)
class Crossing:
    """One way a rule can match: what can follow each character inside it, and texts that every such match holds."""

    follow: tuple[int, ...]
    needs: tuple[str, ...] = ()


EVERYWHERE = Crossing((EVERY,) * 130)


def _bits(mask: int) -> list[int]:
    return [i for i in range(130) if mask >> i & 1]


def _one(code: int) -> int:
    if code < 128:
        return 1 << code
    return BLANK if chr(code).isspace() or code == 0xFEFF else OTHER


def _span(low: int, high: int) -> int:
    mask = sum(1 << i for i in range(low, min(high, 127) + 1))
    return mask | (BLANK | OTHER if high > 127 else 0)


def _cased(mask: int, flags: int) -> int:
    """With the other case of every letter; some letters have one beyond ASCII."""
    if not flags & re.IGNORECASE:
        return mask
    letters = [i for i in _bits(mask) if i < 128 and chr(i).isalpha()]
    return mask | sum({1 << ord(chr(i).swapcase()) for i in letters} - {1 << i for i in _bits(mask)}) | (OTHER if letters else 0)


def _set(items, flags: int) -> int:
    may = must = 0
    negated = False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
            continue
        if kind is op.CATEGORY:
            mask = sure = _KINDS[value]
        else:
            mask = _one(value) if kind is op.LITERAL else _span(*value)
            # One character beyond ASCII is not all of them.
            sure = mask & ((1 << 128) - 1)
            mask = _cased(mask, flags)
        may, must = may | mask, must | sure
    return EVERY & ~must if negated else may


class _Walk:
    def __init__(self, flags: int):
        self.flags, self.follow = flags, [0] * 130

    def join(self, last: int, first: int) -> None:
        for i in _bits(last):
            self.follow[i] |= first

    def atom(self, mask: int) -> tuple[bool, int, int]:
        return False, mask, mask

    def many(self, items) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for item in items:
            e, f, z = self.item(*item)
            self.join(last, f)
            first |= f if empty else 0
            last = z | (last if e else 0)
            empty &= e
        return empty, first, last

    def item(self, kind, value) -> tuple[bool, int, int]:
        if kind is op.LITERAL:
            return self.atom(_cased(_one(value), self.flags))
        if kind is op.NOT_LITERAL:
            return self.atom(EVERY & ~(1 << value if value < 128 else 0))
        if kind is op.ANY:
            return self.atom(EVERY if self.flags & re.DOTALL else EVERY & ~(1 << 10 | 1 << 13))
        if kind is op.IN:
            return self.atom(_set(value, self.flags))
        if kind is op.SUBPATTERN:
            return self.many(value[3])
        if kind is op.ATOMIC_GROUP:
            return self.many(value)
        if kind is op.BRANCH:
            parts = [self.many(x) for x in value[1]]
            first = last = 0
            for _, f, z in parts:
                first, last = first | f, last | z
            return any(e for e, _, _ in parts), first, last
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            e, f, z = self.many(inner)
            if high > 1:
                self.join(z, f)
            return e or low == 0, f, z
        if kind is op.AT and value in (op.AT_BOUNDARY, op.AT_NON_BOUNDARY):
            return True, 0, 0
        if kind is op.AT and self.flags & re.MULTILINE and value in (op.AT_BEGINNING, op.AT_END):
            return True, 0, 0
        if kind in (op.ASSERT, op.ASSERT_NOT) and value[1].getwidth()[1] <= CONTEXT:
            return True, 0, 0
        raise Unknown(str(kind))


def _alternatives(items: list) -> list[list]:
    """The pattern as a choice of patterns, if it has one choice that is not repeated."""
    for i, (kind, value) in enumerate(items):
        inner = list(value[3]) if kind is op.SUBPATTERN else None
        choice = value if kind is op.BRANCH else inner[0][1] if inner and len(inner) == 1 and inner[0][0] is op.BRANCH else None
        if choice and len(choice[1]) <= MOST_ALTERNATIVES:
            return [items[:i] + list(x) + items[i + 1 :] for x in choice[1]]
    return [items]


def _needs(items, flags: int) -> list[str]:
    """Texts that every match holds: runs of fixed characters, groups that are not repeated included."""
    runs, run = [], ""
    for kind, value in [*items, (op.AT, None)]:
        fixed = kind is op.LITERAL and not (flags & re.IGNORECASE and chr(value).isalpha())
        if fixed:
            run += chr(value)
            continue
        if kind is op.AT and value is not None:
            continue
        if run:
            runs.append(run)
            run = ""
        if kind is op.SUBPATTERN:
            runs += _needs(value[3], flags)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            runs += _needs(value[2], flags)
    return runs


def _longest(groups: list[tuple[str, ...]]) -> tuple[str, ...] | None:
    return max(groups, key=lambda g: (min(map(len, g)), -len(g)), default=None)


def _held(items) -> list[tuple[str, ...]]:
    """Groups of lower-case texts: of each group, every match holds one, whatever its case."""
    groups, run = [], ""
    for kind, value in [*items, (op.SUCCESS, None)]:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind is op.AT:
            continue
        if run:
            groups.append((run,))
            run = ""
        if kind is op.SUBPATTERN:
            groups += _held(value[3])
        elif kind is op.BRANCH:
            best = [_longest(_held(branch)) for branch in value[1]]
            if None not in best:
                groups.append(tuple(dict.fromkeys(text for group in best for text in group)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            groups += _held(value[2])
        elif kind is op.ASSERT and value[0] > 0:
            groups += _held(value[1])
    return groups


@cache
def held_texts(pattern: str, flags: str = "") -> tuple[tuple[str, ...], ...]:
    """Groups of lower-case ASCII texts: of each group, a text where the JavaScript-dialect pattern matches holds one,
    once it is in lower case. None where the pattern is not understood. Long texts, which are rare, come first."""
    try:
        groups = _held(_parser.parse(re.sub(r"\(\?<(?![=!])", "(?P<", pattern.replace("[^]", r"[\s\S]")), re.ASCII))
    except (re.error, RecursionError, OverflowError):
        return ()
    return tuple(sorted(dict.fromkeys(groups), key=lambda g: (-min(map(len, g)), len(g), g)))


def _flags(flags: str) -> int:
    return sum({"i": re.IGNORECASE, "m": re.MULTILINE, "s": re.DOTALL}.get(f, 0) for f in set(flags or ""))


def crossings(pattern: str, flags: str = "") -> list[Crossing]:
    """The ways a JavaScript-dialect pattern can match; ``EVERYWHERE`` where its reach is not known."""
    bits = _flags(flags)
    try:
        parsed = _parser.parse(re.sub(r"\(\?<(?![=!])", "(?P<", pattern.replace("[^]", r"[\s\S]")), bits | re.ASCII)
        out = []
        for items in _alternatives(list(parsed)):
            walk = _Walk(bits)
            walk.many(items)
            out.append(Crossing(tuple(walk.follow), tuple(dict.fromkeys(_needs(items, bits)))))
        return out
    except (Unknown, re.error, RecursionError, OverflowError):
        return [EVERYWHERE]


def head_and_tail(pattern: str, flags: str = "") -> tuple[str, str] | None:
    """Patterns of the two ends of a rule that takes anything, as little as possible, between them."""
    parts = _ANYTHING.split(pattern)
    if len(parts) != 2 or not all(parts):
        return None
    try:
        if any(kind is op.BRANCH for kind, _ in _parser.parse(pattern.replace("[^]", r"[\s\S]"), _flags(flags) | re.ASCII)):
            return None
        for part in parts:
            if not _parser.parse(part, _flags(flags) | re.ASCII).getwidth()[0] or EVERYWHERE in crossings(part, flags):
                return None
        java_regex(parts[0], flags), java_regex(parts[1], flags)
    except (re.error, ValueError):
        return None
    return parts[0], parts[1]


def _class(mask: int) -> str:
    """A set of characters as a bracket."""
    if mask == EVERY:
        return r"[\s\S]"
    inside = "".join(f"\\x{i:02x}" for i in _bits(mask) if i < 128)
    inside += r"[\p{Z}\x{FEFF}&&[^ ]]" if mask & BLANK else ""
    return f"[{inside}{'[^' + chr(92) + 'x00-' + chr(92) + 'x7f' + chr(92) + 'p{Z}' + chr(92) + 'x{FEFF}]' if mask & OTHER else ''}]"


def cut(ways: Iterable[Crossing]) -> str:
    """A Java pattern of width 0 for the places that no match of these kinds can hold."""
    follow = [0] * 130
    for way in ways:
        follow = [a | b for a, b in zip(follow, way.follow)]
    groups: dict[int, int] = {}
    for i, after in enumerate(follow):
        if after != EVERY:
            groups[EVERY & ~after] = groups.get(EVERY & ~after, 0) | 1 << i
    if not groups:
        return "(?!)"
    return "(?:" + "|".join(f"(?<={_class(before)})(?={_class(after)})" for after, before in groups.items()) + ")"
