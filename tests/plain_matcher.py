"""The rule set in plain Python, text by text, to hold the plans against."""

from __future__ import annotations

import re
from dataclasses import dataclass

from guardlake.fixed.pii import INBOUND_PREFIX, INBOUND_SUFFIX, OUTBOUND_TOKEN
from guardlake.functions.validators import verhoeff_tables
from guardlake.rules import RuleSet

# ASCII white space plus the other members of the JavaScript class, for use inside brackets.
_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_CLASS_OR_ESCAPE = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|[\s\S]")
_PRODUCT, _PERMUTED = verhoeff_tables()


def python_regex(source: str, flags: str) -> re.Pattern:
    """Compile a JavaScript-dialect pattern with ASCII words, Unicode spaces and end-only anchors."""
    out = []
    for token in _CLASS_OR_ESCAPE.findall(source):
        if token == r"\s":
            token = f"[{_SPACE}]"
        elif token == "$":
            token = r"\Z"
        elif token.startswith("["):
            token = token.replace(r"\s", _SPACE)
        out.append(token.replace(r"\/", "/"))
    return re.compile("".join(out), re.ASCII | (re.IGNORECASE if "i" in flags else 0))


def _luhn(value: str) -> bool:
    digits = [int(c) for c in value if c in "0123456789"]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _verhoeff(value: str) -> bool:
    digits = [int(c) for c in value if c in "0123456789"]
    if len(digits) != 12:
        return False
    total = 0
    for i, d in enumerate(reversed(digits)):
        total = _PRODUCT[10 * total + _PERMUTED[10 * (i % 8) + d]]
    return total == 0


def _public_ipv4(value: str) -> bool:
    return value.split(".")[0].lstrip("0") != "127"


def _public_ipv6(value: str) -> bool:
    groups = [g for g in value.split(":") if g]
    if not groups:
        return False
    *head, last = groups
    return not (all(set(g) == {"0"} for g in head) and last.lstrip("0") in ("", "1"))


_CHECKS = {"CREDIT_CARD": _luhn, "AADHAAR": _verhoeff, "IPV4": _public_ipv4, "IPV6": _public_ipv6}
# Cheap tests that hold for every text with a match.
_DIGITS = re.compile("[0-9][ .-]?[0-9]")
_KEY_HEADS = re.compile("[sprk]k[-_]|AKIA|AIza|github_pat_|gh[pousr]_|npm_|hf_|xox|hooks")
_GUARDS = {
    "PRIVATE_KEY": "-----BEGIN ",
    "JWT": "eyJ",
    "CONN_STRING": "://",
    "API_KEY": _KEY_HEADS,
    "BEARER_TOKEN": "Bearer",
    "EMAIL": "@",
    "PHONE_US": _DIGITS,
    "PHONE_IN": "+91",
    "CREDIT_CARD": _DIGITS,
    "SSN": _DIGITS,
    "PAN_IN": _DIGITS,
    "AADHAAR": _DIGITS,
    "IPV4": _DIGITS,
    "IPV6": ":",
}


@dataclass
class Matcher:
    """Finds and rewrites the matches of one text."""

    rules: list[tuple[str, str, str, bool]]
    allow: list[tuple[str, str]]

    @staticmethod
    def of(rules: RuleSet) -> Matcher:
        return Matcher(
            [(r.name, r.pattern, r.flags, r.source == "default") for r in rules.active],
            [(a.pattern, a.flags) for a in rules.allow if a.enabled],
        )

    def compile(self) -> Matcher:
        groups: dict = {}
        for rank, (name, pattern, flags, default) in enumerate(self.rules):
            check = _CHECKS.get(name) if default else None
            guard = _GUARDS.get(name) if default else None
            groups.setdefault(guard, []).append((rank, name, python_regex(pattern, flags), check))
        self._groups = list(groups.items())
        self._allow = [python_regex(p, f) for p, f in self.allow]
        return self

    def spans(self, text: str, begin: int = 0) -> list[tuple[int, int, int, str]]:
        """(start, -end, rank, rule) of every good match from ``begin`` on, in settling order.

        What stands before ``begin`` still counts for word boundaries.
        """
        found = []
        for guard, members in self._groups:
            if guard and not (guard in text if isinstance(guard, str) else guard.search(text)):
                continue
            for rank, name, pattern, check in members:
                for m in pattern.finditer(text, begin):
                    value = m.group()
                    if not value or (check and not check(value)):
                        continue
                    if any(a.search(value) for a in self._allow):
                        continue
                    found.append((m.start(), -m.end(), rank, name))
        return sorted(found)

    def redact(self, text: str, direction: str, counts: dict[str, int]) -> str:
        return rewrite(text, self.spans(text), direction, counts)


def rewrite(
    text: str,
    spans: list[tuple[int, int, int, str]],
    direction: str,
    counts: dict[str, int],
    begin: int = 0,
    end: int | None = None,
) -> str:
    """``text[begin:end]`` with its spans replaced, overlaps settled on the way. None may cross ``end``."""
    end = len(text) if end is None else end
    out, at = [], begin
    for start, back, _, name in spans:
        if start >= end:
            break
        if start < at:
            continue
        token = OUTBOUND_TOKEN if direction == "outbound" else INBOUND_PREFIX + name + INBOUND_SUFFIX
        out += [text[at:start], token]
        counts[name] = counts.get(name, 0) + 1
        at = -back
    return "".join(out) + text[at:end]
