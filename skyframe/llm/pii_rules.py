"""The fixed base rules for personal data, linear in the length of the text.

Each rule takes leftmost, non-overlapping matches of its pattern; a match that fails the
rule's own test is dropped and not retried.
"""

from __future__ import annotations

import re

# fixed values: kinds in the order in which spans that start together are listed
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is only tried from its first digit: if that fails, so do the later ones.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def plausible(kind: int, span: str) -> bool:
    """Whether a span found in another way passes the test of its kind: digits and checksum,
    parts of an address, something on either side of an @."""
    digits = _digits(span)
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind] == "phone":
        return 9 <= len(digits) <= 15
    if KINDS[kind] == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(map(_small, parts))
    left, at, right = span.partition("@")
    return bool(at and left.strip() and "." in right.strip(" ."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by start and kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
