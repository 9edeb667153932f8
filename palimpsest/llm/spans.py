"""Spans of text by plain patterns: leftmost, non-overlapping per kind, in code points."""

import hashlib
import re

EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]*\Z")
HEAD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin at the start of a run of digits, since what follows the run decides it.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")

PII_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    d = NOT_DIGIT.sub("", s)
    return 14 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 10 <= len(NOT_DIGIT.sub("", s)) <= 15


def pii_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of emails, ips, cards and phones. Linear in the text, whatever it holds."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        m = EMAIL_TAIL.match(text, at)
        start = at
        if m:
            while start > floor and text[start - 1] in HEAD_CHARS:
                start -= 1
            if start < at:
                floor = m.end()
                out.append((start, floor, "email"))
                at = text.find("@", floor)
                continue
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if is_ip(m.group()):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if is_card(m.group()):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if is_phone(m.group()):
                out.append((m.start(), m.end(), "phone"))
    return ordered(out, PII_KINDS)


def secret_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of assignments, access keys and hex runs."""
    out = []
    low = (raw if raw is not None else text.encode("utf-8", "surrogatepass")).lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out, SECRET_KINDS)


def ordered(spans, kinds) -> list[tuple[int, int, str]]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
