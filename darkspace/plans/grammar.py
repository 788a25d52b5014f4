"""Query, filter and capture-filter text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.net import PROTOCOLS, mask, ranges

#: Field letters of queries and the columns they stand for.
FIELDS = {"S": "saddr", "D": "daddr", "E": "sport", "A": "dport", "P": "proto", "L": "len", "s": "sec", "u": "usec"}


def field(letter: str) -> Column:
    if letter == "s":
        return F.floor(F.col("ts_us") / 1_000_000)
    if letter == "u":
        return F.pmod(F.col("ts_us"), F.lit(1_000_000))
    return F.col(FIELDS[letter])


def parse_query(text: str) -> list[tuple[str, int]]:
    """``S24A`` to [('S', 24), ('A', 0)]; at most 16 fields, widths up to 32."""
    parts = re.findall(r"([A-Za-z])(\d*)", text)
    if not parts or "".join(a + b for a, b in parts) != text or any(a not in FIELDS or int(b or 0) > 32 for a, b in parts) or len(parts) > 16:
        raise ValueError(f"no query: {text!r}")
    return [(a, int(b or 0)) for a, b in parts]


def query_columns(text: str) -> list[Column]:
    """The masked columns of a query; a width counts 32 bits for every field."""
    return [mask(field(letter).cast("long"), width).alias(FIELDS[letter]) for letter, width in parse_query(text)]


def parse_filter(text: str) -> Column:
    """``S24=1.2.3.0/P=6``: equalities joined by and; length and microseconds can't be filtered."""
    out = F.lit(True)
    for term in text.split("/"):
        m = re.fullmatch(r"([SDEAPs])(\d*)=([\d.]+)", term)
        if not m or m[1] in "SD" and m[3].count(".") != 3 or m[1] not in "SD" and not m[3].isdigit():
            raise ValueError(f"no filter term: {term!r}")
        width = int(m[2] or 0)
        value = ranges([m[3]])[0][0] if m[1] in "SD" else int(m[3])
        keep = value if width in (0, 32) else value & 0xFFFFFFFF & ~((1 << (32 - width)) - 1)
        out = out & (mask(field(m[1]).cast("long"), width) == keep)
    return out


def capture_filter(text: str) -> Column:
    """A subset of the capture filter language: ip, tcp, udp, icmp, [src|dst] host|net|port X, and, or, not, parentheses.

    As in capture filters, ``and`` and ``or`` bind alike, from left to right; ``not`` binds tighter.
    """
    tokens = re.findall(r"\(|\)|&&|\|\||!|[^\s()!]+", text)
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(tokens):
            raise ValueError(f"unfinished filter: {text!r}")
        return tokens[at - 1]

    def either(kind: str, side: str | None, value: str) -> Column:
        columns = {"src": "s", "dst": "d"}
        sides = [columns[side]] if side else ["s", "d"]
        out = F.lit(False)
        for s in sides:
            if kind == "port":
                out = out | (F.col(f"{s}port") == int(value)) & F.col("proto").isin(6, 17)
            else:
                low, high = ranges([value])[0]
                out = out | F.col(f"{s}addr").between(low, high)
        return out

    def primary() -> Column:
        token = take()
        if token in ("not", "!"):
            return ~primary()
        if token == "(":
            out = expression()
            if take() != ")":
                raise ValueError(f"no closing parenthesis: {text!r}")
            return out
        if token == "ip":
            return F.lit(True)
        if token in PROTOCOLS:
            return F.col("proto") == PROTOCOLS[token]
        side = token if token in ("src", "dst") else None
        kind = take() if side else token
        if kind not in ("host", "net", "port"):
            raise ValueError(f"unknown word {kind!r} in {text!r}")
        return either(kind, side, take())

    def expression() -> Column:
        out = primary()
        while at < len(tokens) and tokens[at] in ("and", "&&", "or", "||"):  # of equal precedence, from left to right
            out = out & primary() if take() in ("and", "&&") else out | primary()
        return out

    out = expression()
    if at < len(tokens):
        raise ValueError(f"unread words in {text!r}")
    return out
