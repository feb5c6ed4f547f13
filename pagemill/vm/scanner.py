"""Bytes to objects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from ..functions import codecs
from .objects import PSError, single

SPACE = b"\0\t\n\f\r "
_TOKEN_END = re.compile(rb"[\0\t\n\f\r ()<>\[\]{}/%]")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\n\r\f]*)*")
#: White space and comments, then a word with the white space that ends it, if one is there.
_WORD = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\n\r\f]*)*(?:([^\0\t\n\f\r ()<>\[\]{}/%]+)(?:\r\n|[\0\t\n\f\r ])?)?")
_INT = re.compile(rb"[+-]?\d+\Z")
_REAL = re.compile(rb"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?\Z")
_RADIX = re.compile(rb"(\d+)#([0-9A-Za-z]+)\Z")
MAX_STRING, MAX_NESTING = 65535, 1000
END = ("end",)


def number(word: bytes):
    """The number that a word is, else None."""
    first = word[:1]
    if not (first.isdigit() or first in (b"+", b"-", b".")):
        return None
    if _INT.match(word):
        value = int(word)
        if -(1 << 31) <= value < 1 << 31:
            return value
        return _real(word)
    if hit := _RADIX.match(word):
        base = int(hit[1])
        if 2 <= base <= 36:
            try:
                value = int(hit[2], base)
            except ValueError:
                return None
            if value >> 32:
                raise PSError("limitcheck")
            return value - (1 << 32) if value >> 31 else value
        return None
    if _REAL.match(word):
        return _real(word)
    return None


def _real(word: bytes) -> float:
    try:
        return single(float(word))
    except PSError:
        raise PSError("limitcheck") from None


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    n = len(data)
    while at < n:
        c = data[at]
        at += 1
        if c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                if len(out) > MAX_STRING:
                    raise PSError("limitcheck")
                return bytes(out), at
        elif c == 0x5C:
            if at >= n:
                break
            c = data[at]
            at += 1
            if 0x30 <= c <= 0x37:
                value, k = c - 0x30, 1
                while k < 3 and at < n and 0x30 <= data[at] <= 0x37:
                    value, at, k = value * 8 + data[at] - 0x30, at + 1, k + 1
                out.append(value & 255)
            elif c in b"\r\n":
                at += c == 13 and data[at : at + 1] == b"\n"
            else:
                out.append({0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}.get(c, c))
            continue
        elif c == 13:
            at += data[at : at + 1] == b"\n"
            c = 10
        out.append(c)
    raise PSError("syntaxerror")


def token(data: bytes, at: int) -> tuple[tuple, int]:
    """(token, place behind it). A token is (kind, value): number, name, literal, immediate, string, open, close; END without a value."""
    hit = _WORD.match(data, at)
    at = hit.end()
    if word := hit[1]:
        return (_word(word) if len(word) <= 32 else _word.__wrapped__(word)), at
    if at >= len(data):
        return END, at
    c = data[at : at + 1]
    if c == b"(":
        value, at = _string(data, at + 1)
        return ("string", value), at
    if c == b")":
        raise PSError("syntaxerror")
    if c == b"{":
        return ("open", None), at + 1
    if c == b"}":
        return ("close", None), at + 1
    if c in b"[]":
        return ("name", c.decode()), at + 1
    if c == b"<":
        nxt = data[at + 1 : at + 2]
        if nxt == b"<":
            return ("name", "<<"), at + 2
        if nxt == b"~":
            value, used = codecs.ascii85_decode(data[at + 2 :])
            return ("string", value), at + 2 + used
        end = data.find(b">", at)
        if end < 0:
            raise PSError("syntaxerror")
        digits = bytes(x for x in data[at + 1 : end] if x not in SPACE)
        try:
            return ("string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))), end + 1
        except ValueError:
            raise PSError("syntaxerror") from None
    if c == b">":
        if data[at + 1 : at + 2] == b">":
            return ("name", ">>"), at + 2
        raise PSError("syntaxerror")
    kind, at = "literal", at + 1  # what is left is a slash
    if data[at : at + 1] == b"/":
        kind, at = "immediate", at + 1
    hit = _TOKEN_END.search(data, at)
    end = hit.start() if hit else len(data)
    return (kind, data[at:end].decode("latin-1")), _behind(data, end)


@lru_cache(maxsize=1 << 14)
def _word(word: bytes) -> tuple:
    """The token that a word is."""
    value = number(word)
    return ("name", word.decode("latin-1")) if value is None else ("number", value)


def _behind(data: bytes, end: int) -> int:
    """A word takes the one white space that ends it; a line end of two bytes is one."""
    if data[end : end + 2] == b"\r\n":
        return end + 2
    return end + (data[end : end + 1] in (b"\0", b"\t", b"\n", b"\f", b"\r", b" ") and end < len(data))


def tokens(data: bytes) -> Iterator[tuple[str, object, int, int, int]]:
    """(kind, value, start, end, depth) of every token of a program, and a last one of kind error if it can't be scanned."""
    at, depth = 0, 0
    while True:
        at = _SKIP.match(data, at).end()
        try:
            found, end = token(data, at)
        except PSError as e:
            yield "error", e.name, at, len(data), depth
            return
        if found is END:
            if depth:
                yield "error", "syntaxerror", at, at, depth
            return
        kind, value = found
        depth -= kind == "close"
        yield kind, value, at, end, depth
        depth += kind == "open"
        at = end
