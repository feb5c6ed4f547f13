"""Byte codecs of the page language. A decoder returns (bytes, bytes of the input that it took)."""

from __future__ import annotations

import binascii
import zlib
from functools import lru_cache

import numpy as np


class BadData(ValueError):
    """Data that a codec can't read."""


SPACE = frozenset(b"\0\t\n\f\r ")
_SPACE = bytes(SPACE)


def ascii_hex_decode(data: bytes) -> tuple[bytes, int]:
    end = data.find(b">")
    body, used = (data, len(data)) if end < 0 else (data[:end], end + 1)
    digits = body.translate(None, _SPACE)
    try:
        return binascii.unhexlify(digits + b"0" * (len(digits) % 2)), used
    except ValueError:
        raise BadData("not a hexadecimal digit") from None


def ascii_hex_encode(data: bytes) -> bytes:
    return binascii.hexlify(data, b"\n", -32).upper() + b">"


def ascii85_decode(data: bytes) -> tuple[bytes, int]:
    end = data.find(b"~>")
    body, used = (data, len(data)) if end < 0 else (data[:end], end + 2)
    out = []
    digits = body.translate(None, _SPACE)
    parts = digits.split(b"z") if b"z" in digits else [digits]
    for i, part in enumerate(parts):
        # a z stands for a whole group, and only between groups
        if i + 1 < len(parts) and len(part) % 5:
            raise BadData("not a base-85 digit")
        out.append(b"".join(_from85(part[k : k + 5 * GROUPS]) for k in range(0, len(part), 5 * GROUPS)))
    return b"\0\0\0\0".join(out), used


#: Groups of base 85 that are worked on at once; an array of them takes twenty times their bytes.
GROUPS = 1 << 15
_POWERS = 85 ** np.arange(4, -1, -1, dtype=np.int64)


def _from85(digits: bytes) -> bytes:
    rest = len(digits) % 5
    five = np.frombuffer(digits + b"u" * (-len(digits) % 5), np.uint8).astype(np.int64).reshape(-1, 5) - 33
    if five.size and (five.min() < 0 or five.max() > 84):
        raise BadData("not a base-85 digit")
    values = five @ _POWERS
    whole = values[:-1] if rest else values
    if whole.size and whole.max() >> 32:
        raise BadData("a group beyond 32 bits")
    if rest == 1:
        raise BadData("a last group of one digit")
    made = (values & 0xFFFFFFFF).astype(">u4").tobytes()
    return made[: len(made) - 5 + rest] if rest else made


def ascii85_encode(data: bytes) -> bytes:
    digits = b"".join(_to85(data[k : k + 4 * GROUPS]) for k in range(0, len(data), 4 * GROUPS))
    return b"\n".join(bytes(digits[i : i + 75]) for i in range(0, len(digits), 75)) + b"~>"


def _to85(data: bytes) -> bytes:
    missing = -len(data) % 4
    values = np.frombuffer(bytes(data) + b"\0" * missing, ">u4").astype(np.int64)
    digits = (values[:, None] // _POWERS % 85 + 33).astype(np.uint8)
    zeros = np.flatnonzero(values[: len(data) // 4] == 0)
    if len(zeros):
        digits[zeros, 0] = 0x7A
        kept = np.ones(digits.shape, bool)
        kept[zeros, 1:] = False
        digits = digits[kept]
    digits = digits.tobytes()
    return digits[: len(digits) - missing]


def run_length_decode(data: bytes) -> tuple[bytes, int]:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n == 128:
            break
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        else:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out), min(at, len(data))


def run_length_encode(data: bytes, record: int = 0) -> bytes:
    """Runs and literals never cross a record's end; record 0 is one record."""
    out = bytearray()
    record = record or max(1, len(data))
    for begin in range(0, len(data), record):
        part, at = data[begin : begin + record], 0
        literal = bytearray()
        while at < len(part):
            n = 1
            while n < 128 and at + n < len(part) and part[at + n] == part[at]:
                n += 1
            if n > 2 or n == 2 and not literal:
                if literal:
                    out += bytes([len(literal) - 1]) + literal
                    literal.clear()
                out += bytes([257 - n, part[at]])
            else:
                for c in part[at : at + n]:
                    literal.append(c)
                    if len(literal) == 128:
                        out += b"\x7f" + literal
                        literal.clear()
            at += n
        if literal:
            out += bytes([len(literal) - 1]) + literal
    return bytes(out + b"\x80")


def flate_decode(data: bytes) -> tuple[bytes, int]:
    inflate = zlib.decompressobj()
    try:
        out = inflate.decompress(data) + inflate.flush()
    except zlib.error:
        raise BadData("not a compressed stream") from None
    return out, len(data) - len(inflate.unused_data)


def flate_encode(data: bytes) -> bytes:
    return zlib.compress(data, 9)


CLEAR, STOP = 256, 257


_CODES = 4096
_SINGLE = [bytes([x]) for x in range(256)] + [b"", b""]


@lru_cache(maxsize=2)
def _lzw_widths(early: int) -> np.ndarray:
    """Bits of the k-th code after a clearing, for as many as a full table has; all later ones have 12."""
    known = np.maximum(np.arange(_CODES), 1) + 257 + early  # a reader's table is one entry behind the writer's
    return np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, 9, 12)


def lzw_decode(data: bytes, early: int = 1) -> tuple[bytes, int]:
    """(what the codes stand for, bytes read); codes are cut out of the bits many at a time."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, bit, out = 8 * len(data), 0, []
    widths, k = _lzw_widths(early), 0
    table, before = list(_SINGLE), None
    while True:
        size = widths[k:] if k < _CODES else np.full(_CODES, 12)
        ends = bit + np.cumsum(size)
        n = int(np.searchsorted(ends, total, side="right"))
        ends, size = ends[:n], size[:n]
        first = (ends - size) >> 3
        held = raw[first] << 16 | raw[first + 1] << 8 | raw[first + 2]
        codes = held >> (24 - (ends - 8 * first)) & ((1 << size) - 1)
        marks = np.flatnonzero((codes == CLEAR) | (codes == STOP))
        upto = int(marks[0]) if len(marks) else n
        for code in codes[:upto].tolist():
            if before is None:
                if code > 255:
                    raise BadData("a first code beyond the bytes")
                before = table[code]
            else:
                if code < len(table):
                    word = table[code]
                elif code == len(table):
                    word = before + before[:1]
                else:
                    raise BadData("a code that isn't defined yet")
                if len(table) < _CODES:
                    table.append(before + word[:1])
                before = word
            out.append(before)
        if upto < n:
            bit = int(ends[upto])
            if codes[upto] == STOP:
                return b"".join(out), (bit + 7) >> 3
            table, before, k = list(_SINGLE), None, 0
        elif n < len(widths[k:] if k < _CODES else range(_CODES)):
            return b"".join(out), len(data)
        else:
            bit, k = int(ends[-1]), _CODES


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    codes, counts = [CLEAR], []  # codes after each clearing, with the one that ends them
    table: dict[int, int] = {}
    begun, code, fresh = 1, -1, 258
    for c in data:
        if code < 0:
            code = c
            continue
        key = code << 8 | c
        if (longer := table.get(key)) is not None:
            code = longer
            continue
        codes.append(code)
        table[key] = fresh
        fresh += 1
        if fresh >= _CODES - 1:
            codes.append(CLEAR)
            counts.append(len(codes) - begun)
            begun = len(codes)
            table.clear()
            fresh = 258
        code = c
    if code >= 0:
        codes.append(code)
    codes.append(STOP)
    counts.append(len(codes) - begun)
    widths = np.concatenate([[9], *(_lzw_widths(early)[:n] for n in counts)])
    starts = np.cumsum(widths) - widths
    bits = np.zeros(int(widths.sum()), np.uint8)
    every = np.array(codes)
    for width in range(9, 13):
        which = np.flatnonzero(widths == width)
        bits[starts[which][:, None] + np.arange(width)] = every[which][:, None] >> np.arange(width - 1, -1, -1) & 1
    return np.packbits(bits).tobytes()


def unpredicted(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undoes the horizontal difference (2) or the row filters (10 to 15) of image data."""
    if predictor < 2:
        return data
    row = (colors * bits * columns + 7) // 8
    step = max(1, colors * bits // 8)
    if predictor == 2:
        if bits != 8:
            raise BadData("differences of 8-bit samples only")
        whole = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(whole, axis=1, dtype=np.uint8).tobytes() + data[len(data) // row * row :]
    out, before = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], np.zeros(row, np.uint8)
        part = np.frombuffer(data[at + 1 : at + 1 + row], np.uint8)
        line[: len(part)] = part
        if kind == 2:
            line = line + before
        elif kind in (1, 3, 4):
            now = line.astype(int).tolist()
            up = before.tolist()
            for i in range(row):
                left, corner = (now[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 1:
                    add = left
                elif kind == 3:
                    add = (left + up[i]) // 2
                else:
                    guess = left + up[i] - corner
                    add = min((left, up[i], corner), key=lambda v, g=guess: abs(g - v))
                now[i] = now[i] + add & 255
            line = np.array(now, np.uint8)
        elif kind:
            raise BadData("no such row filter")
        before = line
        out += line[: len(part)].tobytes()
    return bytes(out)


def predicted(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Applies the horizontal difference (2) or the row filter of differences to the row above (10 and more)."""
    if predictor < 2:
        return data
    row = (colors * bits * columns + 7) // 8
    if predictor == 2:
        if bits != 8:
            raise BadData("differences of 8-bit samples only")
        whole = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors)
        return np.diff(whole, axis=1, prepend=np.zeros((len(whole), 1, colors), np.uint8)).astype(np.uint8).tobytes() + data[len(data) // row * row :]
    out, before = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data), row):
        line = np.frombuffer(data[at : at + row], np.uint8)
        out += b"\x02" + (line - before[: len(line)]).tobytes()
        before = np.pad(line, (0, row - len(line)))
    return bytes(out)


def sub_file_decode(data: bytes, count: int, bound: bytes) -> tuple[bytes, int]:
    """Up to the bound's occurrence after ``count`` others, or ``count`` bytes without a bound."""
    if not bound:
        n = len(data) if not count else count
        return data[:n], min(n, len(data))
    at = 0
    for _ in range(count):
        hit = data.find(bound, at)
        if hit < 0:
            return data, len(data)
        at = hit + len(bound)
    hit = data.find(bound, at)
    if hit < 0:
        return data, len(data)
    if count:
        return data[:at], at
    return data[:hit], hit + len(bound)


# Constants of the cipher of font programs.
C1, C2 = 52845, 22719
EEXEC_KEY, CHARSTRING_KEY = 55665, 4330


def cipher_decode(data: bytes, key: int, skip: int = 4) -> bytes:
    out = bytearray()
    for c in data:
        out.append(c ^ key >> 8)
        key = (c + key) * C1 + C2 & 0xFFFF
    return bytes(out[skip:])


def cipher_encode(data: bytes, key: int, lead: bytes = b"\0\0\0\0") -> bytes:
    out = bytearray()
    for c in lead + data:
        c ^= key >> 8
        out.append(c)
        key = (c + key) * C1 + C2 & 0xFFFF
    return bytes(out)


def jpeg_length(data: bytes) -> int:
    """Bytes up to and including the end marker, found by walking the markers; all if there is none."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return len(data)
        kind = data[at + 1]
        if kind == 0xD9:
            return at + 2
        if kind == 0xFF:
            at += 1
            continue
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA:
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    return len(data)
                if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2
    return at + 2 if data[at : at + 2] == b"\xff\xd9" else len(data)


def encoded_numbers(data: bytes) -> list[float] | None:
    """The numbers of an encoded number string: 149, representation, count; None if it isn't one."""
    if len(data) < 4 or data[0] != 149:
        return None
    kind = data[1]
    big = kind < 128
    n = int.from_bytes(data[2:4], "big" if big else "little")
    kind &= 127
    order = ">" if big else "<"
    if kind < 32:
        dtype, scale = order + "i4", kind
    elif kind < 48:
        dtype, scale = order + "i2", kind - 32
    elif kind == 48:
        dtype, scale = order + "f4", None
    else:
        return None
    size = np.dtype(dtype).itemsize
    if len(data) < 4 + n * size:
        return None
    values = np.frombuffer(data, dtype, n, 4)
    return values.astype(float).tolist() if scale is None else [int(v) if not scale else float(v) / (1 << scale) for v in values]
