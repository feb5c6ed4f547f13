"""Media columns: signature sniffing, validation, type correction and carving.

One Aho-Corasick pass finds every magic string in a value; a validator for its format then walks the
structure (chunks, blocks, pages, sizes, checksums) and gives the length, or refuses it. What validates at
offset 0 over the whole value corrects a declared type; what validates elsewhere is carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, id_and_text, map_batches, slices

# Magic strings of the formats.
MAGIC = {
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/jpeg": b"\xff\xd8\xff",
    "image/gif": b"GIF8",
    "image/bmp": b"BM",
    "image/x-portable-graymap": b"P5\n",
    "riff": b"RIFF",
    "audio/basic": b".snd",
    "audio/ogg": b"OggS",
    "application/pdf": b"%PDF-",
    "application/gzip": b"\x1f\x8b\x08",
}


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p, frames = at + 2, 0
    while p + 2 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return ("image/jpeg", p + 2 - at) if frames else None
        if p + 4 > len(b):
            return None
        size = struct.unpack_from(">H", b, p + 2)[0]
        if kind < 0xC0 or size < 2:
            return None
        frames += 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        while kind == 0xDA:  # entropy-coded data runs up to a marker that is neither stuffing nor a restart
            p = b.find(b"\xff", p)
            if p < 0 or p + 1 >= len(b):
                return None
            if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                break
            p += 2
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1)) * (b[at + 10] >> 7)
    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 10 + (3 << ((b[p + 9] & 7) + 1)) * (b[p + 9] >> 7) + 1)
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 54 > len(b):
        return None
    size, spare, data, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if spare or head < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not 54 <= data <= size:
        return None
    fits = data + (width * bits + 31) // 32 * 4 * abs(height) <= size <= len(b) - at
    return ("image/bmp", size) if fits else None


def _graymap(b: bytes, at: int) -> tuple[str, int] | None:
    parts = b[at : at + 60].split(b"\n", 3)
    sizes = parts[1].split() if len(parts) == 4 else []
    if len(sizes) != 2 or not all(x.isdigit() for x in (*sizes, parts[2])) or not 0 < int(parts[2]) < 256:
        return None
    n = sum(map(len, parts[:3])) + 3 + int(sizes[0]) * int(sizes[1])
    return ("image/x-portable-graymap", n) if at + n <= len(b) else None


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}.get(form)
    p, end = at + 12, at + 8 + size
    if not kind or end > len(b):
        return None
    while p + 8 <= end:
        p += 8 + (n := struct.unpack_from("<I", b, p + 4)[0]) + n % 2
    return (kind, end - at) if p == end else None


def _au(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 24 > len(b):
        return None
    head, size, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    good = 24 <= head and 1 <= code <= 27 and rate and 0 < channels < 256 and at + head + size <= len(b)
    return ("audio/basic", head + size) if good else None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    p, last = at, False
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        last = bool(b[p + 5] & 4)
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if last:
            break
    return ("audio/ogg", p - at) if last and p <= len(b) else None


class Data(bytes):
    """Bytes in which no stretch is searched twice for a mark."""

    def next(self, mark: bytes, at: int) -> int:
        """The first place of the mark at or after ``at``, or -1; asked with rising places."""
        near = self.__dict__.setdefault("near", {})
        start, found = near.get(mark, (0, -2))
        if not (start <= at and (found == -1 or at <= found)):
            near[mark] = at, (found := self.find(mark, at))
        return found


def _pdf(b: Data, at: int) -> tuple[str, int] | None:
    if not b[at + 5 : at + 6].isdigit() or (end := b.next(b"%%EOF", at)) < 0 or not 0 <= b.next(b"startxref", at) < end:
        return None
    return "application/pdf", end + 5 - at


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    left = memoryview(b)[at:]
    try:
        while left and not d.eof:
            d.decompress(left, 1 << 20)
            left = d.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", len(b) - at - len(d.unused_data)) if d.eof else None


CHECKS = dict(zip(MAGIC, (_png, _jpeg, _gif, _bmp, _graymap, _riff, _au, _ogg, _pdf, _gzip), strict=True))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every validated medium; none inside another one that starts before it."""
    data = Data(data)
    out, free = [], 0
    for end, (kind, n) in automaton().iter(data.decode("latin-1")):
        at = end + 1 - n
        if at >= free and (hit := CHECKS[kind](data, at)):
            out.append((hit[0], at, hit[1]))
            free = at + hit[1]
    return out


SNIFFED = "declared string, actual string, corrected boolean, media array<struct<type:string,offset:bigint,length:bigint,sha256:string>>"


def sniff_column(df: DataFrame, id_col: str, bytes_col: str, declared_col: str) -> DataFrame:
    """(id, declared, actual, corrected, media) of a binary column.

    ``actual`` is the type that spans the whole value, else the declared one; ``corrected`` says that they
    differ. ``media`` lists each validated medium with its place and digest, in order. A null or empty value
    has no media and keeps its declared type, which may be null.
    """
    attach(df.sparkSession)
    kept = df.select(
        F.col(id_col), F.coalesce(F.col(bytes_col).cast("binary"), F.lit(b"")).alias("data"), F.col(declared_col).cast("string").alias("declared")
    )

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "data"):
            rows = []
            for data, declared in zip(part.column("data").to_pylist(), part.column("declared").to_pylist(), strict=True):
                found = sniff(data)
                actual = found[0][0] if found and found[0][1:] == (0, len(data)) else declared
                media = [{"type": k, "offset": a, "length": n, "sha256": hashlib.sha256(data[a : a + n]).hexdigest()} for k, a, n in found]
                rows.append({"declared": declared, "actual": actual, "corrected": actual != declared, "media": media})
            kind = pa.schema([("declared", pa.string()), ("actual", pa.string()), ("corrected", pa.bool_()), ("media", pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])))])
            made = pa.RecordBatch.from_pylist(rows, schema=kind)
            yield pa.record_batch([part.column(0), *made.columns], names=[id_col, *kind.names])

    return map_batches(kept, run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {SNIFFED}")


#: Every stored format takes whole rows of this many 8-bit samples.
ROW = 192


def padded(text: bytes) -> bytes:
    """The text and blanks up to a positive multiple of ROW."""
    return text + b" " * (-len(text) % ROW if text else ROW)


def store(payload: bytes) -> tuple[str, bytes]:
    """Declared type and file of a payload: WAV, BMP, graymap or PNG by the payload's checksum, all lossless."""
    kind, n = zlib.crc32(payload) % 4, len(payload)
    if kind == 0:
        chunk = payload + b"\0" * (n % 2)
        return "audio/wav", b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(chunk), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + chunk
    if kind == 1:
        return "image/bmp", b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + n, 0, 54, 40, ROW // 3, -(n // ROW), 1, 24, 0, n, 0, 0, 0, 0) + payload
    if kind == 2:
        return "image/x-portable-graymap", b"P5\n%d %d\n255\n" % (ROW, n // ROW) + payload
    lines = np.zeros((n // ROW, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", ROW, n // ROW, 8, 0, 0, 0, 0)
    return "image/png", MAGIC["image/png"] + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


def samples(kind: str, data: bytes) -> bytes:
    """The 8-bit samples of a file that store() made, read by the type that was sniffed."""
    if kind == "audio/wav":
        return data[44 : 44 + struct.unpack_from("<I", data, 40)[0]]
    if kind == "image/bmp":
        return data[struct.unpack_from("<I", data, 10)[0] :]
    if kind == "image/x-portable-graymap":
        return data.split(b"\n", 3)[3]
    if kind == "image/png":
        p, body = 8, b""
        while p < len(data):
            size, name = struct.unpack_from(">I4s", data, p)
            body += data[p + 8 : p + 8 + size] if name == b"IDAT" else b""
            p += 12 + size
        return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()
    raise ValueError(f"no reader for {kind}")


def features(kind: str, payload: bytes) -> str:
    """Type, number, mean, deviation and entropy of the samples, and the media carved from them."""
    seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = seen / len(payload)
    mean = float(share @ np.arange(256))
    spread = float(np.sqrt(share @ (np.arange(256) - mean) ** 2))
    bits = float(-(share[share > 0] * np.log2(share[share > 0])).sum()) + 0.0
    carved = ",".join(f"{k}@{a}+{n}" for k, a, n in sniff(payload))
    return f"{kind};n={len(payload)};mean={mean:.4f};std={spread:.4f};entropy={bits:.4f};carved={carved}"


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, actual string, corrected boolean"


def media_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a medium under an unspecific declared type, sniffed, read back and described.

    A null text is empty and is stored as one row of blanks. Equal texts have equal values, whatever their
    ids; rows repeat as they come in. No shuffle.
    """
    attach(df.sparkSession)
    declared = "application/octet-stream"

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            rows = []
            for doc, text in zip(part.column(id_col).to_pylist(), part.column(text_col).cast(pa.binary()).to_pylist(), strict=True):
                _, stored = store(padded(text))
                kind, at, size = next(iter(sniff(stored)), (declared, 0, 0))
                back = samples(kind, stored[at : at + size])
                rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(kind, back), declared, kind, kind != declared))
            names = [id_col, *(c.split()[0] for c in COLUMNS.split(", "))]
            yield pa.record_batch([pa.array(c, pa.int64()) if i in (0, 1, 2, 4, 5) else pa.array(c) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    return map_batches(id_and_text(df, id_col, text_col), run, f"`{id_col}` long, {COLUMNS}")
