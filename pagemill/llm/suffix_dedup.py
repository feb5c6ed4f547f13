"""Repeated byte strings across documents, found with sorted suffixes, at any size of corpus.

What a string of ``WIDTH`` bytes is compared with is settled in two steps, so that only text that occurs
again travels, and no task ever holds what grows with a string's number of copies.

1. Every window of WIDTH bytes has a least k-gram (by hash). Equal windows have equal least k-grams. Documents
   lie in blocks of some MB; each block sends its distinct k-gram hashes to the hash's bucket, which answers
   with one bit each: does it occur in another document?
2. Of the k-grams that do, a block sends the stretches of windows around them, each distinct stretch once with
   its least and greatest document id. A bucket collapses equal stretches, and sorts the suffixes of stretches
   that differ by two-stage sorting: suffixes smaller than their successors are sorted directly, the others are
   induced from them by scans over the buckets of first bytes. Adjacent suffixes with a common prefix of WIDTH
   bytes are equal windows, and the least document id of each run of them is its first occurrence. The bucket
   answers with the runs of windows that an earlier document has.

Blocks then mark the bytes of these windows. A string in a third of all documents costs a bucket one stretch
a block, not one a document.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, give_back, id_and_text, ragged_take, slices

WIDTH, GRAM = 50, 24
_SPAN = WIDTH - GRAM + 1  # k-grams of a window, and windows of a stretch at the most
_ROW = (_SPAN + WIDTH - 1 + 7) // 8 * 8  # bytes of a stretch, padded
#: Text bytes of a block on average, and blocks a bucket; windows, stretches and suffixes that are worked on at once.
BLOCK_BYTES, BUCKET_BLOCKS, STEP, STRETCHES, SORTED = 4 << 20, 2, 1 << 18, 1 << 16, 1 << 20
_PLACE = np.uint64(22)
_KEY_BITS = 42
LAST = np.int64(np.iinfo(np.int64).max)
_U = np.uint64


# -- small codecs ---------------------------------------------------------------------------------


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integers of 8 bytes as planes of bytes, which compress better, those that are all zero left out."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
        for p in planes:
            some = len(p) > 0 and bool(p.any())
            parts.append(struct.pack("<I", len(p) if some else 0))
            parts.append(p.tobytes() if some else b"")
    raw = struct.pack("<I", len(arrays[0])) + b"".join(parts)
    return struct.pack("<I", len(raw)) + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _expand(data: bytes, *kinds: str) -> list[np.ndarray]:
    """What _squeeze() has made of arrays of these types; all are as long as the first one, except an array of bytes at the end."""
    raw = pa.Codec("zstd").decompress(data[4:], decompressed_size=struct.unpack_from("<I", data)[0], asbytes=True)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for kind in map(np.dtype, kinds):
        planes = []
        for _ in range(kind.itemsize):
            size = struct.unpack_from("<I", raw, at)[0]
            planes.append(np.frombuffer(raw, np.uint8, size, at + 4) if size else None)
            at += 4 + size
        if kind.itemsize == 1:
            out.append((np.zeros(n, np.uint8) if planes[0] is None else planes[0]).view(kind))
            continue
        made = np.zeros((n, kind.itemsize), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                made[:, k] = p
        out.append(made.view(kind).reshape(-1))
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the sorted columns begins a new value."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, the first one highest; behind the end there are zeros."""
    out = data.astype(np.uint64)
    for k in (1, 2, 4):
        moved = np.zeros_like(out)
        moved[:-k] = out[k:]
        out = (out << _U(8 * k)) | moved
    return out


# -- blocks ---------------------------------------------------------------------------------------


class Block:
    """The documents of a block in the order of their ids, rows without an id last."""

    def __init__(self, blobs: list[bytes]) -> None:
        table = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end"))
        self.id_column = table.column("id").combine_chunks()
        text = table.column("text").combine_chunks()
        self.ids = np.asarray(pc.fill_null(self.id_column, int(LAST)))
        bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
        self.bounds = bounds - bounds[0]
        self._stretches()

    def _stretches(self) -> None:
        """Runs of windows with one least k-gram: first window, number of windows, key of the k-gram, document."""
        n = len(self.data)
        valid = np.zeros(n + 1, np.int8)
        long = np.diff(self.bounds) >= WIDTH
        valid[self.bounds[:-1][long]] += 1
        valid[self.bounds[1:][long] - WIDTH + 1] -= 1
        valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
        first, count, keys = [], [], []
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            if not valid[a:b].any():
                continue
            eights = _eights(self.data[a : b + WIDTH])
            h = _mix(eights)
            for k in range(8, GRAM, 8):
                moved = np.zeros_like(eights)
                moved[:-k] = eights[k:]
                h = _mix(h ^ moved)
            h = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while 2 * size <= _SPAN:
                h = np.minimum(h[:-size], h[size:]) if len(h) > size else h[:0]
                size *= 2
            if rest := _SPAN - size:
                h = np.minimum(h[:-rest], h[rest:]) if len(h) > rest else h[:0]
            good = np.flatnonzero(valid[a:b][: len(h)])
            least = h[good]
            starts = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (np.diff(good) > 1)])
            first.append(good[starts] + a)
            count.append(np.diff(np.r_[starts, len(good)]))
            keys.append(_mix(least[starts] >> _PLACE) >> _PLACE)  # least hashes are low ones; mixed again they spread over all buckets
        none = np.zeros(0, np.int64)
        self.first = np.concatenate(first) if first else none
        self.count = np.concatenate(count) if count else none
        self.keys = np.concatenate(keys) if keys else none.astype(np.uint64)
        self.owner = self.ids[np.searchsorted(self.bounds, self.first, side="right") - 1]

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys in order, and whether a key is in several documents."""
        order = np.argsort(self.keys, kind="stable")
        keys, owner = self.keys[order], self.owner[order]
        if not len(keys):
            return keys, np.zeros(0, bool)
        at = _changes(keys)
        return keys[at], np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at)

    def keep(self, shared: np.ndarray) -> None:
        """Only stretches around these keys, which are sorted, remain."""
        spot = np.minimum(np.searchsorted(shared, self.keys), max(0, len(shared) - 1))
        good = shared[spot] == self.keys if len(shared) else np.zeros(len(self.keys), bool)
        self.first, self.count, self.keys, self.owner = (x[good] for x in (self.first, self.count, self.keys, self.owner))

    def distinct_stretches(self) -> tuple[np.ndarray, ...]:
        """(number of each stretch's text, and by number: a stretch, key, least and greatest id), in the order of keys."""
        by_key = np.argsort(self.keys, kind="stable")
        keys = self.keys[by_key]
        which = np.empty(len(by_key), np.int64)
        some, least, most = [], [], []
        a = done = 0
        while a < len(by_key):  # a key's stretches stay together
            b = min(len(by_key), a + STRETCHES)
            if b < len(by_key):
                low = int(np.searchsorted(keys, keys[b], side="left"))
                b = low if low > a else int(np.searchsorted(keys, keys[b], side="right"))
            part = by_key[a:b]
            rows = padded_rows(self.data, self.first[part], self.count[part] + WIDTH - 1)
            order, number = grouped(rows, self.count[part], keys[a:b])
            at = _changes(number)
            which[part[order]] = number + done
            owner = self.owner[part[order]]
            some.append(part[order[at]])
            least.append(np.minimum.reduceat(owner, at))
            most.append(np.maximum.reduceat(owner, at))
            a, done = b, done + len(at)
        if not some:
            return which, by_key, keys, self.owner, self.owner
        which_stretch = np.concatenate(some)
        return which, which_stretch, self.keys[which_stretch], np.concatenate(least), np.concatenate(most)


def padded_rows(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[f : f + n] of each (f, n), zero-padded, as rows of 8-byte values."""
    room = np.concatenate([data, np.zeros(_ROW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(room, _ROW)[first]
    rows[np.arange(_ROW) >= sizes[:, None]] = 0
    return rows.view(np.uint64)


def grouped(rows: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key in which equal rows are adjacent, and the number of each place's row. Hashes order, bytes decide."""
    h = sizes.astype(np.uint64)
    for k in range(rows.shape[1]):
        h = _mix(h ^ rows[:, k])
    order = np.lexsort((h, keys))
    if not len(order):
        return order, order
    r, s, k, g = rows[order], sizes[order], keys[order], h[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (r[1:] != r[:-1]).any(axis=1)]
    return order, np.cumsum(new) - 1


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(_KEY_BITS - 32)) * _U(buckets) >> _U(32)).astype(np.int64)


def bucket_slices(keys: np.ndarray, buckets: int):
    """(bucket, slice) of sorted keys."""
    if not len(keys):
        return
    own = bucket_of(keys, buckets)
    at = _changes(own)
    for a, b in zip(at, [*at[1:], len(own)], strict=True):
        yield int(own[a]), slice(int(a), int(b))


# -- two-stage sorting ----------------------------------------------------------------------------


def sorted_suffixes(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Suffix array of bytes, in order by the first ``depth`` bytes at least.

    Stage one sorts the suffixes that are smaller than their successors, by eight bytes at a time while there
    are ties. Stage two goes through the buckets of first bytes in order, and puts the predecessor of each
    sorted suffix, if it is larger than that suffix, at the next free place of its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1  # the last suffix is larger than the empty one
    source = np.where(step != 0, np.arange(n), n)
    source = np.minimum.accumulate(source[::-1])[::-1]  # in a run of one byte, what follows the run decides
    small = step[source] > 0

    eights = _eights(text)
    order = np.flatnonzero(small)
    order = order[np.argsort(eights[order], kind="stable")]
    group = np.zeros(len(order), np.int64)
    if len(order):
        values = eights[order]
        group[1:] = np.cumsum(values[1:] != values[:-1])
    for at in range(8, depth + 8, 8):
        if len(order) < 2:
            break
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        place = np.flatnonzero(tied)
        if not len(place):
            break
        own = order[place]
        values = np.where(own + at < n, eights[np.minimum(own + at, n - 1)], 0)
        sub = np.lexsort((values, group[place]))
        order[place] = own[sub]
        values, was = values[sub], group[place]
        fresh = np.zeros(len(order), np.int64)
        inner = np.zeros(len(place), bool)
        inner[1:] = (values[1:] != values[:-1]) & (was[1:] == was[:-1])
        fresh[place] = inner
        group = group + np.cumsum(fresh)

    first = text[order]
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        done = []
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(front):  # larger suffixes of this bucket, then those that these induce in the bucket itself
            done.append(front)
            before = front[front > 0] - 1
            front = before[text[before] == c]
        done.append(order[edges[c] : edges[c + 1]])
        bucket = np.concatenate(done)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        letters = text[before]
        before, letters = before[letters > c], letters[letters > c]
        if len(before):
            sort = np.argsort(letters, kind="stable")
            before, letters = before[sort], letters[sort]
            at = _changes(letters)
            for a, b in zip(at, [*at[1:], len(before)], strict=True):
                waiting[letters[a]].append(before[a:b])
        waiting[c] = []
    return np.concatenate(out)


def least_of_equal_windows(text: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window of WIDTH bytes at ``starts`` the least id of the windows with the same bytes."""
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    order = sorted_suffixes(text)
    order = order[number[order] >= 0]
    eights = _eights(text)
    common = np.ones(max(0, len(order) - 1), bool)  # adjacent suffixes with a common prefix of WIDTH bytes
    for at in (*range(0, WIDTH - 7, 8), WIDTH - 8):
        values = eights[order + at]
        common &= values[1:] == values[:-1]
    run = np.flatnonzero(np.r_[True, ~common])
    which = number[order]
    least = np.minimum.reduceat(ids[which], run)
    out = np.empty(len(starts), np.int64)
    out[which] = np.repeat(least, np.diff(np.r_[run, len(order)]))
    return out


def first_documents(rows: np.ndarray, counts: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window of distinct stretches, in the order of their keys, the least id that has it."""
    out = np.repeat(ids, counts)
    ends = np.cumsum(counts)
    at = _changes(keys)
    groups = np.diff(np.r_[at, len(keys)])
    several = np.repeat(groups > 1, groups)  # a stretch alone with its key has no window in another stretch
    chosen = np.flatnonzero(several)
    if not len(chosen):
        return out
    sizes = counts[chosen] + WIDTH  # with the separator
    total = np.cumsum(sizes)
    own_keys = keys[chosen]
    a = 0
    while a < len(chosen):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + SORTED)))
        if b < len(chosen):  # a key's stretches stay together
            low = int(np.searchsorted(own_keys, own_keys[b], side="left"))
            b = low if low > a else int(np.searchsorted(own_keys, own_keys[b], side="right"))
        part = chosen[a:b]
        size = counts[part] + WIDTH - 1
        ends_here = np.cumsum(size + 1)
        text = np.full(int(ends_here[-1]), 255, np.uint8)  # a byte that UTF-8 has not, between the stretches
        starts = ends_here - size - 1
        spread = np.repeat(starts, size) + _ramp(size)
        text[spread] = rows[part].view(np.uint8)[np.repeat(np.arange(len(part)), size), _ramp(size)]
        windows = np.repeat(starts, counts[part]) + _ramp(counts[part])
        least = least_of_equal_windows(text, windows, np.repeat(ids[part], counts[part]))
        out[np.repeat(ends[part] - counts[part], counts[part]) + _ramp(counts[part])] = least
        a = b
    return out


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _running(flags: np.ndarray) -> np.ndarray:
    """Number of flags set before each place and at the end."""
    out = np.zeros(len(flags) + 1, np.int64 if len(flags) >> 31 else np.int32)
    np.cumsum(flags, out=out[1:])
    return out


# -- the steps as functions of groups -------------------------------------------------------------


def frugal(fn):
    """``fn`` in a worker that gives memory back after each group; several workers of an executor wait for work at a time."""

    @functools.wraps(fn)
    def run(*args):
        pa.set_memory_pool(pa.system_memory_pool())
        out = fn(*args)
        give_back()
        return out

    return run


def _blobs(table: pa.Table) -> list[bytes]:
    return table.column("data").to_pylist()


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["to", "of", "data"])


SENT = "to long, of long, data binary"


@frugal
def send_keys(table: pa.Table, buckets: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    keys, several = Block(_blobs(table)).distinct_keys()
    return _rows([(k, block, _squeeze(np.diff(keys[s], prepend=_U(0)), np.packbits(several[s]))) for k, s in bucket_slices(keys, buckets)])


@frugal
def answer_keys(table: pa.Table) -> pa.Table:
    bucket = table.column("to")[0].as_py()
    blocks, parts, flags = table.column("of").to_pylist(), [], []
    for data in _blobs(table):
        gaps, bits = _expand(data, "u8", "u1")
        parts.append(np.cumsum(gaps, dtype=np.uint64))
        flags.append(np.unpackbits(bits, count=len(gaps)).astype(bool))
    keys, several = np.concatenate(parts), np.concatenate(flags)
    order = np.argsort(keys, kind="stable")
    at = _changes(keys[order])
    sizes = np.diff(np.r_[at, len(keys)])
    shared = np.empty(len(keys), bool)
    shared[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(several[order], at), sizes)
    edges = np.cumsum([0, *map(len, parts)])
    return _rows([(b, bucket, _squeeze(np.packbits(shared[x:y]))) for b, x, y in zip(blocks, edges[:-1], edges[1:], strict=True)])


def _shared(block: Block, answers: pa.Table, buckets: int) -> None:
    keys, _ = block.distinct_keys()
    bits = dict(zip(answers.column("of").to_pylist(), _blobs(answers), strict=True))
    keep = np.zeros(len(keys), bool)
    for k, s in bucket_slices(keys, buckets):
        keep[s] = np.unpackbits(_expand(bits[k], "u1")[0], count=s.stop - s.start).astype(bool)
    block.keep(keys[keep])


@frugal
def send_stretches(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not table.num_rows:
        return _rows([])
    number = table.column("block")[0].as_py()
    block = Block(_blobs(table))
    _shared(block, answers, buckets)
    _, some, keys, least, most = block.distinct_stretches()
    out = []
    for k, s in bucket_slices(keys, buckets):
        part = some[s]
        sizes = block.count[part] + WIDTH - 1
        text = ragged_take(block.data, block.first[part], sizes)
        out.append((k, number, _squeeze(np.diff(keys[s], prepend=_U(0)), np.diff(least[s], prepend=0), most[s] - least[s], sizes.astype(np.uint8), text)))
    return _rows(out)


@frugal
def answer_stretches(table: pa.Table) -> pa.Table:
    bucket = table.column("to")[0].as_py()
    blocks = table.column("of").to_pylist()
    gaps, lows, spans, sizes, texts = zip(*(_expand(x, "u8", "i8", "i8", "u1", "u1") for x in _blobs(table)), strict=True)
    lengths = np.array([len(x) for x in gaps])
    keys = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in gaps])
    least = np.concatenate([np.cumsum(x) for x in lows])
    most = least + np.concatenate(spans)
    sizes = np.concatenate(sizes).astype(np.int64)
    counts, text = sizes - WIDTH + 1, np.concatenate(texts)
    rows = padded_rows(text, np.cumsum(sizes) - sizes, sizes)
    order, number = grouped(rows, counts, keys)
    at = _changes(number)
    low = np.minimum.reduceat(least[order], at)
    some = order[at]
    first = first_documents(rows[some], counts[some], keys[some], low)
    # runs of windows of a distinct stretch that have one first document
    own = np.repeat(np.arange(len(some)), counts[some])
    place = _ramp(counts[some])
    begin = _changes(own, first)
    run_of, run_first, run_at = own[begin], first[begin], place[begin]
    run_n = np.diff(np.r_[begin, len(own)])
    edges = np.searchsorted(run_of, np.arange(len(some) + 1))
    which = np.empty(len(order), np.int64)
    which[order] = number
    runs = np.diff(edges)[which]
    entry = np.repeat(np.arange(len(which)), runs)
    run = np.repeat(edges[:-1][which], runs) + _ramp(runs)
    good = run_first[run] < most[entry]  # else no document of that block is later
    entry, run = entry[good], run[good]
    out, ends = [], np.cumsum(lengths)
    for block, x, y in zip(blocks, ends - lengths, ends, strict=True):
        a, b = np.searchsorted(entry, (x, y))
        if a < b:
            r = run[a:b]
            out.append((block, bucket, _squeeze(np.diff(entry[a:b] - x, prepend=0), run_at[r].astype(np.uint8), run_n[r].astype(np.uint8), run_first[r])))
    return _rows(out)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@frugal
def cut_out(table: pa.Table, answers: pa.Table, buckets: int, id_col: str, with_text: bool) -> pa.Table:
    names = [id_col, *(c.split()[0] for c in RESULT.split(", ")), *["kept"] * with_text]
    block = Block(_blobs(table)) if table.num_rows else None
    if block is None:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text]
        return pa.table([pa.array([], k) for k in kinds], names=names)
    kind = answers.column("kind")
    _shared(block, answers.filter(pc.equal(kind, 0)), buckets)
    which, _, keys, _, _ = block.distinct_stretches()
    offset = {k: s.start for k, s in bucket_slices(keys, buckets)}
    change = np.zeros(len(block.data) + 1, np.int32)
    told = answers.filter(pc.equal(kind, 1))
    parts = []
    for bucket, data in zip(told.column("of").to_pylist(), _blobs(told), strict=True):
        gaps, at, n, first = _expand(data, "i8", "u1", "u1", "i8")
        parts.append((np.cumsum(gaps) + offset[bucket], at.astype(np.int64), n.astype(np.int64), first))
    if parts:
        entry, at, n, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(entry, kind="stable")
        entry, at, n, first = entry[order], at[order], n[order], first[order]
        edges = np.searchsorted(entry, np.arange(len(keys) + 1))
        runs = np.diff(edges)[which]  # of each place where a stretch stands
        stretch = np.repeat(np.arange(len(which)), runs)
        run = np.repeat(edges[:-1][which], runs) + _ramp(runs)
        later = first[run] < block.owner[stretch]
        stretch, run = stretch[later], run[later]
        start = block.first[stretch] + at[run]
        np.add.at(change, start, 1)
        np.add.at(change, start + n[run] + WIDTH - 1, -1)
    covered = np.cumsum(change[:-1], dtype=np.int32) > 0
    a, b = block.bounds[:-1], block.bounds[1:]
    removed = _running(covered)
    starts = covered.copy()
    starts[1:] &= ~covered[:-1]
    inner = a[(a < b) & (a < len(covered))]
    starts[inner] = covered[inner]
    spans = _running(starts)
    kept = block.data[~covered].tobytes()
    left = (b - a) - (removed[b] - removed[a])
    ends = np.cumsum(left)
    texts = [kept[y - n : y] for y, n in zip(ends.tolist(), left.tolist(), strict=True)]
    columns = [block.id_column, pa.array(b - a), pa.array((removed[b] - removed[a]).astype(np.int64)), pa.array((spans[b] - spans[a]).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
    return pa.table(columns + [pa.array(texts, pa.binary())] * with_text, names=names)


# -- the operator ---------------------------------------------------------------------------------


def blocks_of(df: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(block, data): each document in the block of its id's hash (its text's if it has no id), packed by block where it was read."""

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part in slices(batch, text_col):
                ids = part.column(id_col)
                own = np.asarray(pc.fill_null(ids, 0)).astype(np.uint64)
                for at in np.flatnonzero(np.asarray(pc.is_null(ids))):  # rows without an id are spread by their texts
                    own[at] = int.from_bytes(hashlib.md5(part.column(text_col)[int(at)].as_buffer()).digest()[:8], "little")
                own = (_mix(own) % _U(blocks)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                own = own[order]
                moved = pa.table([ids, part.column(text_col).cast(pa.large_binary())], names=["id", "text"]).take(pa.array(order))
                at, data = _changes(own), []
                for a, b in zip(at, [*at[1:], len(own)], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, moved.schema, options=options) as out:
                        out.write_table(moved.slice(a, b - a).combine_chunks())
                    data.append(sink.getvalue().to_pybytes())
                yield pa.record_batch([pa.array(own[at]), pa.array(data, pa.binary())], names=["block", "data"])

    return id_and_text(df, id_col, text_col).mapInArrow(pack, "block long, data binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each document; ``with_text`` adds the kept bytes.

    A byte is removed if a string of WIDTH bytes over it also starts in a document with a smaller id. Texts are
    UTF-8 bytes; a null text is empty, and so is the digest of its bytes. A null id counts as greater than every
    id. Rows with the same id are one document for each other: none removes from another. Texts shorter than
    WIDTH lose nothing.

    Documents are shuffled by block, packed, once for each of the two steps; besides them keys, bits, stretches and
    answers travel. The numbers of blocks and of buckets follow the bytes of text; a bucket has the keys of BUCKET_BLOCKS blocks.
    """
    spark = attach(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-total // block_bytes))
    buckets = max(spark.sparkContext.defaultParallelism, -(-blocks // BUCKET_BLOCKS))
    parted = blocks_of(df, id_col, text_col, blocks)
    keys = parted.groupBy("block").applyInArrow(lambda t: send_keys(t, buckets), SENT)
    bits = keys.groupBy("to").applyInArrow(lambda t: answer_keys(t), SENT).withColumnRenamed("to", "block").checkpoint()
    stretches = parted.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(lambda t, a: send_stretches(t, a, buckets), SENT)
    told = stretches.groupBy("to").applyInArrow(lambda t: answer_stretches(t), SENT).withColumnRenamed("to", "block")
    answers = bits.withColumn("kind", F.lit(0)).unionByName(told.withColumn("kind", F.lit(1)))
    result = f"`{id_col}` long, {RESULT}" + ", kept binary" * with_text
    return parted.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: cut_out(t, a, buckets, id_col, with_text), result)
