"""Harmonic packing of token sequences into rows of a fixed length.

A document's ids are cut into pieces: whole rows first, then the largest power of two that is left, down to
``SMALL`` ids; the rest below that is one piece. A piece of n ids belongs to the reciprocal class
k = capacity // n, and a bin of class k takes exactly k pieces. Pieces cut at a power of two fill their bins
without a gap, and a bin of class k with short pieces has less than n / k ids free for each piece. Every
worker fills its own bins of each class while it reads, so workers never wait for one another, and what is
open in a worker at the end is cut into full rows and rows of a power of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import attach, id_and_text, ragged_take, slices

SMALL = 64
#: Words whose ids a worker keeps between batches, and bytes of the longest; bound its memory only.
KEPT_WORDS, KEPT_BYTES = 400_000, 64
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


#: Bytes of text that are encoded at once; more share their words better and take more memory.
PART_BYTES = 6 << 20
WORDS_AT_ONCE = 1000
#: What the words of a text are under: other vocabularies get whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Kinds of bytes: white space, letters, digits, marks, and what only the library may cut.
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)


class ChunkEncoder:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    White space ends a chunk, and no token spans it. Chunks of characters that stand for themselves after the
    normaliser (ASCII, and of two bytes those that the library confirms) are cut into words where letters,
    digits and marks meet, all texts at once; other chunks (contractions, special strings, combining marks)
    are words as they stand. Distinct words that aren't kept go through the library: cut ones many in a call,
    without the normaliser and pattern that would change nothing, and told apart by the tokens that end a word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec["added_tokens"]
        self.cuts = bool(spec["model"].get("end_of_word_suffix")) and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        self.cuts &= all(len(t["content"]) > 1 and t["content"].isascii() and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        if self.cuts:
            self._tables(spec["model"]["vocab"], spec["model"]["end_of_word_suffix"], [t["content"] for t in added])
        self.words, self.ids = pa.array([], pa.large_binary()), np.zeros(0, np.uint32)
        self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _tables(self, vocab: dict[str, int], suffix: str, special: list[str]) -> None:
        """Kind and lower case of each byte and of each character of two bytes, as the library has them; tokens that end a word."""
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.special = {tuple(s.encode()[:2]) for s in special}
        normal, cut = self.whole.normalizer.normalize_str, self.whole.pre_tokenizer.pre_tokenize_str
        self.kinds, self.lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
        self.pair_kinds, self.pair_lower = np.full(2048, OTHER, np.uint8), np.zeros((2048, 2), np.uint8)
        self.letters, self.quoted = np.zeros(256, np.uint16), np.zeros(256, bool)
        self.quoted[list(b"strvmldSTRVMLD")] = True
        self.kinds[list(b" \n")] = BLANK
        for code in range(33, 2048):
            c = chr(code)
            low = normal(c)
            if unicodedata.category(c)[0] in "CMZ" or len(low) != 1 or len(low.encode()) != len(c.encode()) or normal(f"a{c}a") != f"a{low}a" or normal(f"a{c}") != f"a{low}":
                continue
            kind = LETTER if len(cut(f"a{low}a")) == 1 else MARK if len(cut(f"!{low}!")) == 1 else DIGIT
            if code < 128:
                self.kinds[code], self.lower[code] = kind, ord(low)
            elif kind != DIGIT:
                self.pair_kinds[code], self.pair_lower[code] = kind, list(low.encode())
        # the vocabulary's letters for bytes: themselves if printable, else from 256 on; a blank stays between words
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted({*range(256)} - {*printable})
        self.letters[printable], self.letters[hidden] = printable, range(256, 256 + len(hidden))
        self.letters[ord(" ")] = ord(" ")

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words of all texts, which of them are chunks as they stand, bounds by text)."""
        texts = texts.cast(pa.large_string())
        texts.validate(full=True)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        kind, low = self.kinds[raw], self.lower[raw]
        two = np.flatnonzero((raw >= 0xC0) & (raw < 0xE0))
        code = ((raw[two] & 0x1F).astype(np.int64) << 6) | (raw[two + 1] & 0x3F)
        known = self.pair_kinds[code] != OTHER
        two, code = two[known], code[known]
        kind[two] = kind[two + 1] = self.pair_kinds[code]
        low[two], low[two + 1] = self.pair_lower[code, 0], self.pair_lower[code, 1]
        quotes = np.flatnonzero(raw[:-1] == ord("'"))
        kind[quotes[self.quoted[raw[quotes + 1]]]] = OTHER
        for a, b in self.special:
            kind[:-1][(raw[:-1] == a) & (raw[1:] == b)] = OTHER
        begins = np.zeros(len(raw) + 1, bool)
        begins[at] = True
        filled = kind != BLANK
        first = filled.copy()
        first[1:] &= ~filled[:-1] | begins[1:-1]
        unit = filled.copy()
        unit[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | begins[1:-1]
        chunks = np.flatnonzero(first)
        whole = np.zeros(len(raw), bool)
        if len(chunks):
            odd = np.logical_or.reduceat(kind == OTHER, chunks)
            if odd.any():
                last = filled.copy()
                last[:-1] &= ~filled[1:] | begins[1:-1]
                steps = np.zeros(len(raw) + 1, np.int8)
                steps[chunks[odd]] = 1
                steps[np.flatnonzero(last)[odd] + 1] -= 1
                whole = np.cumsum(steps[:-1], dtype=np.int8).view(bool)
                unit[whole] = first[whole]
                np.copyto(low, raw, where=whole)
        del kind, first, begins
        starts = np.flatnonzero(unit)
        data = low[filled]
        ends = np.append(np.flatnonzero(unit[filled]), len(data))
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return units, whole[starts], np.searchsorted(starts, at)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word) of words that need no cutting."""
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        text = self.letters[np.insert(data, at[1:], ord(" "))].tobytes().decode("utf-16-le")
        ids, counts = [], []
        for a in range(0, len(words), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(words))
            part = text[at[a] + a : at[b] + b - 1]
            found = np.array(self.plain.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) == b - a:
                ids.append(found)
                counts.append(np.diff(stops, prepend=0))
            else:
                found, number = self._whole(words[a:b])
                ids.append(found)
                counts.append(number)
        return np.concatenate(ids), np.concatenate(counts)

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for a in range(0, len(words), WORDS_AT_ONCE):
            texts = words[a : a + WORDS_AT_ONCE].cast(pa.large_string()).to_pylist()
            parts.append(_flat([e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _new(self, words: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id and number of each word)."""
        parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
        order = np.argsort(whole, kind="stable")
        for mask, encode in ((~whole, self._plain), (whole, self._whole)):
            if mask.any():
                found, counts[mask] = encode(words.filter(pa.array(mask)))
                parts.append(found)
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts), starts, counts

    def _keep(self, words: pa.Array, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, uses: np.ndarray) -> None:
        """Keeps short words; when there are too many, those that were used most."""
        kept = np.flatnonzero(pc.binary_length(words).to_numpy() <= KEPT_BYTES)
        if len(kept) > KEPT_WORDS:
            kept = np.sort(kept[np.argpartition(-uses[kept], KEPT_WORDS // 2)[: KEPT_WORDS // 2]])
            uses = uses // 2
        self.words, self.uses, self.sizes = words.take(pa.array(kept)), uses[kept], sizes[kept]
        self.ids = ragged_take(ids, starts[kept], sizes[kept])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in text order, each text followed by ``end_id``; bounds by text."""
        if self.cuts:
            units, whole, bounds = self._units(texts)
        else:
            units, whole, bounds = texts.cast(pa.large_binary()), np.ones(len(texts), bool), np.arange(len(texts) + 1)
        coded = units.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        row = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(row < 0)
        as_is = np.zeros(len(words), bool)
        as_is[index[whole]] = True
        words = words.take(pa.array(new))
        ids, starts, sizes = self._new(words, as_is[new])
        # ids of kept words, of new words and the end id, then those of all words of all texts in order
        row[new] = len(self.words) + np.arange(len(new))
        starts = np.concatenate([np.cumsum(self.sizes) - self.sizes, starts + len(self.ids), [len(self.ids) + len(ids)]])
        sizes = np.concatenate([self.sizes, sizes, [1]])
        ids = np.concatenate([self.ids, ids, np.array([end_id], np.uint32)])
        uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        uses[row] += np.bincount(index, minlength=len(row))
        self._keep(pa.concat_arrays([self.words, words]), ids, starts[:-1], sizes[:-1], uses)
        order = np.insert(row[index], bounds[1:], len(sizes) - 1)
        taken = sizes[order]
        running = np.concatenate([[0], np.cumsum(taken)])
        return ragged_take(ids, starts[order], taken), running[bounds + np.arange(len(bounds))]


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= SMALL:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out + [n] * (n > 0)


class Bins:
    """One worker's open bins: class k takes k pieces, whatever else arrives."""

    def __init__(self, capacity: int, worker: int) -> None:
        self.capacity, self.next, self.open = capacity, worker << 40, {}

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: tuple) -> list[tuple]:
        """The rows of a bin that this piece fills, else none. piece: (id, start, length, ids, tokens of the document)."""
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) < k:
            return []
        del self.open[k]
        return self.placed(bin_)

    def placed(self, pieces: list[tuple]) -> list[tuple]:
        at, number, rows = 0, self.fresh(), []
        for doc, start, length, ids, tokens in pieces:
            rows.append((doc, start, length, zlib.crc32(ids), tokens, number, at))
            at += length
        return rows

    def close(self) -> Iterator[tuple]:
        """What is open, end to end, cut into full rows and rows of a power of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(p[2] for p in rest)
        rest.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            row = []
            while room:
                doc, start, length, ids, tokens = rest.pop()
                now = min(room, length)
                row.append((doc, start, now, ids[: 4 * now], tokens))
                if now < length:
                    rest.append((doc, start + now, length - now, ids[4 * now :], tokens))
                room -= now
            yield from self.placed(row)


def pack(
    df: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of the tokenizers library without added special tokens, then ``end_id``.
    ``capacity`` is a power of two. Every id lies in exactly one piece, pieces of a sequence are gapless from
    offset 0, and a sequence is to be padded to ``capacity`` unless its length is a power of two. A null or
    empty text is the end id alone. Repeated rows are packed once each; null ids are kept.

    No shuffle: bins belong to the partition that read their documents, sequence ids are
    (partition << 40) + number, and a partition that is run again makes the same rows.
    """
    if capacity < 2 * SMALL or capacity & (capacity - 1):
        raise ValueError(f"capacity must be a power of two from {2 * SMALL}")
    attach(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        own = encoder(path or public_tokenizers.path("word_bpe_49k.json"))
        bins = Bins(capacity, TaskContext.get().partitionId())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[id_col, *NAMES])

        for batch in batches:
            for part in slices(batch, text_col, PART_BYTES):
                ids, bounds = own.encode(part.column(text_col), end_id)
                rows = []
                for doc, a, b in zip(part.column(id_col).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    at = a
                    for n in cuts(b - a, capacity):
                        rows += bins.add((doc, at - a, n, ids[at : at + n].tobytes(), b - a))
                        at += n
                if rows:
                    yield batch_of(rows)
        if rest := list(bins.close()):
            yield batch_of(rest)

    return id_and_text(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, {SCHEMA}")
