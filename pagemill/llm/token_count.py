"""Token counts by rank-synchronous merging of ragged arrays.

A batch's texts are cut at blanks and line feeds, which no token of the vocabulary spans, and each distinct
chunk is normalised and cut into pre-tokens as the vocabulary file says. The distinct pre-tokens are held as
one flat array of symbols with bounds. In every round each sequence finds its own lowest-rank adjacent pair,
all sequences apply theirs at once (every occurrence, from the left where occurrences overlap), and the
round ends when no sequence has a mergeable pair. What survives are the tokens.

A merged symbol only takes part in merges of a higher rank than the merge that made it, so applying all
occurrences of the lowest pair at once gives the same symbols as one merge at a time.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import attach, dictionary_of_chunks, id_and_text, map_batches, slices, total_by_text

#: Chunks whose counts a worker keeps between batches; bounds its memory only.
KEPT_CHUNKS = 100_000
_NONE = np.int64(1 << 60)
_SHIFT = 20


class RankMerger:
    """Counts the tokens of chunks under a byte-level BPE vocabulary file with word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << _SHIFT) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        letters = [t for t in vocab if len(t) == 1]
        size = max(map(ord, letters)) + 1
        self.plain, self.final = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for t in letters:
            self.plain[ord(t)] = vocab[t]
            self.final[ord(t)] = vocab.get(t + suffix, -1)
        self.kept: dict[str, int] = {}

    def merged_lengths(self, words: list[str]) -> np.ndarray:
        """Symbols left of each word (written in the vocabulary's byte letters) after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        left = sizes.copy()
        if not len(words) or not sizes.sum():
            return left
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.plain[codes]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.final[codes[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            pair = (symbols[:-1] << _SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.rank[at], _NONE)
            firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.append(rank, _NONE)
            lowest = np.minimum.reduceat(rank, firsts)
            spans = np.diff(np.r_[firsts, len(symbols)])
            active = lowest < _NONE
            done = owner[firsts[~active]]
            left[done] = spans[~active]
            hit = (rank == np.repeat(lowest, spans)) & (rank < _NONE)
            where = np.flatnonzero(hit)
            if len(where):
                # of overlapping occurrences every second one counts, from the left
                starts = np.r_[True, np.diff(where) > 1]
                run = np.maximum.accumulate(np.where(starts, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - run) % 2 == 0]
                symbols[where] = self.made[at[where]]
            keep = np.repeat(active, spans)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            left[owner] = 1
        return left

    def _count(self, pieces: list[str]) -> np.ndarray:
        """Tokens of pieces that hold no special string and no white space."""
        normal = self.normalizer.normalize_str(" ".join(pieces)) if self.normalizer else " ".join(pieces)
        starts = np.cumsum([0, *(len(p) + 1 for p in normal.split(" "))])[:-1]
        if len(starts) != len(pieces):
            return np.array([self._alone(p) for p in pieces], np.int64)
        parts = self.pre_tokenizer.pre_tokenize_str(normal)
        if not parts:
            return np.zeros(len(pieces), np.int64)
        words, spans = zip(*parts, strict=True)
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        lengths = self.merged_lengths(list(number))
        owner = np.searchsorted(starts, np.fromiter((s for s, _ in spans), np.int64, len(spans)), side="right") - 1
        return np.bincount(owner, weights=lengths[which], minlength=len(pieces)).astype(np.int64)

    def _alone(self, piece: str) -> int:
        normal = self.normalizer.normalize_str(piece) if self.normalizer else piece
        return int(self.merged_lengths([w for w, _ in self.pre_tokenizer.pre_tokenize_str(normal)]).sum())

    def count(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk, as the library counts them without added special tokens."""
        out = np.zeros(len(chunks), np.int64)
        pieces, owner = [], []
        for i, chunk in enumerate(chunks):
            for j, piece in enumerate(self.special.split(chunk) if self.special else [chunk]):
                if j % 2:
                    out[i] += 1
                elif piece.isascii() and piece.isprintable() and " " not in piece or not re.search(r"\s", piece):
                    pieces.append(piece)
                    owner.append(i)
                else:
                    out[i] += self._alone(piece)
        if pieces:
            np.add.at(out, np.array(owner), self._count(pieces))
        return out

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; texts without nulls."""
        index, chunks, bounds = dictionary_of_chunks(texts)
        counts = np.fromiter((self.kept.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(counts < 0)
        counts[new] = self.count([chunks[i] for i in new])
        again = new[np.bincount(index, minlength=len(chunks))[new] > 1] if len(new) else new
        if len(self.kept) + len(again) > KEPT_CHUNKS:
            self.kept.clear()
        self.kept.update((chunks[i], int(counts[i])) for i in again[:KEPT_CHUNKS])
        return total_by_text(counts[index], bounds)


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(
    df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    ``path`` is a vocabulary file of the tokenizers library (by default word_bpe_49k.json). A null text
    counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay as they are, one row out for one in.
    There is no shuffle: each batch is counted where it was read.
    """
    attach(df.sparkSession)

    def count(batch: pa.RecordBatch):
        import public_tokenizers

        own = merger(path or public_tokenizers.path("word_bpe_49k.json"))
        for part in slices(batch, text_col):
            texts = part.column(text_col)
            tokens = own.count_texts(texts)
            yield pa.record_batch(
                [part.column(id_col), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return map_batches(id_and_text(df, id_col, text_col), count, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
