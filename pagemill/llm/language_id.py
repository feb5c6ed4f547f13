"""Language identification by interpolated Kneser-Ney models of characters.

Each language has a model of the letters of a word given up to ``ORDER`` - 1 characters before them, a word
beginning and ending with a blank. An n-gram's interpolated probability is settled for every language at
training time and kept in arrays sorted by the n-gram's hash; an n-gram that no language has seen goes to the
shorter one with the weight of its context. A text belongs to the language with the lowest cross-entropy a
character. It is rejected if it has no letter, or if that cross-entropy is above what held-out text of the
language shows, by a margin.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, id_and_text, map_batches, slices, total_by_text

ORDER = 4
#: Documents of each language that a model is fitted on, at the most, as an expected number.
TRAIN_DOCS = 1500
UNKNOWN = "und"
#: A rejected text's cross-entropy is above this quantile of the language's own held-out texts by this many nats a character.
#: Measured on documents that tuned nothing (sf0.1): they reach 1.2 nats above a quantile of about 1.65, sentences of
#: six foreign languages in Latin letters begin 2.5 above it, random letters 5.
QUANTILE, MARGIN = 0.99, 1.5
KEPT_WORDS = 50_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Runs of letters in lower case: (index into the distinct words, distinct words, bounds by text)."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    parts = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]+", " "), " "), " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), bounds - bounds[0]


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` codes that end at each position; positions too close to the start hold no n-gram."""
    out = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(size - 1, -1, -1):
            moved = np.zeros(len(codes), np.uint64)
            moved[back:] = codes[: len(codes) - back]
            out = (out ^ moved) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


@dataclass
class Model:
    """Sorted hash arrays of each order, with columns by language."""

    languages: list[str]
    hashes: list[np.ndarray]  # by order - 1
    logp: list[np.ndarray]
    backoff: list[np.ndarray]  # of each n-gram as a context
    floor: np.ndarray
    limit: np.ndarray | None = None  # highest accepted cross-entropy by language
    sharpness: float = 20.0
    kept: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of -log p of each word's characters and its end, by language."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        at = np.arange(len(codes)) - np.repeat(starts, sizes)  # place in the padded word
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        open_ = at > 0
        extra = np.zeros_like(out)
        for order in range(min(ORDER, int(sizes.max())), 0, -1):
            now = np.flatnonzero(open_ & (at >= order - 1))
            if not len(now):
                continue
            mine, own = _hashes(codes, order)[now], self.hashes[order - 1]
            spot = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            seen = own[spot] == mine
            out[now[seen]] = self.logp[order - 1][spot[seen]] + extra[now[seen]]
            open_[now[seen]] = False
            if order > 1:
                lost = now[~seen]
                context, own = _hashes(codes, order - 1)[lost - 1], self.hashes[order - 2]
                spot = np.minimum(np.searchsorted(own, context), len(own) - 1)
                good = own[spot] == context
                extra[lost[good]] += self.backoff[order - 2][spot[good]]
        out[open_] = self.floor + extra[open_]
        return -np.add.reduceat(out, starts, axis=0) if len(words) else out

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy a character by language, letters) of each text."""
        index, words, bounds = words_of(texts)
        scores = np.empty((len(words), len(self.languages)), np.float64)
        new = []
        for i, w in enumerate(words):
            if (hit := self.kept.get(w)) is None:
                new.append(i)
            else:
                scores[i] = hit
        if new:
            scores[new] = self.word_scores([words[i] for i in new])
            seen = np.bincount(index, minlength=len(words)) > 1
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept.clear()
            for i in new:
                if seen[i] and len(self.kept) < KEPT_WORDS:
                    self.kept[words[i]] = scores[i]
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        scores[sizes == 0] = 0
        own_letters = pc.utf8_length(pc.replace_substring_regex(pa.array(words, pa.string()), r"\p{M}+", "")).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = total_by_text(own_letters[index], bounds)  # marks are part of words, but no letters
        chars = total_by_text(np.where(sizes > 0, sizes + 1, 0)[index], bounds)
        nats = np.stack([total_by_text(scores[index, k], bounds) for k in range(len(self.languages))], axis=1)
        return nats / np.maximum(chars, 1)[:, None], letters

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected, cross-entropy) of each text."""
        nats, letters = self.scores(texts)
        best = nats.argmin(axis=1)
        lowest = nats[np.arange(len(best)), best]
        score = 1 / np.exp(-self.sharpness * (nats - lowest[:, None])).sum(axis=1)
        none = letters == 0
        names = np.array([*self.languages, UNKNOWN], object)
        rejected = none | (lowest > (self.limit[best] if self.limit is not None else np.inf))
        return names[np.where(none, len(self.languages), best)], np.where(none, 0.0, score), rejected, np.where(none, np.nan, lowest)


def kneser_ney(counts: dict[str, Counter], order: int = ORDER) -> Model:
    """Model from the counts of each language's padded words."""
    languages = sorted(counts)
    grams: list[list[Counter]] = []  # by language, by order: counts, below the highest order of distinct left characters
    for name in languages:
        raw = [Counter() for _ in range(order)]
        left = [defaultdict(set) for _ in range(order)]
        for word, n in counts[name].items():
            padded = f" {word} "
            for end in range(1, len(padded)):
                for size in range(1, min(order, end + 1) + 1):
                    gram = padded[end + 1 - size : end + 1]
                    if size == order or size == end + 1:
                        raw[size - 1][gram] += n  # of full length, or at the word's start: nothing stands to its left
                    if size < order and size <= end:
                        left[size - 1][gram].add(padded[end - size])
        for size in range(order - 1):
            for gram, before in left[size].items():
                raw[size][gram] += len(before)
        grams.append(raw)
    letters = len({c for raw in grams for c in raw[0]}) + 1
    hashes, logs, backs = [], [], []
    lower: dict[str, np.ndarray] = {}
    floor = np.zeros(len(languages))
    contexts: list[dict[str, np.ndarray]] = []
    for size in range(1, order + 1):
        names = sorted(set().union(*(raw[size - 1] for raw in grams)))
        table, weight = {g: np.zeros(len(languages)) for g in names}, {}
        for k, raw in enumerate(grams):
            own = raw[size - 1]
            by_count = Counter(own.values())
            discount = by_count[1] / max(1, by_count[1] + 2 * by_count[2]) or 0.5
            discount = min(max(discount, 0.1), 0.95)
            total, kinds = Counter(), Counter()
            for g, n in own.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            for context in total:
                weight.setdefault(context, np.ones(len(languages)))[k] = discount * kinds[context] / total[context]
            for g in names:
                below = lower[g[1:]][k] if size > 1 else 1 / letters
                n = total[g[:-1]]
                table[g][k] = (max(own[g] - discount, 0) + discount * kinds[g[:-1]] * below) / n if n else below
            if size == 1:
                floor[k] = np.log(weight[""][k] / letters)
        contexts.append(weight)
        flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
        keys = _hashes(flat, size)[size - 1 :: size]
        sort = np.argsort(keys)
        hashes.append(keys[sort])
        logs.append(np.log(np.array([table[g] for g in names]))[sort].astype(np.float32))
        lower, kept = table, (names, sort)
        backs.append(kept)
    for size in range(1, order + 1):
        names, sort = backs[size - 1]
        weight = contexts[size] if size < order else {}
        one = np.ones(len(languages))
        backs[size - 1] = np.log(np.array([weight.get(g, one) for g in names]))[sort].astype(np.float32)
    # a context of one blank, the start of a word, is no n-gram that ends in a word; it is kept as one for its weight
    return _with_start(Model(languages, hashes, logs, backs, floor.astype(np.float32)), contexts)


def _with_start(model: Model, contexts: list[dict[str, np.ndarray]]) -> Model:
    """Adds contexts that are no predicted n-grams themselves, with their weights and the floor's probability."""
    for size in range(1, ORDER):
        there = model.hashes[size - 1]
        for context, weight in contexts[size].items():
            key = _hashes(np.array([ord(c) for c in context], np.uint64), size)[-1]
            spot = np.searchsorted(there, key)
            if spot == len(there) or there[spot] != key:
                model.hashes[size - 1] = there = np.insert(there, spot, key)
                model.logp[size - 1] = np.insert(model.logp[size - 1], spot, model.floor, axis=0)
                model.backoff[size - 1] = np.insert(model.backoff[size - 1], spot, np.log(weight), axis=0)
    return model


def held_out_condition(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fits the models on a bounded sample of the rows of ``df`` that have an id, a text and a language.

    The sample takes each language's rows by a hash of the id, ``train_docs`` of them in expectation; a fifth
    of it is kept from the counts and sets the limits of rejection and the sharpness of scores. Only words
    and their counts leave the executors, summed there.
    """
    attach(df.sparkSession)
    labelled = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return Model([], [], [], [], np.zeros(0, np.float32))
    draw = (F.xxhash64(F.lit("sample"), "id").bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["count"]))))
    sample = labelled.where(draw < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    sample = sample.withColumn("tuning", F.pmod(F.xxhash64(F.lit("tuning"), "id"), F.lit(5)) == 0)

    def count(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                index, words, _ = words_of(part.filter(pa.array(langs == lang)).column("text"))
                n = np.bincount(index, minlength=len(words))
                yield pa.record_batch([pa.array([lang] * len(words)), pa.array(words, pa.string()), pa.array(n)], names=["lang", "word", "n"])

    def counted(rows: DataFrame) -> dict[str, Counter]:
        counts: dict[str, Counter] = defaultdict(Counter)
        found = map_batches(rows.select("text", "lang"), count, "lang string, word string, n long").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        for lang, word, n in found.toLocalIterator():
            counts[lang][word] += n
        return counts

    counts = counted(sample.where(~F.col("tuning")))
    if any(r["lang"] not in counts for r in sizes):  # a language with a few rows: all of them count
        counts = counted(sample)
    if not counts:
        return Model([], [], [], [], np.zeros(0, np.float32))
    model = kneser_ney(counts)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            nats, letters = sent.value.scores(part.column("text"))
            yield pa.record_batch([part.column("lang"), pa.array(list(nats), pa.list_(pa.float64())), pa.array(letters)], names=["lang", "nats", "letters"])

    tuning = map_batches(sample.where("tuning").select("text", "lang"), measure, "lang string, nats array<double>, letters long").where("letters >= 20").collect()
    # without a text to measure: halfway between guessing each letter and letters that never occurred
    limit = (np.log(len(model.hashes[0])) - model.floor.astype(float)) / 2
    if tuning:
        nats = np.array([r["nats"] for r in tuning])
        true = np.array([model.languages.index(r["lang"]) if r["lang"] in model.languages else -1 for r in tuning])
        nats, true = nats[true >= 0], true[true >= 0]
        own = nats[np.arange(len(true)), true]
        for k in set(true.tolist()):
            limit[k] = np.quantile(own[true == k], QUANTILE) + MARGIN
        # the sharpness under which the scores' likelihood of the known languages is highest
        gaps = own[:, None] - nats
        model.sharpness = float(min((1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0), key=lambda s: np.log(np.exp(np.clip(s * gaps, -700, 700)).sum(axis=1)).sum()))
    model.limit = limit
    sent.unpersist()
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected, cross_entropy) of every whole text; only the text is looked at.

    A null or empty text, one without a letter, and every text if the model has no language, is ``und`` with
    score 0, rejected, without a cross-entropy. Null ids and repeated rows are passed on. No shuffle.
    """
    attach(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            if model_ := sent.value.languages:
                lang, score, rejected, nats = sent.value.predict(part.column(text_col))
            else:
                n = part.num_rows
                lang, score, rejected, nats = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool), np.full(n, np.nan)
            del model_
            yield pa.record_batch(
                [part.column(id_col), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(nats, from_pandas=True)],
                names=[id_col, "lang_pred", "score", "rejected", "cross_entropy"],
            )

    return map_batches(id_and_text(df, id_col, text_col), run, f"`{id_col}` long, lang_pred string, score double, rejected boolean, cross_entropy double")


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text the model doesn't reject, with all their columns. No shuffle."""
    attach(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            if sent.value.languages:
                rejected = sent.value.predict(pc.fill_null(part.column(text_col), ""))[2]
                yield part.filter(pa.array(~rejected))

    return map_batches(df, run, df.schema)


def held_out_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Predictions for all rows by a model of the rows whose crc32(id as text) mod 4 is not 2.

    Adds ``held_out``: whether the remainder is 2 (null for a null id, whose row trains nothing).
    """
    model = train(df.where(~held_out_condition(id_col)), id_col, text_col, lang_col, train_docs)
    return identify(df, model, id_col, text_col).withColumn("held_out", held_out_condition(id_col))
