"""Quality of texts by weak labels.

Overlapping heuristics each vote good, bad or nothing. Expectation-maximisation over the counts of vote
patterns, of all texts, estimates each heuristic's accuracy on both kinds and the share of good texts,
without any given label. The posterior of each pattern then labels a bounded sample of texts, on which a
linear scorer of hashed features is trained. It scores every text, also where the heuristics are silent or disagree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, dictionary_of_chunks, id_and_text, map_batches, slices, total_by_text

GOOD, BAD, NOTHING = 1, 0, -1
#: (heuristic, measure, good below or from, bad from or below): a measure between the two bounds gives no vote.
HEURISTICS = (
    ("marked_words", "marked", 0.02, 0.20),
    ("capitals", "capitals", 0.20, 0.45),
    ("bare_marks", "bare", 0.05, 0.20),
    ("marks", "marks", 0.12, 0.25),
    ("stutter", "stutter", 0.05, 0.25),
    ("echo", "echo", 0.08, 0.25),
    ("repeated_lines", "repeated", 0.20, 0.60),
    ("long_words", "long_words", 0.05, 0.30),
    ("unfinished_lines", "unfinished", 0.34, 0.90),
    ("few_short_words", "few_short", 0.92, 0.985),
)
#: Texts that the scorer is fitted on, at the most, as an expected number; dimensions of its hashed features.
TRAIN_TEXTS, DIMENSIONS = 5000, 1 << 16
THRESHOLD = 0.5
#: Words below which some shares say nothing.
SHORT = 20


def _count(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(np.float64)


@dataclass
class Parts:
    """The distinct chunks of some texts and where they stand."""

    index: np.ndarray
    bounds: np.ndarray
    chunks: pa.Array
    full: np.ndarray  # chunks that show something, by text

    @classmethod
    def of(cls, texts: pa.Array) -> Parts:
        index, chunks, bounds = dictionary_of_chunks(texts)
        made = pa.array(chunks, pa.large_string())
        some = pc.match_substring_regex(made, r"[^\s\p{Z}]").to_numpy(zero_copy_only=False).astype(np.float64)
        return cls(index, bounds, made, total_by_text(some[index], bounds))

    def again(self, back: int = 1) -> np.ndarray:
        """Number of chunks, by text, that are the chunk ``back`` places before them once more."""
        same = np.zeros(len(self.index), np.float64)
        same[back:] = self.index[back:] == self.index[:-back]
        for k in range(back):
            first = self.bounds[:-1] + k
            same[first[first < self.bounds[1:]]] = 0
        same[pc.binary_length(self.chunks).to_numpy(zero_copy_only=False)[self.index] == 0] = 0
        return total_by_text(same, self.bounds)

    def total(self, by_chunk: np.ndarray) -> np.ndarray:
        return total_by_text(by_chunk[self.index], self.bounds)


def measures(texts: pa.Array, parts: Parts) -> dict[str, np.ndarray]:
    """The measures that the heuristics look at, NaN for a text without words."""
    chunks = parts.chunks
    letters, upper = _count(chunks, r"\p{L}"), _count(chunks, r"\p{Lu}")
    chars = pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.float64)
    marks = _count(chunks, r"[^\p{L}\p{M}\p{N}]")
    worded = letters > 0
    of = lambda x: parts.total(x.astype(np.float64))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {
            "marked": of(pc.match_substring_regex(chunks, r"\p{L}[,.]?[^\p{L}\p{M}\p{N}\s]{2,}$").to_numpy(zero_copy_only=False)) / parts.full,
            "capitals": of(upper) / of(letters),
            "bare": of((chars > 0) & (marks == chars)) / parts.full,
            "marks": of(marks) / of(chars),
            "stutter": parts.again() / parts.full,
            "echo": parts.again(2) / parts.full,
            "long_words": of(letters > 24) / of(worded),
            "few_short": 1 - of(worded & (letters <= 3)) / of(worded),
        }
    repeated, unfinished = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
    for i, text in enumerate(texts.to_pylist()):
        lines = [x.strip() for x in text.split("\n")]
        lines = [x for x in lines if x]
        if lines:
            unfinished[i] = sum(x[-1] not in ".!?:;\"'”»)" for x in lines) / len(lines)
        if len(lines) > 3:
            repeated[i] = 1 - len(set(lines)) / len(lines)
    out |= {"repeated": repeated, "unfinished": unfinished}
    for name in ("marks", "long_words", "few_short", "unfinished"):
        out[name] = np.where(parts.full >= SHORT, out[name], np.nan)
    return out


def votes(texts: pa.Array, parts: Parts) -> np.ndarray:
    """(texts, heuristics) votes."""
    found = measures(texts, parts)
    out = np.full((len(texts), len(HEURISTICS)), NOTHING, np.int8)
    for k, (_, name, good, bad) in enumerate(HEURISTICS):
        x = found[name]
        out[x <= good, k] = GOOD
        out[x >= bad, k] = BAD
    return out


def pattern_of(vote: np.ndarray) -> np.ndarray:
    """One number for each row of votes."""
    return (vote.astype(np.int64) + 1) @ (3 ** np.arange(vote.shape[1], dtype=np.int64))


@dataclass
class LabelModel:
    """What EM estimates: the share of good texts, and P(vote | kind, it votes) of each heuristic, (heuristics, kinds, votes)."""

    good: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good; a heuristic that gives no vote says nothing."""
        vote = (np.asarray(patterns)[:, None] // 3 ** np.arange(len(self.chances))) % 3 - 1
        logs = np.tile(np.log(np.array([1 - self.good, self.good])), (len(vote), 1))
        for k, chance in enumerate(np.log(self.chances)):
            logs += np.where(vote[:, k, None] == NOTHING, 0, chance[:, np.maximum(vote[:, k], 0)].T)
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """P(a vote is right | it votes) of each heuristic."""
        right = self.chances[:, 0, BAD] * (1 - self.good) + self.chances[:, 1, GOOD] * self.good
        return {h[0]: float(r) for h, r in zip(HEURISTICS, right, strict=False)}


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, n_votes: int, rounds: int = 200) -> LabelModel:
    """Fits the label model to the counts of vote patterns; heuristics are independent given the kind.

    It starts from the belief that a text is good where nothing objects. Bad texts are bad in different ways, so a
    start by majority would count every kind of them that one heuristic alone can see as that one's errors.
    """
    vote = (patterns[:, None] // 3 ** np.arange(n_votes)) % 3 - 1
    belief = np.where((vote == BAD).any(axis=1), 0.001, 0.98)
    model = LabelModel(0.5, np.full((n_votes, 2, 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([(1 - belief) * counts, belief * counts])
        chances = np.empty((n_votes, 2, 2))
        for k in range(n_votes):
            for v in (BAD, GOOD):
                chances[k, :, v] = weight[:, vote[:, k] == v].sum(axis=1)
        chances = (chances + 0.5) / (chances + 0.5).sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip((weight[1].sum() + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6)), chances)
        now = model.posterior(patterns)
        if np.abs(now - belief).max() < 1e-7:
            break
        belief = now
    return model


def chunk_features(chunks: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(chunks, 2) hashed features: the chunk's shape, and its letters in lower case."""
    from pandas.util import hash_array

    shape = chunks
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lm}\p{Lo}\p{Lt}\p{M}]+", "a"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, mark)
    word = pc.replace_substring_regex(pc.utf8_lower(chunks), r"[^\p{L}\p{M}]+", "")
    half = np.uint64(dimensions // 2)
    cols = [hash_array(x.to_numpy(zero_copy_only=False), categorize=False) % half if len(x) else np.zeros(0, np.uint64) for x in (shape, word)]
    return np.stack([cols[0], cols[1] + half], axis=1).astype(np.int64)


@dataclass
class Scorer:
    """Weights of the hashed features, and after them that of a chunk that repeats the one before it."""

    weights: np.ndarray
    bias: float

    def score(self, parts: Parts) -> np.ndarray:
        by_chunk = self.weights[chunk_features(parts.chunks, len(self.weights) - 1)].sum(axis=1)
        by_chunk[pc.binary_length(parts.chunks).to_numpy(zero_copy_only=False) == 0] = 0
        return 1 / (1 + np.exp(-np.clip(self.bias + (parts.total(by_chunk) + self.weights[-1] * parts.again()) / np.maximum(parts.full, 1), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], dimensions: int = DIMENSIONS, epochs: int = 200, rate: float = 0.5, shrink: float = 1e-6) -> Scorer:
    """Logistic regression on soft labels by AdaGrad over whole passes. rows: (features, their shares, label)."""
    dimensions += 1
    if not rows:
        return Scorer(np.zeros(dimensions, np.float32), 0.0)
    sizes = np.array([len(r[0]) for r in rows])
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    label = np.array([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    weights, bias = np.zeros(dimensions), 0.0
    seen, seen_bias = np.full(dimensions, 1e-8), 1e-8
    share = np.where(label > 0.5, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))  # both kinds weigh the same
    for _ in range(epochs):
        raw = bias + np.bincount(owner, weights=weights[index] * value, minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * share
        gradient = np.bincount(index, weights=error[owner] * value, minlength=dimensions) + shrink * weights
        seen += gradient**2
        weights -= rate * gradient / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    return Scorer(weights.astype(np.float32), float(bias))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_texts: int = TRAIN_TEXTS) -> tuple[LabelModel, Scorer]:
    """The label model of all texts, and the scorer of a bounded sample of them, drawn by a hash of the text.

    The patterns are at most 3 to the number of heuristics, counted on the executors.
    """
    attach(df.sparkSession)
    texts = id_and_text(df, id_col, text_col).select(text_col)

    def patterns(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            text = part.column(text_col)
            found, n = np.unique(pattern_of(votes(text, Parts.of(text))), return_counts=True)
            yield pa.record_batch([pa.array(found), pa.array(n)], names=["pattern", "n"])

    counted = map_batches(texts, patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return LabelModel(0.5, np.full((len(HEURISTICS), 2, 2), 0.5)), fit([])
    seen = np.array([r["pattern"] for r in counted], np.int64)
    counts = np.array([r["n"] for r in counted], np.float64)
    order = np.argsort(seen)
    model = expectation_maximisation(seen[order], counts[order], len(HEURISTICS))
    share = min(1.0, train_texts / counts.sum())
    draw = F.xxhash64(F.lit("sample"), text_col).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)

    def featured(batch: pa.RecordBatch):
        for part in slices(batch, text_col):
            text = part.column(text_col)
            parts = Parts.of(text)
            label = model.posterior(pattern_of(votes(text, parts)))
            features = chunk_features(parts.chunks)
            indices, values = [], []
            for a, b, n, same in zip(parts.bounds[:-1], parts.bounds[1:], parts.full, parts.again(), strict=True):
                found, times = np.unique(features[parts.index[a:b]], return_counts=True)
                found, times = np.append(found, DIMENSIONS), np.append(times, same)
                indices.append(found)
                values.append(times / max(n, 1))
            yield pa.record_batch([pa.array(indices, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64())), pa.array(label)], names=["i", "v", "label"])

    sample = map_batches(texts.where(draw < share).dropDuplicates(), featured, "i array<long>, v array<double>, label double").collect()
    rows = sorted(((np.array(r["i"], np.int64), np.array(r["v"]), r["label"]) for r in sample), key=lambda r: (r[2], r[0].tobytes()))
    return model, fit(rows)


def score(df: DataFrame, models: tuple[LabelModel, Scorer], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, quality, keep, weak_label) of every whole text.

    ``quality`` is the scorer's probability that the text is good, ``weak_label`` the label model's; ``keep`` is
    quality >= ``threshold``. A null or empty text, or one of blanks only, has quality 0 and isn't kept. Null ids and
    repeated rows are passed on; equal texts have equal values. No shuffle.
    """
    spark = attach(df.sparkSession)
    sent = spark.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch):
        labels, scorer = sent.value
        for part in slices(batch, text_col):
            text = part.column(text_col)
            parts = Parts.of(text)
            weak = labels.posterior(pattern_of(votes(text, parts)))
            quality = np.where(parts.full > 0, scorer.score(parts), 0.0)
            yield pa.record_batch([part.column(id_col), pa.array(quality), pa.array(quality >= threshold), pa.array(np.where(parts.full > 0, weak, 0.0))], names=[id_col, "quality", "keep", "weak_label"])

    return map_batches(id_and_text(df, id_col, text_col), run, f"`{id_col}` long, quality double, keep boolean, weak_label double")


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """Trains on ``df`` and scores it."""
    return score(df, train(df, id_col, text_col, train_texts), id_col, text_col)
