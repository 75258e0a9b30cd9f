"""Quality rules: counted rules, then a hashed n-gram scorer trained on labelled rows, with calibrated probabilities.

The counted rules look at words, signs, repeated lines and repeated windows of a whole text, and
fail a text by themselves. What passes them is judged by a logistic regression over hashed word
n-grams (one and two words) and byte n-grams (two to four), trained on labelled rows: at most
``train_docs`` labelled documents, those whose ids have the smallest hashes. A fifth of them is
held out of the fit and calibrates it: probabilities come from a logistic curve over held-out
margins. Every document is scored by its whole text, batch by batch, against one fixed threshold.

Defined results: a null or empty text has no words and fails the counted rules; a text that fails
them is not scored and has a null ``bad_probability``; equal texts get equal results; without
labelled rows of both classes nothing is known of quality, the probability is null and the
counted rules alone decide; a document labelled more than once takes its mean label, one that
occurs more than once trains with one of its texts, and labels without id or quality, or of
documents that are not there, are not used; an empty table gives an empty table; further columns
are carried along, but for those with the names of the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.shingles import mix, word_hashes

TRAIN_DOCS = 4_000
FEATURES = 1 << 15
REJECT_FROM = 0.5
WINDOW = 8

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Added to the names of the n-grams, by kind, so that the kinds fall into different buckets.
SALTS = np.array([i * 0x9E3779B97F4A7C15 % 2**64 for i in range(1, 6)], np.uint64)
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "bad_probability", "kept"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` (a power of two) words that stand in the text twice or more.

    Windows get exact numbers by doubling: a number for each pair of neighbouring numbers.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    width = 1
    while width < window:
        _, names = np.unique(names[:-width] * np.int64(len(words)) + names[width:], return_inverse=True)
        width *= 2
    starts = np.bincount(names)[names] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(starts)] += starts
    edge[window : window + len(starts)] -= starts
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counted(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether these fail the text."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = repeated_words(words)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n


def _grams(text: str) -> list[np.ndarray]:
    """64-bit names of the n-grams of a text, by kind. A word that says its forerunner again makes the same pair whatever it is."""
    words = word_hashes(text)
    pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
    pairs[words[:-1] == words[1:]] = 1
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    kinds = [words, pairs]
    rolled = data
    for size in (2, 3, 4):
        rolled = rolled[:-1] * np.uint64(256) + data[size - 1 :]
        kinds.append(rolled)
    return kinds


def features(text: str) -> Iterator[tuple[np.ndarray, float]]:
    """For each kind of n-gram the buckets of its occurrences and the value of each."""
    for i, names in enumerate(_grams(text)):
        if len(names):
            buckets = (names + SALTS[i]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FEATURES.bit_length() + 1)
            yield buckets.astype(np.int64), 8.0 / len(names)


def summed_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their summed values."""
    total = np.zeros(FEATURES)
    for buckets, value in features(text):
        total += np.bincount(buckets, minlength=FEATURES) * value
    at = np.flatnonzero(total)
    return at, total[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass(frozen=True)
class Scorer:
    """Weights of the buckets and the curve from margins to probabilities of being bad."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str) -> float:
        return self.bias + sum(value * float(self.weights[buckets].sum()) for buckets, value in features(text))

    def probability(self, text: str) -> float:
        return float(_sigmoid(np.float64(self.slope * self.margin(text) + self.shift)))


Row = tuple[np.ndarray, np.ndarray, float]


def fit_weights(rows: list[Row], epochs: int = 20, batch: int = 128, rate: float = 0.3, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over small batches, in a fixed order; both classes weigh alike."""
    weights, bias = np.zeros(FEATURES), 0.0
    past, past_bias = np.full(FEATURES, 1e-6), 1e-6
    label = np.array([r[2] for r in rows])
    share = min(max(float(label.mean()), 0.02), 0.98)
    weigh = np.where(label > 0.5, 0.5 / share, 0.5 / (1 - share))
    order = np.random.default_rng(11)
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for start in range(0, len(rows), batch):
            chosen = shuffled[start : start + batch]
            at = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            margin = np.bincount(owner, weights[at] * value, len(chosen)) + bias
            error = (_sigmoid(margin) - label[chosen]) * weigh[chosen] / len(chosen)
            slope = np.bincount(at, error[owner] * value, FEATURES) + ridge * weights
            past += slope**2
            past_bias += error.sum() ** 2
            weights -= rate * slope / np.sqrt(past)
            bias -= rate * error.sum() / np.sqrt(past_bias)
    return weights, float(bias)


def calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and shift of the logistic curve over held-out margins, by Newton's method.

    Labels are drawn a little towards each other, as if each class had one more row of the other side.
    """
    bad, good = labels.sum(), (1 - labels).sum()
    target = labels * (bad + 1) / (bad + 2) + (1 - labels) / (good + 2)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * margins + b)
        g = np.array([(p - target) @ margins + 1e-3 * (a - 1), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[w @ margins**2 + 1e-3, w @ margins], [w @ margins, w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.0, a - float(step[0])), b - float(step[1])
        if abs(step).max() < 1e-9:
            break
    return a, b


def fit_scorer(rows: list[Row]) -> Scorer | None:
    """Scorer from rows of (buckets, values, bad); every fifth row calibrates. None where a class is missing."""
    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    if len({r[2] > 0.5 for r in held}) < 2 or len({r[2] > 0.5 for r in used}) < 2:
        return None
    weights, bias = fit_weights(used)
    margins = np.array([weights[at] @ value + bias for at, value, _ in held])
    return Scorer(weights.astype(np.float32).astype(float), bias, *calibrate(margins, np.array([r[2] for r in held])))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality", train_docs: int = TRAIN_DOCS) -> list[Row]:
    """Features and badness of the labelled documents with the smallest hashes of their ids, ``train_docs`` at most."""
    rated = labels.select(labels[id_col].alias("id"), labels[quality].cast("double").alias("good")).dropna().groupBy("id").agg((1 - F.avg("good")).alias("bad"))
    chosen = rated.withColumn("place", F.xxhash64(F.col("id").cast("string"))).orderBy("place", "id").limit(train_docs)
    texts = docs.select(docs[id_col].alias("id"), docs[text].alias("text")).where("text is not null").join(F.broadcast(chosen), "id")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, value = summed_features(batch.column(0)[i].as_py())
                row = [batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([at.astype("<u2").tobytes()]), pa.array([value.astype("<f4").tobytes()])]
                yield pa.RecordBatch.from_arrays(row, ["place", "bad", "at", "value"])

    one = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("place").alias("place"), F.first("bad").alias("bad"))
    found = one.select("text", "place", "bad").mapInArrow(described, "place long, bad double, at binary, value binary").collect()
    return [
        (np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float), r["bad"])
        for r in sorted(found, key=lambda r: (r["place"], r["at"], r["value"]))
    ]


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality",
    train_docs: int = TRAIN_DOCS, reject_from: float = REJECT_FROM,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``bad_probability`` and ``kept``."""
    scorer = fit_scorer(labelled_rows(docs, labels, id_col, text, quality, train_docs))

    @F.arrow_udf("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,bad_probability:double>")
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for value in batch:
                t = value.as_py() or ""
                counts = counted(t)
                rows.append((*counts, None if counts[-1] or scorer is None else scorer.probability(t)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RESULTS[:-1])

    carried = [c for c in docs.columns if c not in RESULTS]
    rated = docs.select(F.struct(*carried).alias("doc"), rate(docs[text]).alias("rating"))
    verdict = ~F.col("rating.base_failed") & (F.coalesce("rating.bad_probability", F.lit(0.0)) < reject_from)
    return rated.select("doc.*", "rating.*", verdict.alias("kept"))
