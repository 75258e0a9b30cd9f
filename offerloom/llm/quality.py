"""Quality classifier from weak labels: heuristic labellers, EM for their accuracies, a hashed linear scorer.

Labellers look at a whole text and vote good, bad or nothing. Only the number of documents per
vote pattern matters to the label model (at most 3 ** labellers counts, over all documents), so
expectation-maximisation runs on those counts. The posterior of a document's pattern is its
label for a logistic scorer over hashed features; the scorer is fitted on a sample of at most
``train_docs`` distinct texts and then judges every document by its whole text. A text with
many copies is drawn in proportion to them, and comes in once with a weight.

Defined results: a null or blank text has no words and is rejected with score 1; one too short
for the labellers gets few votes and is kept unless its features speak against it; copies get
equal scores; an empty table gives an empty table; further columns are carried along, but for
those with the names of the results, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 20_000
FEATURES = 1 << 14
ABSTAIN, GOOD, BAD = 0, 1, 2

SYMBOLS = re.compile(r"[%*$#&@^~=_+<>]{2,}")


@dataclass(frozen=True)
class Text:
    """What the labellers look at."""

    n: int
    symbols: float
    shouts: float
    upper: float
    doubled: float
    distinct: float
    bars: float
    short: float
    length: float
    stops: float

    @classmethod
    def of(cls, text: str) -> Text:
        words = text.split()
        n = len(words)
        d = n or 1
        sizes = np.fromiter(map(len, words), np.int64, n)
        return cls(
            n, len(SYMBOLS.findall(text)) / d, text.count("!!") / d, sum(map(str.isupper, words)) / d, sum(map(eq, words, words[1:])) / d,
            len(set(words)) / d, (text.count("|") + text.count("\t")) / d, sum(map(str.isalpha, (w for w in words if len(w) < 4))) / d,
            float(sizes.sum()) / d, (text.count(".") + text.count("?") + text.count("!")) / d,
        )


def _between(value: float, bad_from: float, good_to: float) -> int:
    return BAD if value >= bad_from else GOOD if value <= good_to else ABSTAIN


#: Each labeller's name and vote; they overlap, and none is right everywhere.
LABELLERS: list[tuple[str, Callable[[Text], int]]] = [
    ("symbol runs", lambda t: _between(t.symbols, 0.1, 0.01)),
    ("exclamations", lambda t: _between(t.shouts, 0.1, 0.01)),
    ("capitals", lambda t: ABSTAIN if t.n < 10 else _between(t.upper, 0.3, 0.1)),
    ("doubled words", lambda t: ABSTAIN if t.n < 20 else _between(t.doubled, 0.3, 0.1)),
    ("vocabulary", lambda t: ABSTAIN if t.n < 20 else _between(1 - t.distinct, 0.9, 0.5)),
    ("table bars", lambda t: _between(t.bars, 0.15, 0.02)),
    ("function words", lambda t: ABSTAIN if t.n < 30 else _between(-t.short, -0.02, -0.08)),
    ("word length", lambda t: ABSTAIN if t.n < 20 else GOOD if 3.5 <= t.length <= 8 else BAD),
    ("sentences", lambda t: ABSTAIN if t.n < 30 else BAD if t.stops < 0.005 else _between(t.stops, 0.6, 0.3)),
]


def votes_of(text: Text) -> int:
    """The votes as one number in base 3."""
    return sum(vote(text) * 3**i for i, (_, vote) in enumerate(LABELLERS))


@dataclass(frozen=True)
class LabelModel:
    """Share of bad documents and, by class (good, bad) and labeller, how often a vote is for bad. No vote is no evidence."""

    bad_share: float
    bad_votes: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of being bad; ``votes`` has a row per pattern and a column per labeller."""
        for_bad, for_good = (np.log(x[1]) - np.log(x[0]) for x in (self.bad_votes, 1 - self.bad_votes))
        return math.log(self.bad_share / (1 - self.bad_share)) + np.where(votes == BAD, for_bad, 0).sum(axis=1) + np.where(votes == GOOD, for_good, 0).sum(axis=1)

    def posterior(self, pattern: int) -> float:
        """Probability that a document with these votes is bad."""
        return float(_sigmoid(self.log_odds(_digits(np.array([pattern]))))[0])

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes, if it votes on both classes alike."""
        right = (1 - self.bad_share) * (1 - self.bad_votes[0]) + self.bad_share * self.bad_votes[1]
        return {name: float(r) for (name, _), r in zip(LABELLERS, right, strict=True)}


def _digits(patterns: np.ndarray) -> np.ndarray:
    return np.stack([(patterns // 3**i) % 3 for i in range(len(LABELLERS))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit_label_model(counts: dict[int, int], rounds: int = 500, prior_docs: float = 100.0) -> LabelModel:
    """EM over vote patterns.

    The start also counts as ``prior_docs`` documents: a vote for bad hardly ever falls on a good
    text, while each labeller sees only some kinds of bad ones.
    """
    start = np.repeat(np.array([[0.002], [0.3]]), len(LABELLERS), axis=1)
    model = LabelModel(0.1, start)
    if not counts:
        return model
    patterns = np.array(sorted(counts))
    weight, votes = np.array([counts[p] for p in patterns], float), _digits(patterns)
    for _ in range(rounds):
        bad = _sigmoid(model.log_odds(votes))
        both = np.stack([1 - bad, bad]) * weight
        for_bad = both @ (votes == BAD) + prior_docs * start
        given = both @ (votes != ABSTAIN) + prior_docs
        share = float((both[1].sum() + prior_docs * 0.1) / (weight.sum() + prior_docs))
        ended = abs(share - model.bad_share) < 1e-9
        model = LabelModel(share, for_bad / given)
        if ended:
            break
    return model


# Features and scorer

#: Class of each byte: white space, line end, letters and bytes beyond ASCII, capitals, digits; other signs stand for themselves.
CLASS = np.array(
    [1 if b in (10, 13) else 0 if b <= 32 else 4 if 48 <= b <= 57 else 3 if 65 <= b <= 90 else 2 if b >= 128 or 97 <= b <= 122 else 5 + b % 59 for b in range(256)], np.int64
)


def features(text: str, about: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: how often each triple of byte classes stands in the text (runs count two at most), and bins of the measures."""
    codes = CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if len(codes) > 2:
        codes = codes[np.concatenate([[True, True], (codes[2:] != codes[1:-1]) | (codes[2:] != codes[:-2])])]
    triples = (codes[:-2] * 4096 + codes[1:-1] * 64 + codes[2:]) if len(codes) > 2 else np.zeros(0, np.int64)
    at, n = np.unique(triples, return_counts=True)
    size = max(about.n, 1)
    bins = [int(10 * about.doubled), int(10 * about.distinct), int(20 * min(1.0, about.short)), min(20, int(about.length)), min(12, size.bit_length())]
    named = np.array([2**20 + 64 * i + b for i, b in enumerate(bins)])
    keys = np.concatenate([at, named]).astype(np.uint64)
    hashed = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    return hashed, np.concatenate([4.0 * n / max(1, n.sum()), np.ones(len(bins))])


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str, about: Text) -> float:
        at, value = features(text, about)
        return float(_sigmoid(self.weights[at] @ value + self.bias))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-5, weight: list[float] | None = None) -> Scorer:
    """Logistic regression on posterior labels by full-batch AdaGrad; a row counts as often as its ``weight``, or once."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not rows:
        return Scorer(weights, -2.0)
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    label = np.array([r[2] for r in rows])
    part = np.ones(len(rows)) if weight is None else np.array(weight, float)
    part /= part.sum()
    past, past_bias = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(rounds):
        margin = np.bincount(owner, weights[at] * value, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - label) * part
        slope = np.bincount(at, error[owner] * value, FEATURES) + ridge * weights
        past += slope**2
        past_bias += error.sum() ** 2
        weights -= rate * slope / np.sqrt(past)
        bias -= rate * error.sum() / math.sqrt(past_bias)
    return Scorer(weights, float(bias))


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Documents by vote pattern, over all of them; added up in every task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[int] = Counter()
        for batch in batches:
            found.update(votes_of(Text.of(t or "")) for t in batch["text"])
        yield pd.DataFrame({"pattern": list(found.keys()), "n": list(found.values())}, dtype="int64")

    counted = docs.select(docs[text].alias("text")).mapInPandas(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in counted.collect()}


def draw(docs: DataFrame, share: float, most: int, text: str = "text") -> DataFrame:
    """(h, weight): hashes of at most ``most`` distinct texts and how many sampled documents each stands for.

    A text with n copies is drawn with probability n * ``share``, where that is under 1, and else
    for certain with weight n * ``share``. The limit takes the smallest values of hash / n.
    """
    counted = docs.select(F.xxhash64(docs[text]).alias("h")).where(docs[text].isNotNull()).groupBy("h").agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned("h", 11) / F.lit(2.0**53) / F.col("n")
    drawn = counted.select("h", place.alias("place"), F.greatest(F.lit(1.0), F.col("n") * share).alias("weight")).where(F.col("place") < share)
    return drawn.orderBy("place", "h").limit(most).select("h", "weight")


def fit(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS) -> tuple[LabelModel, Scorer]:
    """Both models from the documents; no given labels are read."""
    counts = pattern_counts(docs, text)
    model = fit_label_model(counts)
    chosen = draw(docs, min(1.0, train_docs / max(1, sum(counts.values()))), train_docs, text)
    part = docs.select(F.xxhash64(docs[text]).alias("h"), docs[text].alias("text")).where("text is not null").join(F.broadcast(chosen), "h")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for h, t, weight in zip(batch["h"], batch["text"], batch["weight"], strict=True):
                if h in seen:
                    continue
                seen.add(h)
                about = Text.of(t)
                at, value = features(t, about)
                rows.append((h, weight, votes_of(about), at.astype("<i4").tobytes(), value.astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["h", "weight", "pattern", "at", "value"])

    known = {p: model.posterior(p) for p in counts}
    one = F.max(F.struct("weight", "pattern", "at", "value")).alias("r")
    found = part.select("h", "text", "weight").mapInPandas(sample, "h long, weight double, pattern long, at binary, value binary").groupBy("h").agg(one).collect()
    rows = [x["r"] for x in sorted(found, key=lambda x: x["h"])]
    return model, fit_scorer(
        [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float), known[r["pattern"]]) for r in rows], weight=[r["weight"] for r in rows]
    )


def judge(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, reject_from: float = 0.5) -> DataFrame:
    """``docs`` with ``votes`` (base 3), ``posterior`` and ``score`` of being bad, and ``accepted``."""
    model, scorer = fit(docs, text, train_docs)

    @F.pandas_udf("struct<votes:long,posterior:double,score:double>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[int, float] = {}
        for batch in batches:
            rows = []
            for t in batch:
                about = Text.of(t or "")
                pattern = votes_of(about)
                if pattern not in known:
                    known[pattern] = model.posterior(pattern)
                rows.append((pattern, known[pattern], scorer.score(t, about) if about.n else 1.0))
            yield pd.DataFrame(rows, columns=["votes", "posterior", "score"])

    kept = [c for c in docs.columns if c not in ("votes", "posterior", "score", "accepted")]
    rated = docs.select(F.struct(*kept).alias("doc"), rate(docs[text]).alias("rating"))
    return rated.select("doc.*", "rating.*", (F.col("rating.score") < reject_from).alias("accepted"))
