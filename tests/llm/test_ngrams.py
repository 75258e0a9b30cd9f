import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import ngrams

GOOD = "the quiet river runs past old stone houses and people walk along its banks in the evening light".split()


def slow_counts(text):
    """The contract, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 20 or 100 * len(again) > 30 * n


def test_counts_against_the_contract():
    draw = random.Random(3)
    texts = ["", None, " \t\n", "one", "a b c d e f g h", "a " * 9, "a b c d e f g h " * 2, "x\n\nx\n x\n \n \n", "ß\x0bü\x0c☃ \x85   x", "#*$%&|<>" * 3]
    texts += [" ".join(draw.choice("ab") for _ in range(n)) + "\n" + "p q " * draw.randrange(3) for n in range(1, 60)]
    texts += ["\n".join(" ".join(draw.choice("abcdef") for _ in range(draw.randrange(6))) for _ in range(30)) for _ in range(20)]
    for text in texts:
        assert ngrams.counted(text or "") == slow_counts(text), text


def _bad(draw):
    kind = draw.randrange(3)
    words = [draw.choice(GOOD) for _ in range(40)]
    return " ".join(w.upper() + "!!" if kind == 0 else w + "$$$" if kind == 1 else f"{w} |" for w in words)


@pytest.fixture(scope="module")
def rated(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(GOOD) for _ in range(60)) if i % 4 else _bad(draw)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.where("doc_id < 300").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))


def test_unlabelled_rows_are_told_apart(spark, rated):
    docs, labels = rated
    got = ngrams.judge(docs, labels).where("doc_id >= 300 and not base_failed").collect()
    right = [r["kept"] == (r["doc_id"] % 4 > 0) for r in got]
    assert len(right) > 250 and np.mean(right) > 0.98


def test_probabilities_are_calibrated():
    """Held-out margins whose odds are known: the curve gives the odds back."""
    draw = np.random.default_rng(1)
    margins = draw.normal(size=20000) * 3
    labels = (draw.random(20000) < 1 / (1 + np.exp(-(0.5 * margins + 0.7)))).astype(float)
    slope, shift = ngrams.calibrate(margins, labels)
    assert abs(slope - 0.5) < 0.03 and abs(shift - 0.7) < 0.05


def test_training_sample_is_bounded_and_the_same_again(spark, rated):
    docs, labels = rated
    twice = docs.unionByName(docs)
    first = ngrams.labelled_rows(twice.repartition(5), labels, train_docs=50)
    second = ngrams.labelled_rows(twice.repartition(2), labels.unionByName(labels), train_docs=50)
    assert len(first) == 50 and all((a[0] == b[0]).all() and a[2] == b[2] for a, b in zip(first, second, strict=True))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(0, 1), (None, 0), (1, None), (12345, 0)], "doc_id long, quality int")
    rows = ngrams.judge(odd_docs.withColumn("n_words", F.lit("clash")), labels).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        counts = slow_counts(r["text"]) if len(r["text"] or "") < 9000 else ngrams.counted(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts
        assert r["kept"] == (not r["base_failed"]) and r["bad_probability"] is None
    assert ngrams.judge(no_docs, labels).count() == 0
    assert ngrams.judge(odd_docs, labels.limit(0)).count() == len(odd_rows)
