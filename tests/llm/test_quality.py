import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import quality

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_accuracy_on_given_labels(spark):
    """No label was read in training, so all labelled documents are held out."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = quality.judge(docs.select("doc_id", "text")).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    good = [r.accepted for r in rows if r.quality == 1]
    bad = [r.accepted for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_odd_documents(odd_docs, odd_rows):
    judged = quality.judge(odd_docs)
    assert judged.columns == [c for c in odd_docs.columns if c != "score"] + ["votes", "posterior", "score", "accepted"]
    rows = judged.collect()
    assert len(rows) == len(odd_rows)
    scores = {}
    for r in rows:
        scores.setdefault(r.text or "", set()).add(r.score)
        assert (r.score == 1.0 and not r.accepted) if not (r.text or "").strip() else 0 <= r.score <= 1
    assert all(len(s) == 1 for s in scores.values())


def test_no_rows(no_docs):
    assert quality.judge(no_docs).count() == 0


def test_label_model_finds_accuracies():
    """Synthetic votes of labellers with known rates; the rates come back without labels."""
    draw = np.random.default_rng(0)
    n, k = 40_000, len(quality.LABELLERS)
    bad = draw.random(n) < 0.15
    rate = np.where(bad[:, None], np.linspace(0.2, 0.7, k), np.linspace(0.001, 0.02, k))
    votes = np.where(draw.random((n, k)) < rate, quality.BAD, quality.GOOD)
    votes[draw.random((n, k)) < 0.2] = quality.ABSTAIN
    codes, counts = np.unique(votes @ 3 ** np.arange(k), return_counts=True)
    model = quality.fit_label_model(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    assert model.bad_share == pytest.approx(0.15, abs=0.02)
    assert model.bad_votes[1] == pytest.approx(np.linspace(0.2, 0.7, k), abs=0.06)
    assert set(model.accuracies()) == {name for name, _ in quality.LABELLERS}


def test_clean_texts_alone_are_kept(spark):
    docs = spark.createDataFrame([(i, f"The plain text number {i} says a few things in order. It ends here, as it should.") for i in range(50)], "doc_id long, text string")
    assert quality.judge(docs).where("not accepted").count() == 0


def test_sample_is_bounded_with_many_copies(spark, monkeypatch):
    """Texts of the smallest hashes, each with a third of all rows, come in once and with the weight of their copies."""
    ids = spark.range(3000).select(F.concat(F.lit("hot text "), "id").alias("text"))
    hot = [r.text for r in ids.orderBy(F.shiftrightunsigned(F.xxhash64("text"), 1)).limit(2).collect()]
    rows = [(t,) for t in hot * 200] + [(f"single text {i}",) for i in range(200)]
    held, fitted = [], quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, **kw: held.append((rows, kw.get("weight"))) or fitted(rows, **kw))
    quality.fit(spark.createDataFrame(rows, "text string").repartition(3), train_docs=30)
    (sample, weight), = held
    assert 2 < len(sample) <= 30
    assert sorted(weight)[-2:] == [10.0, 10.0] and set(sorted(weight)[:-2]) == {1.0}
