import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, row long, vec string, score string"


def brute(rows, every=5, positives=5, n=10, low=30, high=90):
    """The contract with plain loops over whole numbers."""
    whole = []
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole.append((vec_id, [math.floor(256 * x) for x in vec], label))

    def order(r):
        return (-r[1], r[0] is None, r[0] or 0)

    out = []
    for a_id, a, a_label in whole:
        if a_id is None or a_id % every:
            continue
        scored = [(i, max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, v, strict=False)))), lab) for i, v, lab in whole if i != a_id]
        for p_id, p, _ in sorted((r for r in scored if r[2] == a_label), key=order)[:positives]:
            fit = sorted((r for r in scored if r[2] != a_label and low * p <= 100 * r[1] <= high * p), key=order)[:n]
            out += [(a_id, p_id, rank, i, p, s) for rank, (i, s, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 7, "x", "x") for r in rows], SCHEMA).repartition(3)
    got = negatives.mine_negatives(df, F.col("vec_id") % 5 == 0, **kw)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("shape", [(1, 1, 1), (70, 33, 45), (100, 64, 129), (5, 200, 7)])
def test_strassen_is_exact_even_when_sums_wrap(shape):
    draw = np.random.default_rng(4)
    m, k, n = shape
    a, b = draw.integers(-(2**62), 2**62, (m, k)), draw.integers(-1, 2, (k, n))
    for leaf in (1, 8, 32):
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_against_brute_force_over_many_tiles(spark):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0.1, 0.3) for _ in range(12)], draw.randrange(3)) for i in range(160)]
    rows += rows[20:30] + [(None, rows[3][1], 1), (-15, rows[4][1], 0)]
    want = brute(rows)
    assert len(want) > 500
    assert mined(spark, rows, block=7, slice_rows=40) == want
    assert mined(spark, rows) == want


def test_ties_odd_vectors_and_large_numbers(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(12)]
    rows += [(20, None, 1), (21, [1.0, None], 1), (22, [float("nan"), 1.0], 1), (23, [float("inf"), 1.0], 0), (24, [1.0, 1.0], None)]
    rows += [(25, [], 1), (30, [1.0], 0), (31, [0.5, 0.1, 3.0], 1), (35, [-1.0, -1.0], 0), (40, [0.0, 0.0], 1), (41, [1e-9, 0.0], 0)]
    assert mined(spark, rows) == brute(rows)
    huge = [(i, [2.0**30 * (i + 1), 1e300 if i > 7 else 3.0, -1.0], i % 2) for i in range(11)]
    assert mined(spark, huge) == brute(huge)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_windows_round_towards_the_inside():
    for score in range(-50, 50):
        low, high = negatives.window_of(score, 30, 90)
        assert [s for s in range(-60, 60) if 30 * score <= 100 * s <= 90 * score] == list(range(low, high + 1))
