import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from offerloom.llm import suffix


def brute(texts, span):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def assert_same(docs, rows, span, gram):
    want = Counter((k, *w) for (k, *_), w in zip(rows, brute([r[1] for r in rows], span), strict=True))
    got = suffix.remove_repeats(docs, span, gram).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_odd_documents(odd_docs, odd_rows):
    assert_same(odd_docs, odd_rows, 200, 64)


@pytest.mark.parametrize("crowd", [1, 2_000])
def test_random_texts_of_few_letters(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    draw = random.Random(11)
    parts = ["".join(draw.choice("abcd") for _ in range(draw.randrange(15, 60))) for _ in range(12)]
    rows = [(i, "".join(draw.choice(parts) if draw.random() < 0.5 else "".join(draw.choice("abcd") for _ in range(20)) for _ in range(draw.randrange(8)))) for i in range(120)]
    rows += [(200, "ab" * 100), (201, "a" * 90), (202, "é" * 40)]
    assert_same(spark.createDataFrame(rows, "doc_id long, text string"), rows, 24, 8)


def test_long_texts_are_read_in_blocks(monkeypatch):
    draw = np.random.default_rng(2)
    data = draw.integers(97, 101, 3000).astype(np.uint8)
    whole = suffix.anchors_of(data, 40, 12)
    monkeypatch.setattr(suffix, "BLOCK", 500)
    parts = suffix.anchors_of(data, 40, 12)
    strings = lambda found: sorted((int(at) - n, int(at)) for at, lo, hi in zip(*found[:3], strict=True) for n in range(lo, hi + 1))
    assert strings(whole) == strings(parts) and [s for s, _ in strings(whole)] == list(range(3000 - 40 + 1))


def test_no_rows_and_kept_bytes(spark, no_docs):
    assert suffix.remove_repeats(no_docs).count() == 0
    rows = [(1, "x" * 300 + "end"), (2, "unlike")]
    kept = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()}
    assert kept == {1: b"end", 2: b"unlike"}


def test_maximal_repeats_have_all_occurrences():
    """Against every pair of contexts: a group's members agree so far on both sides, and no further all together."""
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randrange(2, 9)
        lefts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(6))) for _ in range(n)]
        rights = [b"ANCHOR" + bytes(draw.choice(b"ab") for _ in range(draw.randrange(6))) for _ in range(n)]
        span = draw.randrange(6, 14)
        groups = {(left, right, tuple(sorted(m))) for left, right, m in suffix.repeat_groups(lefts, rights, span)}
        agree = lambda i, j: (suffix.common_prefix(lefts[i], lefts[j]), suffix.common_prefix(rights[i], rights[j]))
        want = defaultdict(set)
        for i in range(n):
            for j in range(n):
                if i != j and sum(agree(i, j)) >= span:
                    left, right = agree(i, j)
                    want[i].add((left, right))
                    members = tuple(x for x in range(n) if x == i or (agree(i, x)[0] >= left and agree(i, x)[1] >= right))
                    assert (left, right, members) in groups
        for left, right, members in groups:
            assert left + right >= span and len(members) > 1
        cover = suffix.covered(lefts, rights, span)
        assert cover == [(max((a for a, _ in want[i]), default=0), max((b for _, b in want[i]), default=0)) for i in range(n)]
