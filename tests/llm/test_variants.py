import random
import re
import zlib
from collections import Counter

import pytest

from offerloom.llm import variants


def one_edit(a, b):
    """Whether b comes from a by one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a[i + (len(a) == len(b)) :] == b[i + 1 :] for i in range(len(b)) if a[:i] == b[:i])


def brute(docs, slip=199):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 5 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), near


def found(spark, docs, schema="doc_id long, text string", **kw):
    df = spark.createDataFrame(docs, schema).repartition(3)
    return sorted(tuple(r) for r in variants.spelling_variants(df, **kw).collect())


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdeä") for _ in range(draw.randrange(6, 10))) for _ in range(40)] + ["größer", "÷×÷×÷×", "abcabc", "Z" * 300]
    words = []
    for w in base:
        words += [w] * draw.choice([5, 30, 160])
        for _ in range(6):
            i, c = draw.randrange(len(w) + 1), draw.choice("abcdeäÿ")
            changed = draw.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            words += [changed.title() if draw.random() < 0.5 else changed] * draw.choice([1, 5, 6, 30])
    words += ["chained"] * 8 + ["chainee"] * 80 + ["chaineee"] * 900
    words += ["prefix" + "".join(draw.choice("ab") for _ in range(4)) for _ in range(400)]
    draw.shuffle(words)
    return [(i, " ".join(words[i * 20 : i * 20 + 20]) + draw.choice([" ", "\n", "1x "])) for i in range(len(words) // 20 + 1)] + [(None, words[0]), (7, None), (8, "")]


def test_against_brute_force(spark, docs):
    for kw in ({}, {"block": 3}, {"slip": 7, "block": 50}):
        want, near = brute(docs, kw.get("slip", 199))
        assert found(spark, docs, **kw) == want
        assert sum(map(len, near.values())) > 300 and any(r[1] for r in want) and any(r[2] != r[0] and r[2] != r[1] for r in want)


def test_strips_of_bounded_size_change_nothing(spark, docs, monkeypatch):
    words = sorted({w.lower() for _, t in docs for w in re.findall("[A-Za-zäöü]{6,}", t or "")})
    whole = [x.tolist() for x in variants.tile(words, [1] * len(words), [0] * len(words), True)]
    monkeypatch.setattr(variants, "CELLS", 100)
    assert [x.tolist() for x in variants.tile(words, [1] * len(words), [0] * len(words), True)] == whole


def test_odd_rows(spark, odd_rows):
    rows = [(k, t, "clash", "clash", 1) for k, t, _ in odd_rows]
    assert found(spark, rows, "doc_id long, text string, word string, run string, n int") == brute([r[:2] for r in rows])[0]
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), min_length=5)
