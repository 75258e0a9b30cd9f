import hashlib
import re
from collections import defaultdict

from offerloom.llm import mixing


def brute(rows, weights=(3, 1, 2), share=1.5):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    totals = defaultdict(int)
    for n, (_, _, s) in zip(size, rows, strict=True):
        totals[s] += n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = share * sum(totals.values()) - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 2 * totals[s]}
        if not over:
            break
        target |= {s: 2.0 * totals[s] for s in over}
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    return size, totals, target


def test_targets_and_taken_words(odd_docs, odd_rows):
    size, totals, target = brute(odd_rows)
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == len(odd_rows)
    source = {}
    for (k, t, s), n in zip(odd_rows, size, strict=True):
        source[k, n, totals[s]] = s
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size, r.source_size]
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken <= 2 * r.size and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s, words in taken.items():
        largest = max(n for (_, _, x), n in zip(odd_rows, size, strict=True) if x == s)
        assert abs(words - target[s]) <= 3 * largest
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(odd_docs.repartition(5)).collect()), key=repr)


def test_thresholds_are_exact_to_the_document(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "ab"[i % 2]) for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2)).collect()
    for source_size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4
    h = lambda r: int(hashlib.md5(f"{r.doc_id}|{rows[r.doc_id][1]}".encode()).hexdigest()[:15], 16)
    for odd in (0, 1):
        by_hash = [r.copies for r in sorted((r for r in got if r.doc_id % 2 == odd), key=h)]
        assert by_hash == sorted(by_hash, reverse=True)


def test_rows_are_repeated(odd_docs):
    copies = {}
    for r in mixing.mix_sources(odd_docs).collect():
        copies[r.doc_id, r.size] = copies.get((r.doc_id, r.size), 0) + r.copies
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    found = {}
    for r in mixed.collect():
        k = (r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
        found[k] = found.get(k, 0) + 1
    assert found == {k: n for k, n in copies.items() if n}


def test_no_words_and_no_rows(spark, no_docs):
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix_sources(silent).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
