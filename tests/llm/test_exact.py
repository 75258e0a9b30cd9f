import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from offerloom.llm import bloom, exact


def test_groups_match_brute_force(odd_docs, odd_rows):
    by_text = defaultdict(list)
    for k, t, _ in odd_rows:
        by_text[t or ""].append(k)
    got = exact.exact_groups(odd_docs).collect()
    assert len(got) == len(odd_rows)
    kept = defaultdict(int)
    for r in got:
        group = next(v for t, v in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group)
        assert r.keep_id == max((k for k in group if k is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_rows_of_distinct_texts(odd_docs, odd_rows):
    got = exact.drop_repeats(odd_docs)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    want = {}
    for k, t, _ in odd_rows:
        want[t or ""] = max((x for x in (k, want.get(t or "")) if x is not None), default=None)
    assert {r.text or "": r.doc_id for r in rows} == want and len(rows) == len(want)
    assert {r["h"] for r in rows} == {"clash"}


def test_empty_table(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.drop_repeats(no_docs).count() == 0


def test_filter_never_misses(spark):
    rows = spark.range(4000).select(F.xxhash64(F.col("id") % 3000).alias("h"), (F.col("id") % 3000).alias("k"))
    twice = {r.k for r in rows.groupBy("k").count().where("count > 1").collect()}
    for blocks in (1, 3):
        marked = bloom.flagged(rows, "h", bloom.repeated_filter(rows, "h", blocks), blocks).where("__maybe")
        found = {r.k for r in marked.select("k").distinct().collect()}
        assert twice <= found and len(found) < 2500
    present = bloom.present_filter(rows.where("k < 100"), "h", 2)
    found = {r.k for r in bloom.flagged(rows, "h", present, 2).where("__maybe").select("k").distinct().collect()}
    assert set(range(100)) <= found and len(found) < 130
