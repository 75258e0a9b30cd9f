"""Exact typo search and the score bounds, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from offerloom.functions.ratios import partial_ratio, token_set_ratio
from offerloom.operators import scoring, search, typos


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def limit(word):
    return 0 if len(word) < 3 else 1 if len(word) < 8 else 2


def has_window(form, span):
    k = limit(form)
    return any(edits(form, span[i : i + n]) <= k for i in range(len(span) + 1) for n in range(max(0, len(form) - k), len(form) + k + 1) if i + n <= len(span))


def test_close_spans_find_every_window_within_the_limit(spark):
    draw = random.Random(4)
    words = {"".join(draw.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 14, 18) for _ in range(4)}
    forms = sorted(words)
    spans = {" ".join(draw.sample(forms, draw.randrange(1, 4))) for _ in range(60)}
    for w in forms:
        for _ in range(3):
            t = list(w)
            for _ in range(draw.randrange(1, 4)):
                i = draw.randrange(len(t) + 1)
                t[i : i + draw.randrange(2)] = draw.choice(["", "c", " ", "bx"])
            spans.add("".join(t).strip() or "x")
    spans = sorted(spans)
    got = typos.close_spans(spark.createDataFrame([(w,) for w in forms], "form string"), spark.createDataFrame([(s,) for s in spans], "span string"))
    want = {(f, s) for f in forms for s in spans if has_window(f, s)}
    assert {tuple(r) for r in got.collect()} == want and 500 < len(want) < len(forms) * len(spans)


def test_typo_search_crosses_spaces_and_has_no_length_limit(spark):
    forms = spark.createDataFrame(
        [("a", 1, 0, "milchbar"), ("b", 1, 0, "donaudampfschifffahrt"), ("c", 2, 0, "gizmo"), ("c", 2, 1, "red"), ("d", 1, 0, "ab")], "q string, n_tokens int, token_no int, form string"
    )
    texts = spark.createDataFrame([("Milch Bar",), ("Donaudampfshiffahrt",), ("red gizzmo",), ("blue gizmo",), ("cabin",)], "text string")
    assert {tuple(r) for r in typos.typo_search(forms, texts).collect()} == {("a", "Milch Bar"), ("b", "Donaudampfshiffahrt"), ("c", "red gizzmo"), ("d", "cabin")}


def test_ratio_bounds_hold_and_are_exact_where_one_text_holds_the_other(spark):
    draw = random.Random(9)
    words = ["milch", "bio", "vollmilch", "butter", "h", "kaese", "gouda", "jung", "1", "5", "ab"]
    pairs = {(" ".join(draw.choices(words, k=draw.randrange(1, 4))), " ".join(draw.choices(words, k=draw.randrange(1, 6)))) for _ in range(400)}
    df = spark.createDataFrame(sorted(pairs), "qv string, ov string")
    low, high = scoring.ratio_bounds()
    rows = df.select("qv", "ov", low.alias("low"), high.alias("high")).collect()
    for r in rows:
        exact = 0.5 * token_set_ratio(r.qv, r.ov) + 0.5 * partial_ratio(r.qv, r.ov)
        assert r.low - 1e-9 <= exact <= r.high + 1e-9, r
        if set(r.qv.split()) <= set(r.ov.split()) and r.qv in r.ov:
            assert r.low == r.high == 100.0
    assert sum(r.low == r.high for r in rows) > 20


@pytest.fixture(scope="module")
def shop(spark):
    draw = random.Random(2)
    names = ["red widget", "blue widget", "red gizmo large", "gizmo", "widget holder", "old plate"]
    rows = [
        (f"o{i:04d}", f"c{i % 4}", draw.choice(names), f"brand {i % 5}", draw.choice(["fresh", "pack of 2", None]), f"cat/{draw.choice(['gizmo', 'widget', 'plate'])}",
         draw.choice([None, 1.0, 2.5, 3.0]), 4.0) for i in range(300)
    ]
    offers = spark.createDataFrame(rows, "offer_id string, chain string, product_name string, brand string, description string, category_id string, sales_price double, regular_price double")
    asked = spark.createDataFrame([(q,) for q in ("widget", "red gizzmo", "brand 3 widget", "plate old", "gizmo", "nothing")], "q string")
    return asked, offers


def test_top_hits_are_the_first_of_all_hits(spark, shop):
    asked, offers = shop
    texts = F.concat_ws(" ", "brand", "product_name"), F.concat_ws(" ", "brand", "product_name", F.coalesce("description", F.lit("")))
    every = search.ranked_hits(asked, offers, *texts).collect()
    top, wanted = search.top_hits(asked, offers, *texts, 3)
    got = {(r.q, r["rank"]): (r.offer_id, round(r.score, 6)) for r in top.collect()}
    want = {}
    for q in {r.q for r in every}:
        mine = sorted((r for r in every if r.q == q), key=lambda r: (-(round(r.score, 6) + (r.sales_price is not None)), r.sales_price is None, r.sales_price or 1e9, r.offer_id))
        want |= {(q, i): (r.offer_id, round(r.score, 6)) for i, r in enumerate(mine[:3], 1)}
    assert got == want and len(want) > 9
    assert wanted.count() < scoring.candidate_pairs(asked, offers.select(F.explode(F.array(*texts)).alias("text")).distinct()).count()


def test_bm25_top_is_the_head_of_the_full_ranking(spark, shop):
    asked, offers = shop
    index = search.postings(offers, "offer_id", {"name": F.col("product_name"), "brand": F.col("brand"), "description": F.col("description")})
    full = sorted((r.q, round(r.score, 6), r.offer_id) for r in search.bm25(asked, index, "offer_id").collect())
    got = sorted((r.q, r.score, r.offer_id) for r in search.bm25_top(asked, index, "offer_id", 4).collect())
    want = [x for q in sorted({x[0] for x in full}) for x in [x for x in full if x[0] == q][:4]]
    assert [(q, i) for q, _, i in got] == [(q, i) for q, _, i in want] and len(got) >= 8
