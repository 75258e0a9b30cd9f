import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerloom.operators import basket, fold, geo, labels, scoring, taxonomy
from offerloom.operators.categories import correct_words
from offerloom.operators.skew import spread_join
from offerloom.sources import brochures, exchange, pages

OFFER = st.tuples(st.sampled_from(["w", "v", None]), st.integers(1, 9), st.integers(1, 9))


@settings(max_examples=300, deadline=None)
@given(st.lists(OFFER, min_size=1, max_size=24), st.integers(1, 6))
def test_segments_equal_one_pass(offers, size):
    rows = [(g, float(u), float(p), i) for i, (g, u, p) in enumerate(offers)]
    best = None
    for i in range(0, len(rows), size):
        best = fold.step(best, json.loads(json.dumps(fold.summarise(rows[i:i + size]))))
    assert best[3] == fold.run_from(rows, 0)


def test_cheapest_in_order_large_and_small(spark):
    rnd = random.Random(5)
    rows = []
    for key in ("a", "b", "c"):
        for i in range(700):
            unit = rnd.choice(["w", "v", None]) if key != "c" else "w"
            rows.append((key, f"{i:05d}", rnd.choice([None, 1.0, 2.0, 3.0, 4.5]), unit, rnd.choice([None, 0.1, 0.2, 0.3]) if unit else None))
    df = spark.createDataFrame(rows, "key string, id string, price double, unit_group string, ppn double")
    want = {}
    for key in ("a", "b", "c"):
        priced = [(u if n is not None else None, n, p, i) for k, i, p, u, n in rows if k == key and p is not None]
        want[key] = priced[fold.run_from(priced, 0)][3]
    for limit in (10_000, 10):  # array pass, then segmented pass
        got = {r.key: r.id for r in fold.cheapest_in_order(df, ["key"], ["id"], ["id", "price"], array_rows=limit).collect()}
        assert got == want


def test_thinning_equals_greedy(spark):
    rnd = random.Random(3)
    places = [(f"p{i:03d}", 50 + rnd.random(), 7 + rnd.random(), rnd.randint(1, 5)) for i in range(80)]
    kept = []
    for p in sorted(places, key=lambda x: (-x[3], x[0])):
        if all(_km(p, k) >= 15 for k in kept):
            kept.append(p)
    df = spark.createDataFrame(places, "id string, lat double, lon double, chains int")
    got = geo.thin_places(df, 15.0, [-F.col("chains")], "id")
    assert sorted(r.id for r in got.collect()) == sorted(k[0] for k in kept)


def _km(a, b):
    from math import asin, cos, radians, sin, sqrt

    x = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0 * asin(sqrt(x))


def test_radius_join_equals_all_pairs(spark):
    rnd = random.Random(9)
    points = [(i, 47 + 8 * rnd.random(), 6 + 9 * rnd.random()) for i in range(60)]
    targets = [(i, 47 + 8 * rnd.random(), 6 + 9 * rnd.random()) for i in range(400)]
    want = {(p[0], t[0]) for p in points for t in targets if _km(p, t) <= 40}
    got = geo.radius_join(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(targets, "t int, lat double, lon double"), 40.0)
    assert {(r.p, r.t) for r in got.collect()} == want


def test_location_kinds(spark):
    df = spark.createDataFrame([("50.7, 7.1",), ("50.7 7.1",), ("53113",), ("53113 Bonn",), ("95, 7",)], "x string")
    got = [r[0] for r in df.select(geo.location_kind(F.col("x"))).collect()]
    assert [(g.kind, g.place) for g in got] == [("coordinates", None), ("coordinates", None), ("postcode", None), ("place", "Bonn"), ("place", "95, 7")]


def _scores(spark, pairs):
    df = spark.createDataFrame(pairs, "q string, text string")
    return {(r.q, r.text): r.score for r in scoring.score_pairs(df).collect()}


def test_match_scores(spark):
    good = [("milch", "Frische Vollmilch"), ("äpfel", "Tafelapfel"), ("joghurt", "Yoghurt Natur"), ("tomaten", "Tomate rot"), ("kartofeln", "Kartoffeln festkochend"), ("marmelade", "Konfitüre Erdbeer")]
    bad = [("eier", "Bier"), ("bananen", "Orangen"), ("wein", "Kaffee")]
    got = _scores(spark, good + bad)
    assert all(got[p] >= 55 for p in good), got
    assert all(got[p] < 55 for p in bad), got


def test_accepted_only_drops_nothing_accepted(spark):
    pairs = [(q, t) for q in ("milch", "haltbare milch", "kartofeln") for t in ("H-Milch 1,5%", "Kartoffeln", "Butter", "Buttermilch")]
    df = spark.createDataFrame(pairs, "q string, text string")
    full = {(r.q, r.text): r.score for r in scoring.score_pairs(df).collect() if r.score >= 55}
    assert {(r.q, r.text): r.score for r in scoring.score_pairs(df, accepted_only=True).collect() if r.score >= 55} == full


def test_containing_words(spark):
    needles = spark.createDataFrame([("milch",), ("m",), ("ch",)], "needle string")
    vocabulary = spark.createDataFrame([("buttermilch",), ("kuchen",), ("x",)], "word string")
    got = {(r.needle, r.word) for r in scoring.containing_words(needles, vocabulary).collect()}
    assert got == {("milch", "buttermilch"), ("m", "buttermilch"), ("ch", "buttermilch"), ("ch", "kuchen")}


def test_spelling(spark):
    terms = spark.createDataFrame([("butter", 5), ("bier", 50), ("kaese", 3)], "term string, freq int")
    tokens = spark.createDataFrame([("butr",), ("keaes",), ("zzzz",)], "token string")
    got = {r.token: r.term for r in correct_words(tokens, terms).collect()}
    assert got["butr"] == "butter" and "zzzz" not in got


def test_merge_chains(spark):
    merges = spark.createDataFrame([(f"m{i}", f"m{i + 1}") for i in range(9)], "source string, target string")
    assert {r.target for r in labels.resolve_merges(merges).collect()} == {"m9"}


def test_read_brochures(spark, tmp_path):
    folder = tmp_path / "chain-a" / "b1"
    folder.mkdir(parents=True)
    (folder / "metadata.json").write_text(json.dumps({"content": {"id": "b1", "publisher": {"name": "Lidl"}, "validFrom": "2024-01-01T00:00:00.000+0000"}}))
    deals = [{"type": "SALES_PRICE", "min": "1,99"}, {"type": "REGULAR_PRICE", "min": 2.99, "currencyCode": "EUR", "priceByBaseUnit": "1 kg = 3.98"}]
    offer = {"content": {"id": "o1", "deals": deals, "products": [{"name": "Milch  3,5%", "brandName": "Hof", "description": [{"paragraph": "frisch"}, {"paragraph": "1 l"}]}]}}
    (folder / "pages.json").write_text(json.dumps({"contents": [{"number": 0, "images": [{"size": "10x10", "url": "a"}, {"size": "20x10", "url": "b"}], "offers": [offer], "linkOuts": []}]}))
    lonely = tmp_path / "chain-a" / "b2"
    lonely.mkdir()
    (lonely / "metadata.json").write_text(json.dumps({"content": {"id": "b2"}}))
    read = brochures.read_brochures(spark, str(tmp_path))
    row = brochures.flatten_offers(read).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.chain_key, r.page_number, r.sales_price, r.regular_price, r.discount_amount, r.discount_percent) == ("chain-a", 1, 1.99, 2.99, 1.0, 33.44)
    assert (r.search_text, r.base_price_text, r.valid_from) == ("Hof Milch 3,5% frisch 1 l", "1 kg = 3.98", "2024-01-01")
    assert brochures.page_manifest(read).first().image_url == "b"


def test_dataset_sink(spark, tmp_path):
    offers = spark.createDataFrame([("c", 1.0), ("c", None)], "chain_key string, sales_price double")
    manifest = spark.createDataFrame([("c", 1)], "chain_key string, page_number int")
    assert tuple(brochures.write_dataset(offers, manifest, str(tmp_path)).first()) == ("c", 1, 2, 1)
    assert spark.read.json(f"{tmp_path}/offers").count() == 2


def test_responses(spark):
    rows = [("a", 200, '```json\n[{"i": 1, "ok": "x"}]\n```'), ("b", 200, '{"items": [{"i": 2}]}'), ("c", 500, "[]"), ("d", 200, "no json"), ("e", 200, '{"0": {"i": 3}}')]
    items, rejects = exchange.response_items(spark.createDataFrame(rows, "custom_id string, status int, content string"))
    assert sorted(r.i for r in items.collect()) == [1, 2, 3]
    assert sorted(r.custom_id for r in rejects.collect()) == ["c", "d"]


def test_bad_embedded_json(spark):
    html = ['<script id="__NEXT_DATA__" type="x">{"a": 1}</script>', '<script id="__NEXT_DATA__">{oops</script>', "<p></p>"]
    df = spark.createDataFrame([(h,) for h in html], "html string")
    assert [r[0] for r in df.select(pages.embedded_json(F.col("html"))).collect()] == ['{"a": 1}', None, None]


def test_merge_cycles_are_errors(spark):
    swap = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    assert {(r.source, r.target) for r in labels.resolve_merges(swap).collect()} == {("a", "b"), ("b", "a")}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    with pytest.raises(ValueError, match="cycle"):
        labels.resolve_merges(ring, rounds=5)


def test_equal_names_of_two_top_categories_stay_apart(spark):
    categories = spark.createDataFrame([("o1", "milch", 3), ("o2", "milch", 4), ("o1", "kaese", 2)], "ober string, name string, n long")
    none = spark.createDataFrame([], "source string, target string")
    groups = spark.createDataFrame([("o1", "molkerei", "milch")], "ober string, group string, child string")
    got = {(r.ober, r.name, r.level, r.parent, r.n) for r in labels.regroup(categories, none, groups).collect()}
    assert got == {
        ("o1", "milch", 3, "molkerei", 3), ("o1", "kaese", 3, "sonstiges/o1", 2), ("o2", "milch", 3, "sonstiges/o2", 4), ("o1", "molkerei", 2, "o1", 3),
        ("o1", "sonstiges/o1", 2, "o1", 2), ("o2", "sonstiges/o2", 2, "o2", 4), ("o1", "o1", 1, None, 5), ("o2", "o2", 1, None, 4),
    }


def test_closure_of_any_depth(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(7)]
    tree = spark.createDataFrame(rows, "category_id string, parent_id string")
    got = {(r.ancestor_id, r.descendant_id, r.depth) for r in taxonomy.closure(tree).collect()}
    assert got == {(f"n{a}", f"n{d}", d - a) for d in range(7) for a in range(d + 1)}
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "category_id string, parent_id string"), deepest=4)


def test_heavy_keys_are_spread(spark):
    big = spark.createDataFrame([(i % 3 if i < 30 else 9, i) for i in range(300)], "k long, v long")
    small = spark.createDataFrame([(k, n) for k in (0, 1, 9, 10) for n in range(2)], "k long, w long")
    got = sorted((r.k, r.v, r.w) for r in spread_join(big, small, ["k"], [F.col("v")], rows_per_task=50).collect())
    assert got == sorted((r.k, r.v, r.w) for r in big.join(small, "k").collect()) and len(got) == 2 * 290


OFFERS = [
    ("o1", "A", "Alt Tilsiter", "Hofgut", 2.0, None, None, "c1"), ("o2", "B", "Tilsiter Scheiben", "Jaeger", 1.5, None, None, "c2"),
    ("o3", "A", "Jasminreis", "Ja", 1.0, None, None, "c3"), ("o4", "B", "Jasminreis", "Gut", 0.9, None, None, "c3"),
]


def test_text_fills_in_where_the_category_finds_nothing(spark):
    offers = spark.createDataFrame(OFFERS, "offer_id string, chain string, product_name string, brand string, price double, unit_group string, ppn double, category_id string")
    names = spark.createDataFrame([("c1", "Tilsiter"), ("c9", "Jasminreis")], "category_id string, name string")
    tree = spark.createDataFrame([("c1", None, 3), ("c9", None, 3)], "category_id string, parent_id string, level int")
    lines = spark.createDataFrame(
        [("b", 1, "Tilsiter", None, True, "c1"), ("b", 2, "", None, True, "c9"), ("b", 3, "Ja Jasminreis", "Ja", False, None), ("b", 4, " ", None, True, None)],
        "basket_id string, item_no int, q string, brand string, any_brand boolean, category_id string",
    )
    clean = basket.normalize_lines(lines, names)
    best = basket.best_by_category(clean, offers, tree)
    got = {(r.item_no, r.chain): (r.offer_id, r.match_type) for r in basket.price_all_lines(clean, best, offers).collect()}
    assert got == {
        (1, "A"): ("o1", None), (1, "B"): ("o2", None), (2, "A"): ("o3", None), (2, "B"): ("o4", None), (3, "A"): ("o3", "exact"), (3, "B"): ("o4", "similar"),
    }
    assert {r.missing for r in basket.chain_totals(basket.price_all_lines(clean, best, offers), clean).collect()} == {0}


def test_short_phrases_reach_what_they_abbreviate(spark):
    queries, texts = spark.createDataFrame([("tk",)], "q string"), spark.createDataFrame([("Tiefkühl Pizza",), ("Brot",)], "text string")
    assert [r.text for r in scoring.candidate_pairs(queries, texts).collect()] == ["Tiefkühl Pizza"]
