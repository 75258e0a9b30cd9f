"""Shared steps do their work once: wishes, classes, offers and pairs of places."""

from pyspark.sql import functions as F

from offerloom.operators import basket, geo
from offerloom.plans.views import Tables

OFFER = "offer_id string, chain string, product_name string, brand string, price double, unit_group string, ppn double, category_id string"


def offers_of(spark):
    rows = [(f"o{i}", f"c{i % 2}", f"{name} {i}", brand, 1.0 + i, None, None, f"r/{name}") for i, (name, brand) in enumerate([("milk", "A"), ("milk", None), ("bread", "B"), ("butter milk", "A")] * 3)]
    return spark.createDataFrame(rows, OFFER)


def met_rows(monkeypatch):
    sizes, plain = [], basket.cheapest_in_order
    monkeypatch.setattr(basket, "cheapest_in_order", lambda rows, *rest: sizes.append(rows.count()) or plain(rows, *rest))
    return sizes


def test_equal_wishes_meet_offers_once(spark, monkeypatch):
    offers, sizes = offers_of(spark), met_rows(monkeypatch)
    asked = [("milk", None), ("milk", "A"), ("bread", None)]
    one = spark.createDataFrame([(f"s{i}", *a) for i, a in enumerate(asked)], "spec string, q string, brand string")
    many = spark.createDataFrame([(f"s{i}-{k}", *a) for i, a in enumerate(asked) for k in range(20)], "spec string, q string, brand string")
    few = {(r.spec, r.chain): (r.offer_id, r.price, r.score) for r in basket.best_by_text(one, offers).collect()}
    got = {(r.spec, r.chain): (r.offer_id, r.price, r.score) for r in basket.best_by_text(many, offers).collect()}
    assert few and got == {(f"{s}-{k}", c): v for (s, c), v in few.items() for k in range(20)}
    assert sizes[0] == sizes[1] > 0


def test_only_the_first_class_of_a_chain_is_compared(spark, monkeypatch):
    rows = [(f"m{i}", "c0", "milk", "A", 2.0 + i, None, None, "r/g/milk") for i in range(3)] + [(f"b{i}", "c0", "bread", "A", 1.0, None, None, "r/g/bread") for i in range(9)]
    rows += [("b9", "c1", "bread", "A", 1.0, None, None, "r/g/bread")]
    tree = [("r", "r", 1, None), ("r/g", "g", 2, "r"), ("r/g/milk", "milk", 3, "r/g"), ("r/g/bread", "bread", 3, "r/g")]
    categories = spark.createDataFrame(tree, "category_id string, name string, level int, parent_id string")
    wanted, sizes = spark.createDataFrame([("r/g", "milk")], "category_id string, q string"), met_rows(monkeypatch)
    found = basket.best_by_category(wanted, spark.createDataFrame(rows, OFFER), categories)
    assert {(r.chain, r.offer_id, r["class"]) for r in found.collect()} == {("c0", "m0", 3), ("c1", "b9", 4)}
    assert sizes == [4]


def test_offers_are_deduplicated_once_and_keys_made_per_part(spark):
    plan = Tables(spark, "/root/testdata/sf0.001").offers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(") == 1


def test_pairs_of_few_places_are_made_by_all_tasks(spark):
    spots = spark.createDataFrame([(i, 50 + i * 0.01, 8.0) for i in range(40)], "store_id long, lat double, lon double")
    placed = geo.shared_places(spots, "store_id")
    pairs = geo.place_pairs(placed, placed, 25.0)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pairs.where(F.col("home") == F.col("place")).count() == 40
