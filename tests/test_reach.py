"""Stores in reach by shared places, and ranks without rows of (basket, store), against plain joins and windows."""

import random

from pyspark.sql import functions as F

from offerloom.operators import basket, catalog, geo


def stores_and_baskets(spark):
    draw = random.Random(11)
    spots = [(50 + i * 0.05, 8 + (i % 5) * 0.06) for i in range(15)]
    stores = spark.createDataFrame([(i, f"c{draw.randrange(4)}", *draw.choice(spots)) for i in range(120)] + [(900, "c0", None, None)], "store_id long, chain string, lat double, lon double")
    orders = spark.createDataFrame([(b, draw.randrange(121)) for b in range(60)], "basket_id long, store_id long")
    totals = [(b, f"c{c}", draw.randrange(3), draw.randrange(2), draw.choice([None, 1.0, 2.0]), draw.choice([None, 1.0, 2.0])) for b in range(60) for c in range(4) if draw.random() < 0.8]
    return stores, orders, spark.createDataFrame(totals, "basket_id long, chain string, found long, offers long, total double, rank_price double")


def test_ranks_and_nearest_stores_equal_the_plain_way(spark):
    stores, orders, totals = stores_and_baskets(spark)
    placed = geo.shared_places(stores, "store_id")
    pairs = geo.place_pairs(placed, placed, 12.0)
    assert placed.select("place").distinct().count() <= 15 and pairs.count() <= 15 * 15
    homes = orders.join(placed.select("store_id", F.col("place").alias("home")), "store_id").drop("store_id")
    around = pairs.join(placed.select("place", "chain", "store_id"), "place").drop("place")
    plain = geo.radius_join(stores.select(F.col("store_id").alias("home_id"), "lat", "lon"), stores, 12.0)
    reach = orders.withColumnRenamed("store_id", "home_id").join(plain, "home_id").select("basket_id", "store_id", "chain", "distance_km")
    want = basket.rank_stores(basket.store_rows(totals, reach))
    cols = ["basket_id", "store_id", "chain", "rank", "found", "total", "diff", "distance_km"]
    ranked = basket.rank_in_reach(totals, homes, around)
    expected = sorted(map(tuple, want.select(*cols).collect()), key=repr)
    assert sorted(map(tuple, ranked.select(*cols).collect()), key=repr) == expected and len(expected) > 500
    for n in (1, 2, 3):
        near = homes.join(geo.nearest_of_chains(pairs, placed, n), "home").drop("home")
        first = basket.rank_stores(basket.store_rows(totals, near), n)
        assert sorted(map(tuple, first.select(*cols[:-2]).collect()), key=repr) == sorted((r[:6] for r in expected if r[3] <= n), key=repr)
    near = homes.join(geo.nearest_of_chains(pairs, placed, 1), "home").drop("home")
    got = basket.savings(basket.rank_stores(basket.store_rows(totals, near)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, basket.savings(want).collect()))


def test_cities_and_nearest_targets_with_shared_places(spark, monkeypatch):
    draw = random.Random(4)
    spots = [(50 + draw.random(), 8 + draw.random()) for _ in range(12)]
    rows = [(i, draw.choice(["a", "b", None, None]), *draw.choice(spots)) for i in range(150)] + [(900, None, None, None)]
    stores = spark.createDataFrame(rows, "store_id long, city string, lat double, lon double")
    met = []
    plain_join = geo.radius_join
    monkeypatch.setattr(geo, "radius_join", lambda p, t, km: met.append((p.count(), t.count())) or plain_join(p, t, km))
    filled = {r.store_id: r.city for r in geo.fill_missing_city(stores, 20.0).collect()}
    far = geo.nearest(stores.select(F.col("store_id").alias("p"), "lat", "lon"), stores.where("city = 'a'").select(F.col("store_id").alias("t"), "lat", "lon"), "p", "t")
    chosen = {r.p: r.t for r in far.collect()}
    assert met and all(max(sizes) <= 12 for sizes in met)
    pairs = [tuple(r) for r in plain_join(stores.select(F.col("store_id").alias("p"), "lat", "lon"), stores, 500.0).select("p", "store_id", "city", "distance_km").collect()]
    known, named = {}, {}
    for p, s, city, km in pairs:
        if city is not None and km < 20:
            known[p] = min(known.get(p, (99.0, 0, "")), (km, s, city))
        if city == "a":
            named[p] = min(named.get(p, (999.0, 0)), (km, s))
    assert filled == {i: c if c is not None else known[i][2] if i in known else None for i, c, *_ in rows}
    assert chosen == {p: v[1] for p, v in named.items()}


def test_brochures_of_places_once_without_a_distinct_of_pairs(spark):
    draw = random.Random(9)
    stores = [(i, draw.choice("ab"), draw.choice(["1", "2", None])) for i in range(40)] + [(5, "a", "1"), (5, "b", "2"), (6, "a", "1"), (6, "b", "2")]
    papers = [(draw.randrange(20), draw.randrange(40)) for _ in range(60)]
    found = catalog.brochures_of_places(spark.createDataFrame(papers, "brochure_id int, store_id int"), spark.createDataFrame(stores, "store_id int, chain string, postcode string"))
    of = {}
    for s, c, p in stores:
        if p is not None:
            of.setdefault(s, set()).add((c, p))
    want = {(b, s) for b, o in papers for s in of if of[s] & of.get(o, set())}
    want |= {(b, s) for b in {b for b, _ in papers} for s in of if of[s] & set().union(*(of.get(o, set()) for b2, o in papers if b2 == b))}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
