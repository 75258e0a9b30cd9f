"""Queries over shopping baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions.geo import haversine_sql
from offerloom.functions.numbers import round_to, round_to_sql
from offerloom.operators import basket, geo
from offerloom.plans.registry import query
from offerloom.plans.sqltext import norm_sql
from offerloom.plans.views import VIEWS, Tables
from offerloom.session import cut_lineage, stored

REACH_KM = 25.0

VIEWS["expansion"] = """
SELECT x.ancestor_id AS category_id, x.descendant_id AS member_id FROM closure x JOIN categories c ON c.category_id = x.ancestor_id
WHERE NOT (c.level = 1 AND x.depth = 0)"""
VIEWS["best_offers"] = f"""
SELECT category_id, q, chain, arg_min(w, class).offer_id AS offer_id, arg_min(w, class).product_name AS product_name, arg_min(w, class).brand AS offer_brand,
 arg_min(w, class).price AS price, arg_min(w, class).unit_group AS unit_group, arg_min(w, class).ppn AS ppn, min(class) AS class FROM (
 SELECT category_id, q, chain, class, list_reduce(list({{'offer_id': offer_id, 'product_name': product_name, 'brand': brand, 'price': price, 'unit_group': unit_group, 'ppn': ppn}}
  ORDER BY product_name, offer_id), lambda a, x: CASE WHEN (CASE WHEN a.unit_group = x.unit_group AND a.ppn IS NOT NULL AND x.ppn IS NOT NULL
  THEN x.ppn < a.ppn ELSE x.price < a.price END) THEN x ELSE a END) AS w
 FROM (SELECT m.category_id, m.q, o.chain, o.offer_id, o.product_name, o.brand, o.sales_price AS price, o.unit_group, o.ppn,
   CASE WHEN m.member_id = m.category_id THEN CASE WHEN fits THEN 1 ELSE 2 END WHEN fits THEN 3 ELSE 4 END AS class
  FROM (SELECT s.category_id, s.q, x.member_id, p.product_key, len(list_intersect(s.ww, p.pw)) >= 0.5 * len(s.ww) AS fits
    FROM (SELECT DISTINCT category_id, q, list_distinct(string_split({norm_sql('q')}, ' ')) AS ww FROM basket_lines) s
    JOIN expansion x ON x.category_id = s.category_id
    JOIN (SELECT DISTINCT category_id, product_key, list_distinct(string_split({norm_sql("brand || ' ' || product_name")}, ' ')) AS pw FROM offers) p ON p.category_id = x.member_id) m
  JOIN offers o ON o.category_id = m.member_id AND o.product_key = m.product_key)
 GROUP BY category_id, q, chain, class) GROUP BY category_id, q, chain"""
VIEWS["priced_lines"] = """
SELECT l.basket_id, l.item_no, l.q, l.category_id, b.chain, b.offer_id, b.price, b.unit_group, b.ppn,
 CASE WHEN NOT l.any_brand AND l.brand IS NOT NULL THEN CASE WHEN lower(b.offer_brand) = lower(l.brand) THEN 'exact' ELSE 'similar' END END AS match_type
FROM basket_lines l JOIN best_offers b ON b.category_id = l.category_id AND b.q = l.q"""
VIEWS["chain_totals"] = f"""
SELECT s.*, t.items, t.items - s.found AS missing, s.found - s.offers AS no_price,
 CASE WHEN unit_lines = s.offers AND (g_min IS NULL OR g_min = g_max) AND s.offers > 0 THEN unit_total ELSE total END AS rank_price,
 CASE WHEN unit_lines = s.offers AND (g_min IS NULL OR g_min = g_max) AND s.offers > 0 THEN 'unit' ELSE 'total' END AS basis
FROM (SELECT basket_id, chain, count(*) AS found, count(price) AS offers, {round_to_sql('sum(price)', 2)} AS total, sum(ppn) AS unit_total, count(ppn) AS unit_lines,
 min(unit_group) AS g_min, max(unit_group) AS g_max, min(CASE match_type WHEN 'exact' THEN 1 WHEN 'similar' THEN 0 END) AS exact_store
 FROM priced_lines GROUP BY basket_id, chain) s JOIN (SELECT basket_id, count(*) AS items FROM basket_lines GROUP BY basket_id) t USING (basket_id)"""
VIEWS["basket_reach"] = f"""
SELECT o.o_orderkey AS basket_id, r.store_id, r.chain, r.distance_km FROM orders o JOIN (
 SELECT a.store_id AS home, b.store_id, b.chain, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_km FROM stores a
 JOIN stores b ON b.lat BETWEEN a.lat - {REACH_KM}::DOUBLE / 111::DOUBLE AND a.lat + {REACH_KM}::DOUBLE / 111::DOUBLE) r
ON r.home = o.o_custkey WHERE r.distance_km <= {REACH_KM}::DOUBLE"""
VIEWS["store_ranking"] = f"""
SELECT *, CASE WHEN rank > 1 THEN {round_to_sql('total - first_total', 2)} END AS diff FROM (
 SELECT *, row_number() OVER w AS rank, first_value(total) OVER w AS first_total FROM (
  SELECT t.*, r.store_id, {round_to_sql('r.distance_km', 6)} AS distance_km, CASE WHEN t.basis = 'unit' THEN {round_to_sql('t.rank_price', 9)} ELSE t.rank_price END AS rank_key
  FROM chain_totals t JOIN basket_reach r ON r.basket_id = t.basket_id AND r.chain = t.chain WHERE t.offers > 0)
 WINDOW w AS (PARTITION BY basket_id ORDER BY found DESC, total IS NULL, rank_key, distance_km, store_id))"""


def priced_offers(t: Tables):
    """The catalogue columns pricing needs, written once because several steps read them."""
    if "priced" not in t.__dict__:
        t.__dict__["priced"] = cut_lineage(
            t.offers.select("offer_id", "chain", "product_name", "brand", F.col("sales_price").alias("price"), "unit_group", "ppn", "category_id")
        )
    return t.__dict__["priced"]


def lines(t: Tables):
    return basket.normalize_lines(t.basket_lines, t.categories)


def best(t: Tables):
    """Best offers per wanted category, phrase and chain: far fewer rows than lines, used by every later step."""
    if "best" not in t.__dict__:
        t.__dict__["best"] = cut_lineage(basket.best_by_category(t.basket_lines, priced_offers(t), t.categories))
    return t.__dict__["best"]


def priced(t: Tables):
    return basket.price_lines(lines(t), best(t))


# what a line asks for
WISH = ["q", "brand", "any_brand", "category_id"]


def wish_lines(t: Tables):
    """What lines ask for, once each, as the normalised lines of one basket; ``item_no`` is the number of the wish. Written once."""
    if "wish_lines" not in t.__dict__:
        numbered = stored(t.basket_lines.select(*WISH).distinct().withColumn("wish", F.monotonically_increasing_id()), "wishes")
        each = basket.normalize_lines(numbered.select(F.lit(0).alias("basket_id"), F.col("wish").alias("item_no"), *WISH), t.categories)
        t.__dict__["wish_lines"] = stored(each, "wish-lines")
        # a wish may be no line, or several where a category has several names
        times = t.__dict__["wish_lines"].groupBy(F.col("item_no").alias("wish")).agg(F.count(F.lit(1)).cast("int").alias("times"))
        t.__dict__["wishes"] = stored(numbered.join(times, "wish").select("wish", "times", F.struct(*WISH).alias("key")), "wish-keys")
        t.__dict__["wishes_are_lines"] = t.__dict__["wishes"].where("times > 1").isEmpty()
    return t.__dict__["wish_lines"]


def asked(t: Tables):
    """(basket_id, item_no, wish) of the lines; the wish stands for all that they ask for."""
    wish_lines(t)
    # nulls inside a struct are equal to one another
    return t.basket_lines.join(t.__dict__["wishes"].drop("times"), F.struct(*WISH) == F.col("key")).select("basket_id", "item_no", "wish")


def asked_lines(t: Tables):
    """(basket_id, wish), as often as there are lines."""
    rows = asked(t).repartition("basket_id").select("basket_id", "wish")
    if t.__dict__["wishes_are_lines"]:
        return rows
    times = t.__dict__["wishes"].select("wish", "times")
    return rows.join(times, "wish").select("basket_id", "wish", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")


def matches(t: Tables):
    """(wish, chain, offer_id, price, unit_group, ppn, match_type): the offers of wishes by category, written once."""
    if "matches" not in t.__dict__:
        t.__dict__["matches"] = stored(_of_wishes(basket.price_lines(wish_lines(t), best(t))), "matches")
    return t.__dict__["matches"]


def matches_with_text(t: Tables):
    """As ``matches``, and by text where a chain has nothing in the category; written once."""
    if "matches_with_text" not in t.__dict__:
        t.__dict__["matches_with_text"] = stored(_of_wishes(basket.price_all_lines(wish_lines(t), best(t), priced_offers(t))), "text-matches")
    return t.__dict__["matches_with_text"]


def _of_wishes(rows):
    return rows.select(F.col("item_no").alias("wish"), "chain", "offer_id", "price", "unit_group", "ppn", "match_type")


def matched(t: Tables, found=matches):
    """Lines with their offer at every chain that has one. Lines go to their baskets first, so that a small table of matches need not part them."""
    return asked(t).repartition("basket_id").join(found(t), "wish")


def totals(t: Tables, found=matches):
    return basket.chain_totals(matched(t, found), asked_lines(t))


def places(t: Tables):
    """Stores with their place; homes are places of stores."""
    if "places" not in t.__dict__:
        t.__dict__["places"] = cut_lineage(geo.shared_places(t.stores.select("store_id", "chain", "lat", "lon"), "store_id"))
    return t.__dict__["places"]


def homes(t: Tables):
    """(basket_id, home): the place a basket is bought from."""
    home = places(t).select(F.col("store_id").alias("o_custkey"), F.col("place").alias("home"))
    return t.read("orders").select(F.col("o_orderkey").alias("basket_id"), "o_custkey").join(home, "o_custkey").drop("o_custkey")


def pairs(t: Tables):
    """(home, place, distance_km) within reach, distances rounded."""
    near = geo.place_pairs(places(t), places(t), REACH_KM)
    return near.withColumn("distance_km", round_to(F.col("distance_km"), 6))


def around(t: Tables):
    """(home, chain, store_id, distance_km) of the stores in reach of every home."""
    return pairs(t).join(places(t).select("place", "chain", "store_id"), "place").drop("place")


def rounded_reach(t: Tables):
    """All stores in reach of every basket: rows of (basket, store)."""
    return homes(t).join(around(t), "home").drop("home")


def nearest_reach(t: Tables, n: int):
    """(basket_id, chain, store_id, distance_km) of the ``n`` nearest stores of every chain in reach of a basket."""
    if f"nearest_{n}" not in t.__dict__:
        t.__dict__[f"nearest_{n}"] = cut_lineage(geo.nearest_of_chains(pairs(t), places(t), n))
    return homes(t).join(t.__dict__[f"nearest_{n}"], "home").drop("home")


def near_lists(t: Tables, n: int):
    """(basket_id, near): the stores of ``nearest_reach`` as one list a home, by distance and id."""
    if f"lists_{n}" not in t.__dict__:
        nearest_reach(t, n)
        listed = F.sort_array(F.collect_list(F.struct("distance_km", "store_id", "chain")))
        t.__dict__[f"lists_{n}"] = stored(t.__dict__[f"nearest_{n}"].groupBy("home").agg(listed.alias("near")), "near")
    return homes(t).join(t.__dict__[f"lists_{n}"], "home").drop("home")


def odd_baskets(t: Tables):
    """(basket_id) of the baskets with several homes, or with several lines of the same number; null if there is none."""
    if "odd" not in t.__dict__:
        many = F.col("count") > 1
        homed = homes(t).groupBy("basket_id").count().where(many).select("basket_id")
        numbered = asked_lines_by_number(t).groupBy("basket_id", "number").count().where(many).select("basket_id")
        odd = cut_lineage(homed.union(numbered).distinct())
        t.__dict__["odd"] = None if odd.isEmpty() else odd
    return t.__dict__["odd"]


def asked_lines_by_number(t: Tables):
    """(basket_id, number): lines by a hash of their item number, as often as there are lines."""
    rows = asked(t).select("basket_id", F.xxhash64("item_no").alias("number"), "wish")
    if t.__dict__["wishes_are_lines"]:
        return rows.drop("wish")
    return rows.join(t.__dict__["wishes"].select("wish", "times"), "wish").select("basket_id", "number", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")


def ranked_totals(t: Tables, found=matches):
    rows = totals(t, found)
    return rows.withColumn("rank_price", F.when(F.col("basis") == "unit", round_to(F.col("rank_price"), 9)).otherwise(F.col("rank_price")))


def ranking(t: Tables, found=matches):
    """All stores in reach of a basket, ranked."""
    return basket.rank_in_reach(ranked_totals(t, found), homes(t), around(t))


def first_stores(t: Tables, keep: int, found=matches):
    """The first ``keep`` stores of a basket: no more of a chain can be among them than its ``keep`` nearest."""
    return basket.rank_stores(basket.listed_rows(ranked_totals(t, found), near_lists(t, keep)), keep)


def raw_baskets(t: Tables):
    """Baskets as requests send them: a JSON list a basket, some with entries that are no lines, and some texts that are no list."""
    item = F.struct("item_no", F.concat(F.lit(" "), "q").alias("q"), F.concat("brand", F.lit(" ")).alias("brand"), "any_brand", "category_id")
    listed = t.basket_lines.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.to_json(item))).alias("items"))
    odd = F.when(F.col("basket_id") % 5 == 0, F.array(*map(F.lit, ["7", '"text"', "null", '{"category_id": {"id": 1}, "q": "x"}', '{"category_id": true}', '{"q": "  "}'])))
    payload = F.concat(F.lit("["), F.array_join(F.concat("items", F.coalesce(odd, F.array().cast("array<string>"))), ", "), F.lit("]"))
    sent = listed.select("basket_id", payload.alias("payload"))
    broken = t.read("supplier").select((-F.col("s_suppkey") - 1).alias("basket_id"), F.when(F.col("s_suppkey") % 2 == 0, '{"q": "no list"}').otherwise('[{"q": "cut').alias("payload"))
    return sent.unionByName(broken)


@query(
    "bsk0_basket_lines",
    "SELECT basket_id, item_no, q, brand, CASE WHEN any_brand OR brand IS NULL THEN 1 ELSE 0 END AS any_brand, category_id, n_members FROM basket_lines "
    "JOIN (SELECT category_id, count(*) AS n_members FROM expansion GROUP BY category_id) USING (category_id)",
)
def _(t: Tables):
    """Lines out of raw JSON, with the number of categories that each stands for."""
    from offerloom.operators.taxonomy import expansion

    parsed = basket.normalize_lines(basket.parse_baskets(raw_baskets(t)).where("reason IS NULL"), t.categories)
    sizes = expansion(t.categories).groupBy("category_id").agg(F.count(F.lit(1)).alias("n_members"))
    return parsed.drop("category_name").withColumn("any_brand", F.col("any_brand").cast("int")).join(sizes, "category_id")


@query(
    "bsk0_rejected_items",
    """SELECT reason, sum(n)::BIGINT AS items FROM (SELECT unnest(['no object', 'bad category id', 'empty']) AS reason, unnest([3, 2, 1]) AS n FROM (SELECT DISTINCT basket_id FROM basket_lines) WHERE basket_id % 5 = 0
 UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'no list' ELSE 'not json' END, 1 FROM supplier) GROUP BY reason""",
)
def _(t: Tables):
    """Entries of raw baskets that are no lines, by reason."""
    return basket.parse_baskets(raw_baskets(t)).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("items"))


@query(
    "bsk1_cheapest_in_order",
    """SELECT chain, level1, w.offer_id AS offer_id, w.price AS price FROM (SELECT chain, split_part(category_id, '/', 1) AS level1,
 list_reduce(list({'offer_id': offer_id, 'price': sales_price, 'unit_group': unit_group, 'ppn': ppn} ORDER BY product_name, offer_id),
 lambda a, x: CASE WHEN (CASE WHEN a.unit_group = x.unit_group AND a.ppn IS NOT NULL AND x.ppn IS NOT NULL THEN x.ppn < a.ppn ELSE x.price < a.price END) THEN x ELSE a END) AS w
FROM offers GROUP BY chain, level1)""",
)
def _(t: Tables):
    from offerloom.operators.fold import cheapest_in_order

    rows = priced_offers(t).withColumn("level1", F.split_part("category_id", F.lit("/"), F.lit(1)))
    return cheapest_in_order(rows, ["chain", "level1"], basket.ORDER, ["offer_id", "price"])


@query("bsk2_best_by_category", f"SELECT category_id, q, chain, offer_id, price, class::INT AS class FROM best_offers")
def _(t: Tables):
    return best(t).select("category_id", "q", "chain", "offer_id", "price", "class")


@query("bsk3_best_by_text")
def _(t: Tables):
    """Every distinct wish at every chain, with its brand where it insists on one; score, then price decide."""
    brand = F.when(~F.col("any_brand"), F.col("brand"))
    wanted = t.basket_lines.select(F.concat_ws("|", "q", F.coalesce(brand, F.lit(""))).alias("spec"), "q", brand.alias("brand")).distinct()
    return basket.best_by_text(wanted, priced_offers(t)).select("spec", "chain", "offer_id", "price", "score")


@query("bsk4_fallback_order")
def _(t: Tables):
    """Free-text lines that insist on a brand: with it, without it, then word by word."""
    cols = ["q", "brand", "any_brand"]
    wanted = t.basket_lines.select(*cols).distinct().select(F.concat_ws("|", "q", F.coalesce("brand", F.lit(""))).alias("spec"), *cols)
    return basket.best_by_text_with_fallback(wanted, priced_offers(t)).select("spec", "chain", "offer_id", "price", "score", "stage")


@query("bsk5_match_type", "SELECT basket_id, item_no, chain, offer_id, match_type FROM priced_lines")
def _(t: Tables):
    return priced(t).select("basket_id", "item_no", "chain", "offer_id", "match_type")


@query(
    "bsk6_store_totals",
    f"SELECT t.basket_id, r.store_id, found, missing, no_price, offers, total, {round_to_sql('distance_km', 6)} AS km FROM chain_totals t JOIN basket_reach r ON r.basket_id = t.basket_id AND r.chain = t.chain",
)
def _(t: Tables):
    """Totals meet stores by home and chain, so that rows of (basket, store) are made by the last join."""
    cols = ["basket_id", "store_id", "found", "missing", "no_price", "offers", "total"]
    return totals(t).join(homes(t), "basket_id").join(around(t), ["home", "chain"]).select(*cols, F.col("distance_km").alias("km"))


@query("bsk13_lines_with_text")
def _(t: Tables):
    """Every basket line at every chain: by category, else by text. Two of five lines lose their category, so text has work to do."""
    bare = t.basket_lines.withColumn("category_id", F.when(F.xxhash64("q") % 5 > 1, F.col("category_id")))
    rows = basket.price_all_lines(basket.normalize_lines(bare, t.categories), best(t), priced_offers(t))
    return rows.select("basket_id", "item_no", "chain", "offer_id", "price", "match_type")


@query("bsk14_totals_with_text")
def _(t: Tables):
    """Chain totals over category and text matches."""
    return totals(t, matches_with_text)


@query("bsk7_store_ranking_with_text")
def _(t: Tables):
    """Stores ranked by what category and text matches cost there."""
    return ranking(t, matches_with_text).select("basket_id", "store_id", "chain", "rank", "found", "total", "basis")


@query("bsk7_store_ranking", "SELECT basket_id, store_id, chain, rank, found, total, basis FROM store_ranking")
def _(t: Tables):
    return ranking(t).select("basket_id", "store_id", "chain", "rank", "found", "total", "basis")


@query("bsk8_ranking_report", "SELECT basket_id, store_id, rank, items, found, total, diff, exact_store FROM store_ranking")
def _(t: Tables):
    return ranking(t).select("basket_id", "store_id", "rank", "items", "found", "total", "diff", "exact_store")


VIEWS["mix_rows"] = f"""
SELECT basket_id, item_no, w.chain AS chain, w.store_id AS store_id, w.offer_id AS offer_id, w.price AS price FROM (
 SELECT l.basket_id, l.item_no, list_reduce(list({{'chain': l.chain, 'store_id': n.store_id, 'offer_id': l.offer_id, 'price': l.price, 'unit_group': l.unit_group, 'ppn': l.ppn}}
  ORDER BY n.d, n.store_id), lambda a, x: CASE WHEN (CASE WHEN a.unit_group = x.unit_group AND a.ppn IS NOT NULL AND x.ppn IS NOT NULL
  THEN x.ppn < a.ppn ELSE x.price < a.price END) THEN x ELSE a END) AS w
 FROM priced_lines l JOIN (SELECT basket_id, chain, min(d) AS d, arg_min(store_id, (d, store_id)) AS store_id
  FROM (SELECT *, {round_to_sql('distance_km', 6)} AS d FROM basket_reach) GROUP BY basket_id, chain) n ON n.basket_id = l.basket_id AND n.chain = l.chain
 GROUP BY l.basket_id, l.item_no)"""
VIEWS["mix_totals"] = f"""
SELECT basket_id, {round_to_sql('sum(price)', 2)} AS mix_total, count(price) AS mix_lines, count(DISTINCT chain) AS chain_count,
 string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains_used FROM mix_rows GROUP BY basket_id"""


def split(t: Tables, found=matches):
    """Lines with a number of their own, which are all or nearly all, pass through their offers one by one; others are gathered."""
    odd = odd_baskets(t)
    if odd is None:
        return basket.cheapest_split_of_wishes(asked(t), found(t), near_lists(t, 1))
    several = t.__dict__["wishes"].where("times > 1").select("wish")
    alone = basket.cheapest_split_of_wishes(asked(t).join(odd, "basket_id", "left_anti"), found(t).join(several, "wish", "left_anti"), near_lists(t, 1))
    gathered = basket.cheapest_split(matched(t, found).join(odd, "basket_id", "left_semi").drop("wish"), nearest_reach(t, 1).join(odd, "basket_id", "left_semi"))
    return alone.unionByName(gathered)


@query(
    "bsk9_ranking_sections",
    """SELECT basket_id, section, count(*) AS stores FROM (SELECT basket_id, CASE WHEN max(CASE WHEN exact_store IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY basket_id) = 0 THEN 'all'
 WHEN exact_store = 1 THEN 'exact' ELSE 'similar' END AS section FROM store_ranking) GROUP BY basket_id, section""",
)
def _(t: Tables):
    """Stores of a chain share its section, so that they are counted once a home."""
    counted = around(t).groupBy("home", "chain").agg(F.count(F.lit(1)).alias("stores"))
    chains = totals(t).where("offers > 0").join(homes(t), "basket_id").join(counted, ["home", "chain"])
    return basket.split_sections(chains).groupBy("basket_id", "section").agg(F.sum("stores").alias("stores"))


@query(
    "bsk10_savings",
    f"""SELECT basket_id, min(total) AS cheapest, max(total) AS dearest, arg_min(chain, (total, rank)) AS cheapest_chain, arg_max(chain, (total, -rank)) AS dearest_chain,
 {round_to_sql('max(total) - min(total)', 2)} AS saving FROM store_ranking WHERE total IS NOT NULL GROUP BY basket_id""",
)
def _(t: Tables):
    """Of each chain the nearest store stands for all: it has their total and the least rank."""
    return basket.savings(basket.rank_stores(basket.store_rows(ranked_totals(t), nearest_reach(t, 1))))


@query("bsk11_coverage_percent", "SELECT basket_id, chain, floor(found::DOUBLE / items * 100)::BIGINT AS percent FROM chain_totals")
def _(t: Tables):
    return totals(t).select("basket_id", "chain", F.floor(F.col("found") / F.col("items") * 100).alias("percent"))


@query("mix1_cheapest_split", "SELECT basket_id, item_no, chain, store_id, offer_id, price FROM mix_rows")
def _(t: Tables):
    return split(t).select("basket_id", "item_no", "chain", "store_id", "offer_id", "price")


@query("mix1_cheapest_split_with_text")
def _(t: Tables):
    return split(t, matches_with_text).select("basket_id", "item_no", "chain", "store_id", "offer_id", "price")


@query("mix3_saving_with_text")
def _(t: Tables):
    """Split and best store over category and text matches."""
    first = first_stores(t, 1, matches_with_text).select("basket_id", "total", "found")
    gain = F.when(F.col("mix_total") < F.col("total"), round_to(F.col("total") - F.col("mix_total"), 2))
    return basket.split_totals(split(t, matches_with_text)).join(first, "basket_id").select("basket_id", "mix_total", "total", gain.alias("saving"), "mix_lines", "found")


@query(
    "mix2_best_two_stores",
    f"""WITH v AS (SELECT basket_id, chain, item_no, coalesce(ppn, price) AS value FROM priced_lines WHERE price IS NOT NULL),
c AS (SELECT basket_id, chain, count(*) AS cover FROM v GROUP BY basket_id, chain),
p AS (SELECT r.basket_id, r.store_id, r.chain, row_number() OVER (PARTITION BY r.basket_id ORDER BY c.cover DESC, {round_to_sql('distance_km', 6)}, r.store_id) AS pos
 FROM basket_reach r JOIN c ON c.basket_id = r.basket_id AND c.chain = r.chain),
i AS (SELECT a.basket_id, a.pos AS pos_a, b.pos AS pos_b, a.store_id AS store_a, b.store_id AS store_b, v.item_no, min(v.value) AS value
 FROM p a JOIN p b ON a.basket_id = b.basket_id AND a.pos < b.pos JOIN v ON v.basket_id = a.basket_id AND v.chain IN (a.chain, b.chain) GROUP BY ALL),
g AS (SELECT basket_id, pos_a, pos_b, store_a, store_b, count(*) AS coverage, sum(value) AS score FROM i GROUP BY ALL)
SELECT basket_id, store_a, store_b, coverage, {round_to_sql('score', 9)} AS score FROM g
QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY coverage DESC, {round_to_sql('score', 9)}, pos_a, pos_b) = 1""",
)
def _(t: Tables):
    odd, near = odd_baskets(t), near_lists(t, 2)
    if odd is None:
        found = basket.best_pairs_of_wishes(asked(t), matches(t), near)
    else:
        several = t.__dict__["wishes"].where("times > 1").select("wish")
        alone = basket.best_pairs_of_wishes(asked(t).join(odd, "basket_id", "left_anti"), matches(t).join(several, "wish", "left_anti"), near)
        gathered = basket.best_pairs(matched(t).join(odd, "basket_id", "left_semi"), nearest_reach(t, 2).join(odd, "basket_id", "left_semi"))
        found = alone.unionByName(gathered)
    return found.withColumn("score", round_to(F.col("score"), 9))


def _best_split_sql(k: int) -> str:
    """All choices of one to ``k`` chains, spelled out."""
    parts = []
    for n in range(1, k + 1):
        tables = " ".join(f"{'FROM' if i == 0 else 'JOIN'} p p{i}{'' if i == 0 else f' ON p{i}.basket_id = p0.basket_id AND p{i}.pos > p{i - 1}.pos'}" for i in range(n))
        parts.append(f"SELECT p0.basket_id, [{', '.join(f'p{i}.pos' for i in range(n))}] AS places, unnest([{', '.join(f'p{i}.chain' for i in range(n))}]) AS chain {tables}")
    return f"""WITH v AS (SELECT basket_id, chain, item_no, coalesce(ppn, price) AS value FROM priced_lines WHERE price IS NOT NULL),
n AS (SELECT basket_id, chain, arg_min(store_id, (distance_km, store_id)) AS store_id, min(distance_km) AS d FROM (SELECT * REPLACE ({round_to_sql('distance_km', 6)} AS distance_km) FROM basket_reach) GROUP BY basket_id, chain),
p AS (SELECT c.basket_id, c.chain, n.store_id, row_number() OVER (PARTITION BY c.basket_id ORDER BY c.cover DESC, n.d, c.chain) AS pos
 FROM (SELECT basket_id, chain, count(DISTINCT item_no) AS cover FROM v GROUP BY basket_id, chain) c JOIN n ON n.basket_id = c.basket_id AND n.chain = c.chain),
m AS ({' UNION ALL '.join(parts)}),
i AS (SELECT m.basket_id, m.places, v.item_no, min(v.value) AS value FROM m JOIN v ON v.basket_id = m.basket_id AND v.chain = m.chain GROUP BY ALL),
g AS (SELECT * FROM (SELECT basket_id, places, count(*) AS coverage, sum(value) AS score FROM i GROUP BY basket_id, places)
 QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY coverage DESC, {round_to_sql('score', 9)}, len(places), places) = 1)
SELECT g.basket_id, string_agg(p.chain, ',' ORDER BY p.pos) AS chains, string_agg(p.store_id::VARCHAR, ',' ORDER BY p.pos) AS stores, any_value(coverage) AS coverage, any_value({round_to_sql('score', 9)}) AS score
FROM g JOIN p ON p.basket_id = g.basket_id AND list_contains(g.places, p.pos) GROUP BY g.basket_id"""


def best_splits(t: Tables, k: int):
    found = basket.best_splits(priced(t), nearest_reach(t, 1), k)
    stores = F.array_join(F.col("stores").cast("array<string>"), ",")
    return found.select("basket_id", F.array_join("chains", ",").alias("chains"), stores.alias("stores"), "coverage", round_to(F.col("score"), 9).alias("score"))


@query("mix2_best_split_of_two", _best_split_sql(2))
def _(t: Tables):
    return best_splits(t, 2)


@query("mix2_best_split_of_three", _best_split_sql(3))
def _(t: Tables):
    return best_splits(t, 3)


@query(
    "mix3_saving_vs_best",
    f"""SELECT m.basket_id, m.mix_total, r.total, CASE WHEN m.mix_total < r.total THEN {round_to_sql('r.total - m.mix_total', 2)} END AS saving, m.mix_lines, r.found
FROM mix_totals m JOIN store_ranking r ON r.basket_id = m.basket_id AND r.rank = 1""",
)
def _(t: Tables):
    first = first_stores(t, 1).select("basket_id", "total", "found")
    gain = F.when(F.col("mix_total") < F.col("total"), round_to(F.col("total") - F.col("mix_total"), 2))
    return basket.split_totals(split(t)).join(first, "basket_id").select("basket_id", "mix_total", "total", gain.alias("saving"), "mix_lines", "found")


@query(
    "mix4_filtered_total",
    f"SELECT basket_id, {round_to_sql('sum(price)', 2)} AS total, count(DISTINCT chain) AS chain_count FROM mix_rows WHERE chain IN ('Chain#0', 'Chain#2', 'Chain#4', 'Chain#6') GROUP BY basket_id",
)
def _(t: Tables):
    kept = basket.split_totals(split(t).where(F.col("chain").isin("Chain#0", "Chain#2", "Chain#4", "Chain#6")))
    return kept.select("basket_id", F.col("mix_total").alias("total"), "chain_count")


@query(
    "mix5_items_per_chain",
    """SELECT l.basket_id, coalesce(m.chain, 'missing') AS chain, count(*) AS items, string_agg(l.q, '|' ORDER BY l.item_no, l.q) AS item_list
FROM basket_lines l LEFT JOIN mix_rows m ON m.basket_id = l.basket_id AND m.item_no = l.item_no GROUP BY l.basket_id, coalesce(m.chain, 'missing')""",
)
def _(t: Tables):
    chosen = split(t).select("basket_id", "item_no", "chain")
    every = asked(t).join(wish_lines(t).select(F.col("item_no").alias("wish"), "q"), "wish").drop("wish").join(chosen, ["basket_id", "item_no"], "left").withColumn("chain", F.coalesce("chain", F.lit("missing")))
    listed = F.array_sort(F.collect_list(F.struct("item_no", "q")))
    return every.groupBy("basket_id", "chain").agg(
        F.count(F.lit(1)).alias("items"), F.array_join(F.transform(listed, lambda x: x["q"]), "|").alias("item_list")
    )
