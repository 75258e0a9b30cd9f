"""Queries over the catalogue build: deduplication, links, counts, label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions.numbers import round_to, round_to_sql
from offerloom.operators import catalog
from offerloom.plans.registry import query
from offerloom.plans.views import Tables


@query("bld1_offer_dedup", "SELECT offer_id, chain, product_name, brand, sales_price, valid_from, brochure_id FROM unique_offers")
def _(t: Tables):
    return t.offers.select("offer_id", "chain", "product_name", "brand", "sales_price", "valid_from", "brochure_id")


_LINKS_SQL = "SELECT offer_id, brochure_id, arg_min(page_number, raw_id) AS page_number, count(*) AS printed FROM offer_links GROUP BY offer_id, brochure_id"


@query("bld2_offer_brochure_links", _LINKS_SQL)
def _(t: Tables):
    return catalog.offer_brochure_links(t.offer_links)


@query(
    "bld3_occurrence_count",
    f"SELECT o.offer_id, coalesce(n, 0) AS occurrence_count FROM unique_offers o LEFT JOIN (SELECT offer_id, count(*) AS n FROM ({_LINKS_SQL}) GROUP BY offer_id) USING (offer_id)",
)
def _(t: Tables):
    links = catalog.offer_brochure_links(t.offer_links)
    return catalog.occurrence_counts(t.offers.select("offer_id"), links)


@query(
    "bld4_brochure_dimension",
    "SELECT brochure_id, arg_min(chain, raw_id) AS chain, arg_min(page_number, raw_id) AS first_page, max(page_number) AS page_count FROM offer_links GROUP BY brochure_id",
)
def _(t: Tables):
    return t.offer_links.groupBy("brochure_id").agg(
        F.min_by("chain", "raw_id").alias("chain"), F.min_by("page_number", "raw_id").alias("first_page"), F.max("page_number").alias("page_count")
    )


@query(
    "bld5_brochure_stores",
    """SELECT DISTINCT b.brochure_id, s.store_id FROM (SELECT DISTINCT b.brochure_id, b.chain, s.postcode FROM brochures b JOIN stores s USING (store_id)) b
JOIN stores s ON s.chain = b.chain AND s.postcode = b.postcode""",
)
def _(t: Tables):
    """Brochures found for a place and chain belong to every store of that chain and place."""
    return catalog.brochures_of_places(t.brochures, t.stores)


@query(
    "bld6_build_metrics",
    f"""SELECT count(*) AS offers_raw, count(DISTINCT brochure_id) AS brochures, count(DISTINCT page_key) AS pages, count(DISTINCT offer_id) AS offers_unique,
 count(DISTINCT link_key) AS links, {round_to_sql('(1::DOUBLE - count(DISTINCT offer_id)::DOUBLE / count(*)::DOUBLE) * 100::DOUBLE', 1)} AS dedup_percent
FROM (SELECT *, brochure_id::VARCHAR || '/' || page_number::VARCHAR AS page_key, brochure_id::VARCHAR || '/' || offer_id AS link_key FROM offer_links)""",
)
def _(t: Tables):
    links = t.offer_links
    # each distinct count is reduced on its own key, so no key is expanded into several copies of the rows
    raw = links.agg(F.count(F.lit(1)).alias("offers_raw"))
    parts = [
        links.select(*keys).distinct().agg(F.count(F.lit(1)).alias(name))
        for name, keys in (
            ("brochures", ["brochure_id"]), ("pages", ["brochure_id", "page_number"]), ("offers_unique", ["offer_id"]), ("links", ["brochure_id", "offer_id"]),
        )
    ]
    one = raw.withColumn("k", F.lit(1))
    for part in parts:
        one = one.join(part.withColumn("k", F.lit(1)), "k")
    ratio = (F.lit(1.0) - F.col("offers_unique") / F.col("offers_raw")) * 100
    return one.drop("k").withColumn("dedup_percent", round_to(ratio, 1))


@query(
    "bld7_store_carry_over",
    """SELECT store_id, arg_max(name, v) AS name, arg_max(chain, v) AS chain, max(v) AS version FROM (
SELECT store_id, name, chain, 1 AS v FROM stores UNION ALL SELECT store_id, upper(name), chain, 2 FROM stores WHERE city IS NOT NULL) GROUP BY store_id""",
)
def _(t: Tables):
    """Existing stores survive a rebuild; a newer batch overrides them on the natural key."""
    cols = ["store_id", "name", "chain"]
    existing = t.stores.select(*cols).withColumn("version", F.lit(1))
    incoming = t.stores.where("city IS NOT NULL").select("store_id", F.upper("name").alias("name"), "chain").withColumn("version", F.lit(2))
    return catalog.last_by(existing.unionByName(incoming), ["store_id"], [F.col("version")])


@query(
    "jn1_label_join",
    """SELECT o.offer_id, coalesce(l.category_id, o.own_category_id) AS category_id, CASE WHEN l.product_key IS NULL THEN 0 ELSE 1 END AS labelled
FROM unique_offers o LEFT JOIN product_labels l ON l.product_key = o.product_key""",
)
def _(t: Tables):
    labels = t.product_labels.select("product_key", F.col("category_id").alias("label_id"))
    joined = t.offers.select("offer_id", "product_key", "own_category_id").join(labels, "product_key", "left")
    return joined.select("offer_id", F.coalesce("label_id", "own_category_id").alias("category_id"), F.col("label_id").isNotNull().cast("int").alias("labelled"))


@query(
    "jn2_store_brochures",
    "SELECT s.store_id, string_agg(DISTINCT b.brochure_id::VARCHAR, ',' ORDER BY b.brochure_id::VARCHAR) AS brochures FROM stores s JOIN brochures b USING (store_id) GROUP BY s.store_id",
)
def _(t: Tables):
    ids = t.brochures.select("store_id", F.col("brochure_id").cast("string").alias("b"))
    return t.stores.select("store_id").join(ids, "store_id").groupBy("store_id").agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("brochures"))


@query(
    "jn3_scope_semi_join",
    """SELECT offer_id, chain FROM unique_offers WHERE chain = 'Chain#3' OR offer_id IN (
SELECT offer_id FROM offer_links WHERE brochure_id IN (SELECT brochure_id FROM brochures WHERE valid_from >= DATE '2000-01-01'))""",
)
def _(t: Tables):
    """Offers of brochures in scope, or of chains that are in scope as a whole."""
    offers = t.offers.select("offer_id", "chain")
    scope = t.brochures.where("valid_from >= DATE'2000-01-01'").select("brochure_id")
    printed = offers.join(t.offer_links.join(scope, "brochure_id", "left_semi").select("offer_id"), "offer_id", "left_semi")
    return printed.unionByName(offers.where(F.col("chain") == "Chain#3")).distinct()
