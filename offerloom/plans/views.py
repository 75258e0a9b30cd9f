"""The retail tables as views over the benchmark tables, in DataFrame form and in SQL form.

Every view exists twice: as a method of ``Tables`` and as an entry of ``VIEWS`` with the
same columns, so that a query and the SQL it is checked against read the same input.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.numbers import round_to, round_to_sql
from offerloom.functions.text import normalize_search_text
from offerloom.operators.catalog import deduplicate_offers, with_base_prices
from offerloom.plans.sqltext import norm_sql
from offerloom.plans.sqlunits import base_price_select_sql
from offerloom.session import cut_lineage

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def offer_key() -> list[Column]:
    """What makes two printed offers the same; spellings that differ in case or accents are equal."""
    return [F.col(c) for c in ("chain", "name_key", "brand_key", "sales_price", "valid_from", "valid_until")]


class Tables:
    """Lazy access to the views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw_offers(self) -> DataFrame:
        """One row per offer as printed in a brochure, before deduplication."""
        return self.keyed_offers.drop("name_key", "brand_key")

    @cached_property
    def keyed_offers(self) -> DataFrame:
        """Printed offers with the search forms of name and brand, which are made once per part, not once per print."""
        line = self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"
        )
        keys = {"name_key": normalize_search_text(F.col("p_name")), "brand_key": normalize_search_text(F.col("p_brand"))}
        part = self.read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").withColumns(keys)
        sales = ((F.col("p_size") % 5) * 100 + 99).cast("double") / F.lit(100.0)
        kind = F.col("p_size") % 3
        big = F.when(kind == 0, "kg").when(kind == 1, "l").otherwise("Dose")
        small = F.when(kind == 0, "g").when(kind == 1, "ml").otherwise("Stück")
        dot = sales.cast("string")
        comma = F.replace(dot, F.lit("."), F.lit(","))
        amount = F.col("l_quantity").cast("bigint")
        form = F.col("l_linenumber")
        base_text = (
            F.when(F.col("l_discount") == 0.1, F.lit(None))
            .when(form == 1, F.concat(F.lit("("), (amount * 100).cast("string"), F.lit(" "), small, F.lit(" = "), comma, F.lit(" €)")))
            .when(form == 2, F.concat(F.lit("1 "), big, F.lit(" ab "), dot))
            .when(form == 3, F.concat(dot, F.lit(" €/"), big))
            .when(form == 4, F.concat(dot, F.lit(" €/"), (amount * 10).cast("string"), small))
            .when(form == 5, F.concat(big, F.lit("-Preis "), dot))
            .when(form == 6, F.concat(dot, F.lit(" pro "), big))
            .otherwise(F.concat(big, F.lit(" = "), comma))
        )
        note = (
            F.when(form % 5 == 0, F.concat(F.lit("HKL A "), (amount * 10).cast("string"), F.lit(" g")))
            .when(form % 5 == 1, F.lit("je 1 kg"))
            .when(form % 5 == 2, F.concat(amount.cast("string"), F.lit("-g-Packung")))
            .when(form % 5 == 3, F.lit("besonders zart je St."))
            .otherwise(F.lit("frisch aus der Region"))
        )
        year = F.year("l_shipdate")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat_ws(
                "-",
                F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
                F.lpad(F.col("l_partkey").cast("string"), 11, "0"),
                F.lpad(F.col("l_suppkey").cast("string"), 10, "0"),
                F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
            ).alias("offer_id"),
            F.concat(F.lit("Chain#"), (F.col("l_suppkey") % 10).cast("string")).alias("chain"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("brand"),
            F.concat_ws(" ", "p_name", "p_brand").alias("product_key"),
            note.alias("description"),
            sales.alias("sales_price"),
            round_to(sales / (F.lit(1.0) - F.col("l_discount")), 2).alias("regular_price"),
            base_text.alias("base_price_text"),
            F.make_date(year, F.lit(1), F.lit(1)).alias("valid_from"),
            F.make_date(year, F.lit(12), F.lit(31)).alias("valid_until"),
            F.col("l_orderkey").alias("brochure_id"),
            F.col("l_linenumber").cast("bigint").alias("page_number"),
            F.concat_ws("/", "p_type", "p_brand", "p_name").alias("own_category_id"),
            F.concat(F.lit("img/"), (F.col("l_partkey") % 50).cast("string"), F.lit(".jpg")).alias("image_url"),
            "name_key", "brand_key",
        )

    @cached_property
    def offers(self) -> DataFrame:
        """Deduplicated offers with unit prices and the effective category of their label."""
        unique = deduplicate_offers(self.keyed_offers, key=offer_key(), order="offer_id", keep=self.raw_offers.columns)
        labels = self.product_labels.select("product_key", F.col("category_id").alias("label_category_id"))
        return (
            with_base_prices(unique, "base_price_text", "unit", source=self.raw_offers)
            .join(labels, "product_key", "left")
            .select(
                "offer_id", "chain", "product_name", "brand", "product_key", "description", "sales_price", "regular_price",
                "base_price_text", "valid_from", "valid_until", "brochure_id", "page_number", "own_category_id", "image_url",
                F.col("unit.unit_group").alias("unit_group"),
                F.col("unit.price_per_normalized").alias("ppn"),
                F.coalesce("label_category_id", "own_category_id").alias("category_id"),
            )
        )

    @cached_property
    def offer_links(self) -> DataFrame:
        """Offer of every printed occurrence: (offer_id of the kept row, brochure_id, page_number)."""
        # Nulls inside a struct are equal to one another, so that offers without brand or date keep their links.
        printed = self.keyed_offers.select(F.struct(*offer_key()).alias("key"), "brochure_id", "page_number", "chain", F.col("offer_id").alias("raw_id"))
        kept = printed.groupBy("key").agg(F.min("raw_id").alias("offer_id"))
        return printed.join(kept, "key").select("offer_id", "raw_id", "brochure_id", "page_number", "chain")

    @cached_property
    def categories(self) -> DataFrame:
        """Three-level taxonomy: type, brand within type, name within brand; written once, since most queries read it several times."""
        part = self.read("part").select("p_type", "p_brand", "p_name")
        none = F.lit(None).cast("string")
        levels = F.array(
            F.struct(F.col("p_type").alias("category_id"), F.col("p_type").alias("name"), F.lit(1).alias("level"), none.alias("parent_id")),
            F.struct(
                F.concat_ws("/", "p_type", "p_brand").alias("category_id"), F.col("p_brand").alias("name"), F.lit(2).alias("level"),
                F.col("p_type").alias("parent_id"),
            ),
            F.struct(
                F.concat_ws("/", "p_type", "p_brand", "p_name").alias("category_id"), F.col("p_name").alias("name"), F.lit(3).alias("level"),
                F.concat_ws("/", "p_type", "p_brand").alias("parent_id"),
            ),
        )
        return cut_lineage(part.distinct().select(F.explode(levels).alias("c")).select("c.*").distinct())

    @cached_property
    def product_labels(self) -> DataFrame:
        """Type of every product; written once, as the categories are."""
        part = self.read("part")
        return cut_lineage(
            part.groupBy("p_name", "p_brand")
            .agg(F.min("p_type").alias("gattung"), F.count(F.lit(1)).alias("n_parts"))
            .select(
                F.concat_ws(" ", "p_name", "p_brand").alias("product_key"),
                F.col("p_name").alias("product_name"),
                F.col("p_brand").alias("marke"),
                "gattung",
                F.concat_ws("/", "gattung", "p_brand", "p_name").alias("category_id"),
            )
        )

    @cached_property
    def search_labels(self) -> DataFrame:
        label = lambda text, kind: F.struct(F.lower(text).alias("label"), F.lit(kind).alias("label_type"))
        pieces = F.concat(
            F.transform(F.split("product_name", " "), lambda w: label(w, "suchbegriff")),
            F.array(label(F.col("product_name"), "suchbegriff"), label(F.col("marke"), "marke"), label(F.col("gattung"), "gattung")),
        )
        return self.product_labels.select("product_key", F.explode(pieces).alias("l")).select("product_key", "l.label", "l.label_type")

    @cached_property
    def stores(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("store_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("Chain#"), (key % 10).cast("string")).alias("chain"),
            (F.lit(47.2) + ((key * 7919) % 790).cast("double") / F.lit(100.0)).alias("lat"),
            (F.lit(5.9) + ((key * 104729) % 920).cast("double") / F.lit(100.0)).alias("lon"),
            F.when(key % 17 != 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("city"),
            F.lpad((key % 300 + 10000).cast("string"), 5, "0").alias("postcode"),
        )

    @cached_property
    def locations(self) -> DataFrame:
        """Places from which people look for offers."""
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            key.alias("location_id"),
            (F.lit(47.2) + ((key * 6007) % 790).cast("double") / F.lit(100.0)).alias("lat"),
            (F.lit(5.9) + ((key * 7001) % 920).cast("double") / F.lit(100.0)).alias("lon"),
        )

    @cached_property
    def brochures(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("brochure_id"),
            F.col("o_custkey").alias("store_id"),
            F.concat(F.lit("Chain#"), (F.col("o_custkey") % 10).cast("string")).alias("chain"),
            F.to_date("o_orderdate").alias("valid_from"),
        )

    @cached_property
    def search_log(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        user = F.col("user_id")
        clicked = (k % 4 != 0) & (user % 3 == 0) & (F.col("event_type") != "error")
        return self.read("events").select(
            "event_id",
            F.col("ts"),
            F.concat_ws(" ", F.col("event_type"), (k % 25).cast("string")).alias("query"),
            F.floor("value").cast("bigint").alias("result_count"),
            F.when(clicked, k).alias("selected_category_id"),
            F.when(clicked, F.concat(F.lit("category "), k.cast("string"))).alias("selected_category_name"),
            F.when(k % 10 == 3, F.concat(F.col("event_type"), F.lit("x"))).alias("corrected_from"),
            F.when(user % 7 != 0, F.concat(F.lit("NATION_"), (user % 25).cast("string"))).alias("location"),
            (user % 5 + 5).cast("double").alias("radius_km"),
        )

    @cached_property
    def price_history(self) -> DataFrame:
        line = self.read("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        part = self.read("part").select("p_partkey", "p_type", "p_brand", "p_name")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat_ws("/", "p_type", "p_brand").alias("category_id"),
            F.concat(F.lit("Chain#"), (F.col("l_suppkey") % 10).cast("string")).alias("chain"),
            round_to(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"),
            F.col("l_shipdate").alias("ts"),
        )

    @cached_property
    def basket_lines(self) -> DataFrame:
        """An order is a shopping basket; its lines ask for a category, some of them for a brand in it."""
        line = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        part = self.read("part").select("p_partkey", "p_type", "p_brand", "p_name")
        form = F.col("l_linenumber")
        category = F.when(form % 2 == 1, F.concat_ws("/", "p_type", "p_brand", "p_name")).otherwise(F.concat_ws("/", "p_type", "p_brand"))
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("basket_id"),
            F.concat_ws(
                "-", F.lpad(form.cast("string"), 2, "0"), F.lpad(F.col("l_partkey").cast("string"), 11, "0"),
                F.lpad(F.col("l_suppkey").cast("string"), 10, "0"),
            ).alias("item_no"),
            F.col("p_name").alias("q"),
            F.when(form % 3 == 0, F.col("p_brand")).alias("brand"),
            (form % 3 != 0).alias("any_brand"),
            category.alias("category_id"),
        )


def _raw_offers_sql() -> str:
    sales = "(((p_size % 5) * 100 + 99)::DOUBLE / 100::DOUBLE)"
    dot = f"{sales}::VARCHAR"
    comma = f"replace({dot}, '.', ',')"
    big = "(CASE p_size % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' ELSE 'Dose' END)"
    small = "(CASE p_size % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'Stück' END)"
    amount = "l_quantity::BIGINT"
    return f"""
SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '-' || lpad(l_partkey::VARCHAR, 11, '0') || '-' || lpad(l_suppkey::VARCHAR, 10, '0') || '-' || lpad(l_linenumber::VARCHAR, 2, '0') AS offer_id,
       'Chain#' || (l_suppkey % 10)::VARCHAR AS chain, p_name AS product_name, p_brand AS brand,
       p_name || ' ' || p_brand AS product_key,
       CASE l_linenumber % 5 WHEN 0 THEN 'HKL A ' || ({amount} * 10)::VARCHAR || ' g' WHEN 1 THEN 'je 1 kg'
            WHEN 2 THEN ({amount})::VARCHAR || '-g-Packung' WHEN 3 THEN 'besonders zart je St.' ELSE 'frisch aus der Region' END AS description,
       {sales} AS sales_price,
       {round_to_sql(f"{sales} / (1::DOUBLE - l_discount)", 2)} AS regular_price,
       CASE WHEN l_discount = 0.1::DOUBLE THEN NULL
            WHEN l_linenumber = 1 THEN '(' || ({amount} * 100)::VARCHAR || ' ' || {small} || ' = ' || {comma} || ' €)'
            WHEN l_linenumber = 2 THEN '1 ' || {big} || ' ab ' || {dot}
            WHEN l_linenumber = 3 THEN {dot} || ' €/' || {big}
            WHEN l_linenumber = 4 THEN {dot} || ' €/' || ({amount} * 10)::VARCHAR || {small}
            WHEN l_linenumber = 5 THEN {big} || '-Preis ' || {dot}
            WHEN l_linenumber = 6 THEN {dot} || ' pro ' || {big}
            ELSE {big} || ' = ' || {comma} END AS base_price_text,
       make_date(year(l_shipdate), 1, 1) AS valid_from, make_date(year(l_shipdate), 12, 31) AS valid_until,
       l_orderkey AS brochure_id, l_linenumber::BIGINT AS page_number,
       p_type || '/' || p_brand || '/' || p_name AS own_category_id, 'img/' || (l_partkey % 50)::VARCHAR || '.jpg' AS image_url
FROM lineitem JOIN part ON l_partkey = p_partkey"""


VIEWS: dict[str, str] = {
    "raw_offers": _raw_offers_sql(),
    "product_labels": """
SELECT p_name || ' ' || p_brand AS product_key, p_name AS product_name, p_brand AS marke, min(p_type) AS gattung,
       min(p_type) || '/' || p_brand || '/' || p_name AS category_id
FROM part GROUP BY p_name, p_brand""",
    "unique_offers": f"""
SELECT * FROM raw_offers QUALIFY row_number() OVER (
  PARTITION BY chain, {norm_sql('product_name')}, {norm_sql('brand')}, sales_price, valid_from, valid_until ORDER BY offer_id) = 1""",
    "offers": f"""
SELECT b.* EXCLUDE (quantity, unit, price, price_max, normalized_unit), coalesce(l.category_id, b.own_category_id) AS category_id
FROM ({base_price_select_sql('base_price_text', 'unique_offers')}) b LEFT JOIN product_labels l ON l.product_key = b.product_key""",
    "offer_links": f"""
SELECT min(offer_id) OVER (PARTITION BY chain, {norm_sql('product_name')}, {norm_sql('brand')}, sales_price, valid_from, valid_until) AS offer_id,
       offer_id AS raw_id, brochure_id, page_number, chain FROM raw_offers""",
    "categories": """
SELECT DISTINCT p_type AS category_id, p_type AS name, 1 AS level, NULL::VARCHAR AS parent_id FROM part
UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_brand, 2, p_type FROM part
UNION ALL SELECT DISTINCT p_type || '/' || p_brand || '/' || p_name, p_name, 3, p_type || '/' || p_brand FROM part""",
    "search_labels": """
SELECT product_key, unnest(list_transform(string_split(product_name, ' '), lambda w: lower(w))) AS label, 'suchbegriff' AS label_type FROM product_labels
UNION ALL SELECT product_key, lower(product_name), 'suchbegriff' FROM product_labels
UNION ALL SELECT product_key, lower(marke), 'marke' FROM product_labels
UNION ALL SELECT product_key, lower(gattung), 'gattung' FROM product_labels""",
    "stores": """
SELECT c_custkey AS store_id, c_name AS name, 'Chain#' || (c_custkey % 10)::VARCHAR AS chain,
       47.2::DOUBLE + ((c_custkey * 7919) % 790)::DOUBLE / 100::DOUBLE AS lat,
       5.9::DOUBLE + ((c_custkey * 104729) % 920)::DOUBLE / 100::DOUBLE AS lon,
       CASE WHEN c_custkey % 17 <> 0 THEN 'NATION_' || c_nationkey::VARCHAR END AS city,
       (c_custkey % 300 + 10000)::VARCHAR AS postcode
FROM customer""",
    "locations": """
SELECT s_suppkey AS location_id, 47.2::DOUBLE + ((s_suppkey * 6007) % 790)::DOUBLE / 100::DOUBLE AS lat,
       5.9::DOUBLE + ((s_suppkey * 7001) % 920)::DOUBLE / 100::DOUBLE AS lon FROM supplier""",
    "brochures": """
SELECT o_orderkey AS brochure_id, o_custkey AS store_id, 'Chain#' || (o_custkey % 10)::VARCHAR AS chain,
       o_orderdate::DATE AS valid_from FROM orders""",
    "search_log": """
SELECT event_id, ts, event_type || ' ' || (k % 25)::VARCHAR AS query, floor(value)::BIGINT AS result_count,
       CASE WHEN clicked THEN k END AS selected_category_id, CASE WHEN clicked THEN 'category ' || k::VARCHAR END AS selected_category_name,
       CASE WHEN k % 10 = 3 THEN event_type || 'x' END AS corrected_from,
       CASE WHEN user_id % 7 <> 0 THEN 'NATION_' || (user_id % 25)::VARCHAR END AS location,
       (user_id % 5 + 5)::DOUBLE AS radius_km
FROM (SELECT *, k % 4 <> 0 AND user_id % 3 = 0 AND event_type <> 'error' AS clicked
      FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))""",
    "price_history": f"""
SELECT p_type || '/' || p_brand AS category_id, 'Chain#' || (l_suppkey % 10)::VARCHAR AS chain,
       {round_to_sql('l_extendedprice / l_quantity', 2)} AS price, l_shipdate AS ts
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "basket_lines": """
SELECT l_orderkey AS basket_id,
       lpad(l_linenumber::VARCHAR, 2, '0') || '-' || lpad(l_partkey::VARCHAR, 11, '0') || '-' || lpad(l_suppkey::VARCHAR, 10, '0') AS item_no,
       p_name AS q, CASE WHEN l_linenumber % 3 = 0 THEN p_brand END AS brand, l_linenumber % 3 <> 0 AS any_brand,
       CASE l_linenumber % 2 WHEN 1 THEN p_type || '/' || p_brand || '/' || p_name ELSE p_type || '/' || p_brand END AS category_id
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # (ancestor, descendant) pairs of the taxonomy, each node included with itself
    "closure": """
SELECT category_id AS ancestor_id, category_id AS descendant_id, 0 AS depth FROM categories
UNION ALL SELECT parent_id, category_id, 1 FROM categories WHERE parent_id IS NOT NULL
UNION ALL SELECT p.parent_id, c.category_id, 2 FROM categories c JOIN categories p ON p.category_id = c.parent_id WHERE p.parent_id IS NOT NULL""",
}


#: Views that a statement reads several times at a cost.
WRITTEN = {"categories", "closure", "category_counts", "product_labels", "phrase_forms", "typo_texts", "typo_windows", "typo_parts", "rolled_scores", "ranked_cats", "local_cats", "scope_counts", "in_reach", "siblings"}


def with_views(sql: str) -> str:
    """Put the views a statement uses in front of it, in the order they depend on each other."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    sql = sql.strip()
    ctes = [f"{name} AS {'MATERIALIZED ' * (name in WRITTEN)}({VIEWS[name].strip()})" for name in needed]
    if sql[:5].upper() == "WITH ":
        return "WITH " + ", ".join([*ctes, sql[5:]]) if ctes else sql
    return ("WITH " + ", ".join(ctes) + " " + sql) if ctes else sql
