"""Queries over sources; the nested input is assembled by Spark from the flat tables, then taken apart again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions import chains
from offerloom.functions.numbers import round_to_sql
from offerloom.functions.text import lenient_decimal
from offerloom.operators import catalog
from offerloom.plans.clean import STORE_NAMES, _alias_case_sql, _chain_case_sql, _pick, _pick_sql
from offerloom.plans.registry import query
from offerloom.plans.views import VIEWS, Tables
from offerloom.sources import brochures as br
from offerloom.session import shared_folder
from offerloom.sources import exchange, pages, stores

S = "string"


def nested_brochures(t: Tables):
    """Brochures in the nested shape of their files: an order is a brochure, its lines are pages with one offer each."""
    raw = t.raw_offers
    none = F.lit(None).cast(S)
    deal = lambda kind, price, base: F.struct(F.lit(kind).alias("type"), price.alias("min"), F.lit("EUR").alias("currencyCode"), base.alias("priceByBaseUnit"))
    image = lambda size, url: F.struct(size.alias("size"), url.alias("url"))

    def page(o: Column) -> Column:
        """The page that one printed offer makes."""
        comma = lambda c: F.replace(o[c].cast(S), F.lit("."), F.lit(","))
        product = F.struct(
            F.concat(F.lit(" "), o["product_name"], F.lit("  ")).alias("name"), o["brand"].alias("brandName"),
            F.array(F.struct(o["description"].alias("paragraph")), F.struct(F.lit(" ").alias("paragraph"))).alias("description"),
            F.array(F.struct(F.lit("Food").alias("name"))).alias("categoryPaths"),
        )
        content = F.struct(
            o["offer_id"].alias("id"), F.lit("offer").alias("type"), F.concat(F.lit("img/"), o["offer_id"]).alias("image"),
            F.array(deal("OTHER", none, none), deal("REGULAR_PRICE", comma("regular_price"), none), deal("SALES_PRICE", comma("sales_price"), o["base_price_text"])).alias("deals"),
            F.struct(F.when(o["page_number"] % 2 == 0, "percent").alias("type"), F.when(o["page_number"] % 2 == 0, F.concat((o["page_number"] * 5).cast(S), F.lit(",5"))).alias("value")).alias("discountLabel"),
            F.array(product).alias("products"),
            F.struct(F.struct(F.struct(
                F.struct(F.lit(0.1).alias("x"), (o["page_number"] / 10.0).alias("y")).alias("topLeft"), F.struct(F.lit(0.9).alias("x"), F.lit(1.0).alias("y")).alias("bottomRight"),
            ).alias("area")).alias("page")).alias("parentContent"),
        )
        return F.struct(
            (o["page_number"] - 1).cast("int").alias("number"),
            F.array(
                image(F.lit("100x200"), F.lit("small")), image(F.concat((o["page_number"] * 100).cast(S), F.lit("x300")), F.concat(F.lit("wide"), o["page_number"].cast(S))),
                image(F.lit("bad"), F.lit("none")), image(F.lit("200x100"), F.lit("flat")),
            ).alias("images"),
            F.array(F.lit("a"), F.lit("b")).alias("linkOuts"),
            F.array(F.struct(F.lit("main").alias("placement"), F.lit("std").alias("adFormat"), content.alias("content"))).alias("offers"),
        )

    head = F.struct(
        F.col("brochure_id").cast(S).alias("id"), F.first("brochure_id").alias("legacyId"), F.concat(F.lit("Angebote  "), F.first("brochure_id").cast(S)).alias("title"),
        F.lit("static_brochure").alias("type"), F.count(F.lit(1)).cast("int").alias("pageCount"), F.struct(F.lit("p").alias("id"), F.first("chain").alias("name")).alias("publisher"),
        F.concat(F.min("valid_from").cast(S), F.lit("T00:00:00.000+0000")).alias("validFrom"), F.concat(F.max("valid_until").cast(S), F.lit("T22:59:59.000+0000")).alias("validUntil"),
    )
    # prints are shuffled as they are, pages are made of them afterwards
    printed = F.struct("offer_id", "product_name", "brand", "description", "regular_price", "sales_price", "base_price_text", "page_number")
    grouped = raw.groupBy("brochure_id").agg(F.collect_list(printed).alias("prints"), head.alias("content"))
    return grouped.select("brochure_id", F.transform("prints", page).alias("contents"), "content", F.lit("key").alias("chain_key"))


@query(
    "src1_brochure_folders",
    """SELECT 'chain' || (brochure_id % 10)::VARCHAR AS chain_key, brochure_id::VARCHAR AS folder, brochure_id::VARCHAR AS brochure_id, count(*)::INTEGER AS pages FROM raw_offers
WHERE brochure_id % 7 <> 0 AND brochure_id % 11 <> 0 GROUP BY brochure_id""",
)
def _(t: Tables):
    """Brochures written to the shared folder and read again; some lack their metadata, others their pages."""
    nested = nested_brochures(t).select(
        F.concat(F.lit("chain"), (F.col("brochure_id") % 10).cast(S)).alias("chain_key"), F.col("brochure_id").cast(S).alias("folder"), "content", "contents"
    )
    root = shared_folder(t.spark, "brochures")
    number = F.col("folder").cast("long")
    br.write_folders(nested, root, number % 7 != 0, number % 11 != 0)
    read = br.read_folders(t.spark, root, {"pages": F.size("contents")})
    return read.select("chain_key", "folder", F.col("content.id").alias("brochure_id"), "pages")


@query(
    "src2_offer_details",
    """SELECT offer_id AS offer_content_id, brochure_id AS legacy_id, 'Angebote ' || brochure_id::VARCHAR AS title, 'offer' AS offer_type, 'main' AS placement, 'std' AS ad_format, 'Food' AS categories,
 CASE WHEN page_number % 2 = 0 THEN 'percent' END AS discount_label_type, CASE WHEN page_number % 2 = 0 THEN page_number * 5 + 0.5 END::DOUBLE AS discount_label_value,
 'img/' || offer_id AS offer_image_url, page_number::DOUBLE / 10::DOUBLE AS box_top, 0.9::DOUBLE AS box_right, 3 AS deals FROM raw_offers""",
)
def _(t: Tables):
    """Placement, labels, picture and box of the printed offers."""
    flat = br.flatten_offers(nested_brochures(t))
    return flat.select(
        "offer_content_id", "legacy_id", "title", "offer_type", "placement", "ad_format", F.array_join("category_names", "|").alias("categories"), "discount_label_type", "discount_label_value",
        "offer_image_url", F.col("bbox.top").alias("box_top"), F.col("bbox.right").alias("box_right"), F.size("raw_deals").alias("deals"),
    )


@query(
    "bld4_brochure_details",
    """SELECT brochure_id::VARCHAR AS brochure_id, 'key' AS chain_key, 'Angebote ' || brochure_id::VARCHAR AS title, min(valid_from)::VARCHAR AS valid_from, max(valid_until)::VARCHAR AS valid_until,
 'static_brochure' AS brochure_type, count(*)::INTEGER AS page_count FROM raw_offers GROUP BY brochure_id""",
)
def _(t: Tables):
    """Brochures with title, validity and type out of their metadata; each comes twice, the first counts."""
    nested = nested_brochures(t).withColumn("seq", F.col("brochure_id"))
    later = nested.withColumn("seq", F.col("seq") + 10**12).withColumn("content", F.col("content").withField("title", F.lit("later")))
    return br.brochure_dimension(nested.unionByName(later), "seq").drop("publisher_name")


@query(
    "src2_flatten_offers",
    """SELECT brochure_id::VARCHAR AS brochure_id, page_number, offer_id AS offer_content_id, product_name, brand AS brand_name, description AS description_text,
 brand || ' ' || product_name || ' ' || description AS search_text FROM raw_offers""",
)
def _(t: Tables):
    flat = br.flatten_offers(nested_brochures(t))
    return flat.select("brochure_id", F.col("page_number").cast("bigint").alias("page_number"), "offer_content_id", "product_name", "brand_name", "description_text", "search_text")


@query("src3_deal_values", "SELECT offer_id AS offer_content_id, sales_price, regular_price, 'EUR' AS currency_code, coalesce(base_price_text, '') AS base_price_text FROM raw_offers")
def _(t: Tables):
    return br.flatten_offers(nested_brochures(t)).select("offer_content_id", "sales_price", "regular_price", "currency_code", "base_price_text")


@query(
    "src4_discounts",
    f"""SELECT offer_id AS offer_content_id, a AS discount_amount, {round_to_sql('a / regular_price * 100::DOUBLE', 2)} AS discount_percent FROM (
SELECT *, CASE WHEN regular_price > sales_price THEN {round_to_sql('regular_price - sales_price', 2)} END AS a FROM raw_offers)""",
)
def _(t: Tables):
    return br.flatten_offers(nested_brochures(t)).select("offer_content_id", "discount_amount", "discount_percent")


@query(
    "src5_lenient_decimal",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS parsed FROM lineitem",
)
def _(t: Tables):
    shown = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("ab "), F.col("l_quantity").cast(S))).otherwise(F.replace(F.col("l_quantity").cast(S), F.lit("."), F.lit(",")))
    return t.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", lenient_decimal(shown).alias("parsed"))


@query(
    "src6_page_manifest",
    "SELECT brochure_id::VARCHAR AS brochure_id, page_number, 1 AS offers, 2 AS links, CASE WHEN page_number * 100 * 300 > 20000 THEN 'wide' || page_number::VARCHAR ELSE 'small' END AS image_url FROM raw_offers",
)
def _(t: Tables):
    return br.page_manifest(nested_brochures(t)).select("brochure_id", F.col("page_number").cast("bigint").alias("page_number"), "offers", "links", "image_url")


@query(
    "src7_largest_image",
    """SELECT page_id, CASE WHEN length(url) * 10 * 40 > 200 * 100 THEN 'tall' ELSE 'first' END AS image FROM pages""",
)
def _(t: Tables):
    sizes = [(F.lit("200x100"), "first"), (F.concat((F.length("url") * 10).cast(S), F.lit("x40")), "tall"), (F.lit("100x200"), "second"), (F.lit(""), "none")]
    images = F.array(*[F.struct(size.alias("size"), F.lit(url).alias("url")) for size, url in sizes])
    return t.read("pages").select("page_id", br.largest_image(images).alias("image"))


@query("src8_dataset_summary", "SELECT 'key' AS chain_key, count(*) AS pages, count(*) AS offers, count(sales_price) AS priced FROM raw_offers")
def _(t: Tables):
    nested = nested_brochures(t)
    return br.dataset_summary(br.flatten_offers(nested), br.page_manifest(nested))


def page_html(t: Tables):
    """Crawled pages with the customers' brochures embedded in them as the shop pages do it."""
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
    # plain numbers travel; the items, which are ten times as long, are made where the lines of a page have met
    printed = t.read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))

    def item(x: Column) -> Column:
        number = x["l_linenumber"]
        prices = F.struct(
            F.when(number == 3, 0.0).otherwise(x["l_extendedprice"]).alias("mainPrice"), (x["l_extendedprice"] * 2).alias("secondaryPrice"),
            F.concat(F.lit("1 kg = "), x["l_quantity"].cast(S)).alias("priceByBaseUnit"),
            F.when(x["l_discount"] == 0.05, F.concat(F.lit("jetzt "), number.cast(S), F.lit(",50 € Bonus"))).alias("description"),
        )
        return F.struct(
            F.concat_ws("-", x["l_partkey"].cast(S), x["l_suppkey"].cast(S)).alias("id"),
            F.when(number == 5, "").otherwise(F.concat(F.lit("item "), x["l_partkey"].cast(S))).alias("title"), F.lit("b").alias("brand"),
            _pick(STORE_NAMES, x["l_suppkey"]).alias("publisherName"), F.lit("spare 1,25 € bonus").alias("description"), prices.alias("prices"),
        )

    def of_bucket(name: str) -> Column:
        return F.filter("lines", lambda x: F.when(x["l_linenumber"] <= 3, "main").when(x["l_linenumber"] <= 5, "topRanked").otherwise("otherPublishers") == name)

    lists = []
    for name in pages.BUCKETS:
        chosen = of_bucket(name)
        total = F.size(chosen).cast("bigint") + (3 if name == "main" else 0)
        lists.append(F.struct(F.transform(chosen, item).alias("items"), total.alias("totalItems")).alias(name))
    data = F.struct(F.struct(F.struct(F.struct(F.struct(*lists).alias("offers")).alias("pageInformation")).alias("pageProps")).alias("props"))
    html = F.concat(F.lit('<html><body><script type="application/json" id="__NEXT_DATA__">'), F.to_json(data), F.lit("</script></body></html>"))
    return printed.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


def parsed_pages(t: Tables):
    return pages.parse_pages(page_html(t)).drop("data")


VIEWS["page_items"] = f"""
SELECT *, {_alias_case_sql('lower(trim(publisher))')} AS chain FROM (SELECT l_orderkey AS page_id, l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS item_id, 'item ' || l_partkey::VARCHAR AS title,
 l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price, {_pick_sql(STORE_NAMES, 'l_suppkey')} AS publisher FROM lineitem)"""


@query("src9_embedded_json", "SELECT l_orderkey AS page_id, 1 AS found, count(*) AS items FROM lineitem GROUP BY l_orderkey UNION ALL SELECT -1 - page_id, 0, 0 FROM pages")
def _(t: Tables):
    """Embedded data of shop pages; the other crawled pages have none."""
    crawled = t.read("pages").select((-1 - F.col("page_id")).alias("page_id"), "html")
    parsed = pages.parse_pages(page_html(t).unionByName(crawled), pages.COUNTED_ITEM)
    return pages.truncation(parsed, F.col("data").isNotNull().cast("int").alias("found")).select("page_id", "found", F.col("embedded").alias("items"))


@query("src10_page_offers", "SELECT page_id, item_id, chain, title, price FROM page_items WHERE chain IS NOT NULL AND l_linenumber <> 5")
def _(t: Tables):
    return pages.page_offers(parsed_pages(t)).select("page_id", "item_id", "chain", "title", "price")


@query("src11_truncated_pages", "SELECT l_orderkey AS page_id, count(*) AS embedded, count(*) + 3 AS total, 3 AS gap FROM lineitem GROUP BY l_orderkey")
def _(t: Tables):
    return pages.truncation(pages.parse_pages(page_html(t), pages.COUNTED_ITEM)).where("gap > 0")


@query(
    "src12_merged_pages",
    """SELECT chain, item_id, page_id, price FROM page_items WHERE chain IS NOT NULL AND l_linenumber <> 5
QUALIFY row_number() OVER (PARTITION BY chain, item_id ORDER BY page_id DESC, l_linenumber DESC) = 1""",
)
def _(t: Tables):
    return pages.merge_pages(pages.page_offers(parsed_pages(t))).select("chain", "item_id", "page_id", "price")


@query(
    "src13_bonus_cents",
    "SELECT page_id, item_id, CASE WHEN l_discount = 0.05::DOUBLE THEN l_linenumber * 100 + 50 ELSE 125 END::BIGINT AS bonus_cents FROM page_items WHERE chain IS NOT NULL AND l_linenumber <> 5",
)
def _(t: Tables):
    return pages.page_offers(parsed_pages(t)).select("page_id", "item_id", "bonus_cents")


def elements(t: Tables):
    """Map elements: customers as nodes, every third as a way with a centre, some named twice."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("double")
    point = t.stores.select(F.col("store_id").alias("c_custkey"), "lat", "lon", "postcode", "city")
    rows = t.read("customer").join(point, "c_custkey")
    way = k % 3 == 0
    tags = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ("name", "brand", "operator", "addr:street", "addr:housenumber", "addr:postcode", "addr:city")]),
        F.array(F.when(k % 5 != 0, _pick(STORE_NAMES, "c_custkey")), _pick(STORE_NAMES, "c_nationkey"), F.col("c_mktsegment"), F.when(k % 4 != 0, F.lit("Hauptstr.")), (k % 90).cast(S), F.col("postcode"), F.col("city")),
    )
    base = rows.select(
        k.alias("seq"), F.when(way, "way").otherwise("node").alias("type"), F.floor(k / 2).alias("id"), F.when(~way & (k % 7 != 0), F.col("lat")).otherwise(none).alias("lat"),
        F.when(~way & (k % 7 != 0), F.col("lon")).otherwise(none).alias("lon"), F.when(way, F.struct("lat", "lon")).alias("center"), tags.alias("tags"),
    )
    return base


@query(
    "src14_map_elements",
    f"""SELECT type, id, coalesce(n, b, op, 'Unbekannt') AS name, coalesce({_chain_case_sql("lower(coalesce(b || ' ', '') || op || coalesce(' ' || n, ''))")}, 'Sonstige') AS chain, lat, lon,
 concat_ws(', ', CASE WHEN k % 4 <> 0 THEN 'Hauptstr. ' || (k % 90)::VARCHAR END, concat_ws(' ', postcode, city)) AS address FROM (
 SELECT *, CASE WHEN k % 3 = 0 THEN 'way' ELSE 'node' END AS type, k // 2 AS id FROM (SELECT c_custkey AS k, c_mktsegment AS op, s.lat, s.lon, s.postcode, s.city,
  CASE WHEN c_custkey % 5 <> 0 THEN nullif({_pick_sql(STORE_NAMES, 'c_custkey')}, '') END AS n, nullif({_pick_sql(STORE_NAMES, 'c_nationkey')}, '') AS b
  FROM customer JOIN stores s ON s.store_id = c_custkey) WHERE k % 3 = 0 OR k % 7 <> 0) QUALIFY row_number() OVER (PARTITION BY type, id ORDER BY k DESC) = 1""",
)
def _(t: Tables):
    return stores.flatten_elements(elements(t))


@query(
    "src15_mapped_sources",
    """SELECT source, store_id, name, chain, lat, lon, address, postcode, city_name FROM (
 SELECT 'aldi' AS source, store_id::VARCHAR AS store_id, trim('Aldi ' || coalesce(city, '')) AS name, 'Aldi' AS chain, lat, lon, 'Weg ' || store_id::VARCHAR AS address, postcode, city AS city_name FROM stores WHERE store_id % 3 = 0
 UNION ALL SELECT 'edeka', store_id::VARCHAR, CASE WHEN store_id % 2 = 0 THEN 'Marktkauf ' || store_id::VARCHAR ELSE trim('Edeka ' || coalesce(city, '')) END, CASE WHEN store_id % 2 = 0 THEN 'Marktkauf' ELSE 'Edeka' END, lat, lon,
  'Platz ' || store_id::VARCHAR, postcode, city FROM stores WHERE store_id % 3 = 1
 UNION ALL SELECT 'norma', store_id::VARCHAR, trim('Norma ' || coalesce(city, '')), 'Norma', lat, lon, NULL, postcode, city FROM stores WHERE store_id % 3 = 2 AND store_id % 4 <> 0)""",
)
def _(t: Tables):
    """Store lists of three sources, each with its own field names, as rows of one table."""
    k, lat, lon = F.col("store_id"), F.col("lat").alias("lat"), F.col("lon")
    named = F.concat(F.lit("Marktkauf "), k.cast(S))
    records = {
        "aldi": (k % 3 == 0, F.struct(k.cast(S).alias("identifier"), lat, lon.alias("lng"), F.concat(F.lit("Weg "), k.cast(S)).alias("streetAndNumber"), F.col("postcode").alias("zip"), "city")),
        "edeka": (k % 3 == 1, F.struct(
            k.alias("id"), F.when(k % 2 == 0, named).alias("name"), F.struct(lat, lon.alias("lng")).alias("coordinates"), F.lit("regional").alias("distributionChannel"),
            F.struct(F.concat(F.lit("Platz "), k.cast(S)).alias("street"), F.col("postcode").alias("zipCode"), "city").alias("address"),
        )),
        "norma": (k % 3 == 2, F.struct(k.alias("id"), F.when(k % 4 != 0, F.col("lat")).alias("latitude"), lon.alias("longitude"), F.col("postcode").alias("zip"), F.col("city").alias("ort"))),
    }
    mapped = [stores.map_source(t.stores.where(rows).select(F.to_json(record).alias("record")), source) for source, (rows, record) in records.items()]
    return mapped[0].unionByName(mapped[1]).unionByName(mapped[2])


@query(
    "src15_store_upsert",
    """SELECT store_id, arg_max(name, v) AS name, arg_max(chain, v) AS chain, min(v) AS created, max(v) AS updated FROM (SELECT store_id, name, chain, 1 AS v FROM stores WHERE city IS NOT NULL
 UNION ALL SELECT store_id, lower(name), chain, 2 FROM stores WHERE lat > 50 UNION ALL SELECT s_suppkey, s_name, 'Supplier', 3 FROM supplier) GROUP BY store_id""",
)
def _(t: Tables):
    cols = ["store_id", "name", "chain", "v"]
    first = t.stores.where("city IS NOT NULL").withColumn("v", F.lit(1)).select(*cols)
    second = t.stores.where("lat > 50").withColumn("name", F.lower("name")).withColumn("v", F.lit(2)).select(*cols)
    third = t.read("supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("name"), F.lit("Supplier").alias("chain"), F.lit(3).alias("v"))
    return stores.upsert(first.unionByName(second).unionByName(third), ["store_id"], "v", ["name", "chain"])


@query(
    "src16_chain_split",
    f"SELECT chain, count(*) AS n FROM (SELECT CASE WHEN contains(lower(c_mktsegment || ' ' || {_pick_sql(STORE_NAMES, 'c_custkey')}), 'marktkauf') THEN 'Marktkauf' ELSE 'Edeka' END AS chain FROM customer) GROUP BY chain",
)
def _(t: Tables):
    return t.read("customer").select(chains.split_chain(F.col("c_mktsegment"), _pick(STORE_NAMES, "c_custkey")).alias("chain")).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


@query("src17_grid_dedup", "SELECT min(store_id) AS store_id FROM stores WHERE lat BETWEEN 47 AND 56 AND lon BETWEEN 5 AND 16 GROUP BY round(lat, 5), round(lon, 5)")
def _(t: Tables):
    return stores.thin_grid(t.stores, "store_id").select("store_id")


_LINKS_SQL = "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS link FROM pages"


@query(
    "src18_next_frontier",
    f"SELECT link, count(*) AS pages FROM ({_LINKS_SQL}) WHERE link NOT IN (SELECT regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) FROM pages UNION SELECT lang FROM documents) GROUP BY link",
)
def _(t: Tables):
    visited = t.read("pages").select(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("link"))
    queued = t.read("documents").select(F.col("lang").alias("link")).distinct()
    return pages.next_frontier(pages.page_links(t.read("pages")), visited.unionByName(queued))


@query(
    "src19_discoveries",
    """SELECT content_id, arg_min(chain_key, seq) AS chain_key, arg_min(place, seq) AS place, count(*) AS found, count(DISTINCT place) AS places FROM (
SELECT offer_id AS seq, brochure_id AS content_id, chain AS chain_key, product_name AS place FROM raw_offers) GROUP BY content_id""",
)
def _(t: Tables):
    seen = t.raw_offers.select(F.col("offer_id").alias("seq"), F.col("brochure_id").alias("content_id"), F.col("chain").alias("chain_key"), F.col("product_name").alias("place"))
    return pages.discoveries(seen)


@query(
    "src20_request_lines",
    "SELECT idx // 50 AS batch, count(*) AS n, '{\"custom_id\":\"batch_' || lpad((idx // 50)::VARCHAR, 3, '0') || '\",\"content\":\"' || string_agg('[' || idx::VARCHAR || '] ' || p_name || ' | Marke: ' || p_brand, '\\n' ORDER BY idx) || '\"}' AS line "
    "FROM (SELECT p_partkey AS idx, p_name, p_brand FROM part) GROUP BY idx // 50",
)
def _(t: Tables):
    listed = t.read("part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.col("p_brand").alias("brand"))
    return exchange.request_lines(listed)


@query(
    "src21_response_items",
    "SELECT p_partkey AS i, p_type AS ok, p_name AS uk FROM part WHERE p_size <> 7",
)
def _(t: Tables):
    """Answers in several wrappings; those with an error status are rejected."""
    one = F.to_json(F.struct(F.col("p_partkey").alias("i"), F.col("p_type").alias("ok"), F.col("p_name").alias("uk"), F.array("p_brand").alias("s")))
    form = F.col("p_size") % 4
    content = (
        F.when(form == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(form == 1, F.concat(F.lit('{"results": ['), one, F.lit("]}")))
        .when(form == 2, F.concat(F.lit('{"0": '), one, F.lit("}"))).otherwise(F.concat(F.lit("["), one, F.lit(', {"x": 1}]')))
    )
    answers = t.read("part").select(F.col("p_partkey").cast(S).alias("custom_id"), F.when(F.col("p_size") == 7, 500).otherwise(200).alias("status"), content.alias("content"))
    return exchange.response_items(answers)[0].select("i", "ok", "uk")


@query(
    "src22_store_pages",
    """SELECT 'Filialen/' || o_custkey::VARCHAR AS path, (arg_max(o_orderkey, (o_orderdate, o_orderkey)))::VARCHAR AS brochure_ids FROM orders GROUP BY o_custkey""",
)
def _(t: Tables):
    o = t.read("orders")
    key = F.col("o_orderkey").cast(S)
    crawl = o.select(
        F.concat(F.lit("Filialen/"), F.col("o_custkey").cast(S)).alias("path"), F.struct("o_orderdate", "o_orderkey").alias("crawled"), F.lit("x").alias("place"),
        F.array(key, F.lit(None).cast(S)).alias("viewer"), F.array(key).alias("publisher"),
    )
    return stores.flatten_store_pages(crawl).select("path", F.array_join("brochure_ids", ",").alias("brochure_ids"))
