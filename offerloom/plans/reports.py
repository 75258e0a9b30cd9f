"""Queries over the taxonomy, search logs, price history and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions.numbers import round_to, round_to_sql
from offerloom.operators import catalog, taxonomy
from offerloom.plans.places import in_reach, reach
from offerloom.plans.registry import query
from offerloom.plans.views import VIEWS, Tables


def rows():
    return F.count(F.lit(1))


# --- taxonomy ----------------------------------------------------------------------------------------------------------

VIEWS["category_counts"] = """
SELECT x.ancestor_id AS category_id, count(*) AS n FROM closure x JOIN product_labels l ON l.category_id = x.descendant_id GROUP BY x.ancestor_id"""


def category_counts(t: Tables):
    """Labelled products per category, everything below it included."""
    direct = t.product_labels.groupBy("category_id").agg(rows().alias("n")).withColumnRenamed("category_id", "descendant_id")
    return taxonomy.closure(t.categories).join(direct, "descendant_id").groupBy(F.col("ancestor_id").alias("category_id")).agg(F.sum("n").alias("n"))


@query("tax1_closure", "SELECT ancestor_id, descendant_id, depth FROM closure")
def _(t: Tables):
    return taxonomy.closure(t.categories)


@query("tax2_expansion", "SELECT category_id, count(*) AS members, min(member_id) AS first_member, max(member_id) AS last_member FROM expansion GROUP BY category_id")
def _(t: Tables):
    return taxonomy.expansion(t.categories).groupBy("category_id").agg(rows().alias("members"), F.min("member_id").alias("first_member"), F.max("member_id").alias("last_member"))


VIEWS["siblings"] = """
SELECT c.category_id, s.category_id AS sibling_id, coalesce(k.n, 0)::BIGINT AS n FROM categories c JOIN categories s ON s.parent_id = c.parent_id AND s.level = c.level AND s.category_id <> c.category_id
 LEFT JOIN category_counts k ON k.category_id = s.category_id WHERE c.level > 1
UNION ALL SELECT c.category_id, c.parent_id, k.n::BIGINT FROM categories c JOIN category_counts k ON k.category_id = c.parent_id WHERE c.level = 3 AND k.n > 0"""


@query(
    "tax3_siblings",
    "SELECT category_id, sibling_id, n FROM siblings QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY n DESC, sibling_id) <= 6",
)
def _(t: Tables):
    return taxonomy.siblings(t.categories, category_counts(t), 6)


@query(
    "tax4_alternative_offers",
    """WITH s AS (SELECT c.category_id, x.category_id AS other_id FROM categories c JOIN categories x ON x.level = 3 AND
 ((c.level = 3 AND x.parent_id = c.parent_id AND x.category_id <> c.category_id) OR (c.level = 2 AND x.parent_id = c.category_id))),
o AS (SELECT category_id AS other_id, offer_id, sales_price, row_number() OVER (PARTITION BY category_id ORDER BY sales_price IS NULL, sales_price, offer_id) AS rn FROM offers),
g AS (SELECT other_id, count(*) AS n FROM o WHERE rn <= 4 GROUP BY other_id),
k AS (SELECT s.category_id, s.other_id, row_number() OVER (PARTITION BY s.category_id ORDER BY g.n DESC, s.other_id) AS gr FROM s JOIN g USING (other_id))
SELECT k.category_id, k.other_id, o.offer_id FROM k JOIN o USING (other_id) WHERE k.gr <= 6 AND o.rn <= 4""",
)
def _(t: Tables):
    return taxonomy.alternative_offers(t.categories, t.offers, 4, 6)


VIEWS["tiles"] = """
SELECT x.ancestor_id AS category_id, count(DISTINCT o.offer_id) AS n FROM closure x JOIN categories c ON c.category_id = x.ancestor_id AND c.level = 1
JOIN offers o ON o.category_id = x.descendant_id WHERE x.depth > 0 AND o.sales_price IS NOT NULL GROUP BY x.ancestor_id"""


@query("tax5_category_tiles", "SELECT category_id, n FROM tiles QUALIFY row_number() OVER (ORDER BY n DESC, category_id) <= 12")
def _(t: Tables):
    return taxonomy.tiles(t.categories, t.offers, 12)


@query(
    "tax6_tile_dedup",
    "SELECT a.name FROM (SELECT DISTINCT product_name AS name FROM product_labels UNION SELECT DISTINCT split_part(product_name, ' ', 2) FROM product_labels) a "
    "WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT product_name AS name FROM product_labels UNION SELECT DISTINCT split_part(product_name, ' ', 2) FROM product_labels) b "
    "WHERE contains(lower(a.name), lower(b.name)) AND length(a.name) > length(b.name))",
)
def _(t: Tables):
    names = t.product_labels.select(F.col("product_name").alias("name"))
    return taxonomy.drop_containing_names(names.unionByName(names.select(F.split_part("name", F.lit(" "), F.lit(2)).alias("name"))).distinct())


@query(
    "tax7_category_offers",
    """SELECT category_id, offer_id, sales_price, rn FROM (SELECT x.ancestor_id AS category_id, o.offer_id, o.sales_price,
 row_number() OVER (PARTITION BY x.ancestor_id ORDER BY o.sales_price, o.offer_id) AS rn FROM closure x JOIN offers o ON o.category_id = x.descendant_id
 WHERE o.sales_price IS NOT NULL) WHERE rn > 20 AND rn <= 60""",
)
def _(t: Tables):
    """Second page and third page of twenty of every category, by price."""
    return taxonomy.OfferPages(t.categories, t.offers).page(20, 40).select("category_id", "offer_id", "sales_price", F.col("rn").cast("int").alias("rn"))


@query(
    "tax7_page_heads",
    """WITH n AS (SELECT x.ancestor_id AS category_id, count(*) AS total FROM closure x JOIN offers o ON o.category_id = x.descendant_id WHERE o.sales_price IS NOT NULL GROUP BY x.ancestor_id)
SELECT n.category_id, n.total, CASE WHEN 60 < n.total THEN 1 ELSE 0 END AS has_more, coalesce(b.below, '') AS subcategories FROM n LEFT JOIN (
 SELECT c.parent_id, string_agg(c.name || ':' || k.total::VARCHAR, '|' ORDER BY c.name, k.total) AS below FROM categories c JOIN n k ON k.category_id = c.category_id GROUP BY c.parent_id) b ON b.parent_id = n.category_id""",
)
def _(t: Tables):
    """Totals, whether more follows and the sub-categories of the same pages."""
    return taxonomy.OfferPages(t.categories, t.offers).heads(20, 40)


@query(
    "tax8_count_invariant",
    """SELECT p.category_id, p.n AS counted, coalesce(d.n, 0) + coalesce(c.n, 0) AS expected FROM category_counts p JOIN categories t ON t.category_id = p.category_id AND t.level = 2
LEFT JOIN (SELECT category_id, count(*) AS n FROM product_labels GROUP BY category_id) d ON d.category_id = p.category_id
LEFT JOIN (SELECT c.parent_id, sum(k.n)::BIGINT AS n FROM categories c JOIN category_counts k USING (category_id) GROUP BY c.parent_id) c ON c.parent_id = p.category_id""",
)
def _(t: Tables):
    counts = category_counts(t)
    return taxonomy.count_check(t.categories, counts, t.product_labels)


@query(
    "tax9_structure_checks",
    """SELECT level, count(*) AS nodes, sum(CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS roots, coalesce(sum(n), 0)::BIGINT AS products
FROM categories LEFT JOIN category_counts USING (category_id) GROUP BY level""",
)
def _(t: Tables):
    return t.categories.join(category_counts(t), "category_id", "left").groupBy("level").agg(
        rows().alias("nodes"), F.sum(F.col("parent_id").isNull().cast("bigint")).alias("roots"), F.coalesce(F.sum("n"), F.lit(0)).alias("products")
    )


@query(
    "tax9_group_not_below_child",
    """SELECT c.parent_id, c.category_id, p.n::BIGINT AS parent_n, k.n::BIGINT AS n, CASE WHEN p.n >= k.n THEN 1 ELSE 0 END AS ok FROM categories c JOIN category_counts k ON k.category_id = c.category_id
JOIN category_counts p ON p.category_id = c.parent_id""",
)
def _(t: Tables):
    """No group has fewer products than one of its children."""
    counts = category_counts(t)
    return taxonomy.group_check(t.categories, counts)


@query(
    "tax9_local_within_global",
    """SELECT s.location_id, s.category_id, s.offers::BIGINT AS local_n, k.n::BIGINT AS global_n, CASE WHEN s.offers <= floor(k.n * 1.5::DOUBLE) + 5 THEN 1 ELSE 0 END AS ok
FROM scope_counts s JOIN category_counts k USING (category_id)""",
)
def _(t: Tables):
    """Local counts against the products of the whole country."""
    from offerloom.operators import scope

    near, places = reach(t)
    local = scope.scope_category_counts(*near, t.offers, t.categories, *places)
    return taxonomy.local_check(local, category_counts(t))


@query(
    "jn4_label_chain",
    """SELECT s.label, s.label_type, c.category_id, c.name, p.name AS parent_name, g.name AS grandparent_name FROM search_labels s JOIN product_labels l USING (product_key)
JOIN categories c ON c.category_id = l.category_id LEFT JOIN categories p ON p.category_id = c.parent_id LEFT JOIN categories g ON g.category_id = p.parent_id""",
)
def _(t: Tables):
    labelled = t.search_labels.join(t.product_labels.select("product_key", "category_id"), "product_key")
    return taxonomy.with_ancestors(labelled, t.categories).select("label", "label_type", "category_id", "name", "parent_name", "grandparent_name")


@query(
    "jn5_subtree_offers",
    "SELECT x.ancestor_id AS category_id, o.chain, count(*) AS n FROM closure x JOIN categories c ON c.category_id = x.ancestor_id AND c.level = 1 JOIN offers o ON o.category_id = x.descendant_id GROUP BY x.ancestor_id, o.chain",
)
def _(t: Tables):
    per = t.offers.groupBy(F.col("category_id").alias("descendant_id"), "chain").agg(rows().alias("n"))
    roots = t.categories.where("level = 1").select(F.col("category_id").alias("ancestor_id"))
    tree = taxonomy.closure(t.categories).join(roots, "ancestor_id")
    return tree.join(per, "descendant_id").groupBy(F.col("ancestor_id").alias("category_id"), "chain").agg(F.sum("n").alias("n"))


@query(
    "jn7_orphans",
    "SELECT c.category_id, c.level FROM categories c WHERE c.level > 1 AND NOT EXISTS (SELECT 1 FROM categories p WHERE p.category_id = c.parent_id AND p.level = c.level - 1 AND p.name <> 'Brand#3')",
)
def _(t: Tables):
    """Nodes whose parent is missing from a taxonomy out of which one brand was taken."""
    return taxonomy.orphans(t.categories, t.categories.where(F.col("name") != "Brand#3"))


# --- search log --------------------------------------------------------------------------------------------------------


@query("log1_top_queries", "SELECT query, count(*) AS n FROM search_log GROUP BY query ORDER BY n DESC, query LIMIT 20")
def _(t: Tables):
    return t.search_log.groupBy("query").agg(rows().alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query(
    "log2_never_clicked",
    "SELECT query, count(*) AS n FROM search_log GROUP BY query HAVING count(selected_category_id) = 0 AND count(*) >= 2 ORDER BY n DESC, query LIMIT 20",
)
def _(t: Tables):
    per = t.search_log.groupBy("query").agg(rows().alias("n"), F.count("selected_category_id").alias("clicks"))
    return per.where("clicks = 0 AND n >= 2").select("query", "n").orderBy(F.desc("n"), "query").limit(20)


@query(
    "jn6_queries_without_click",
    "SELECT DISTINCT query FROM search_log s WHERE NOT EXISTS (SELECT 1 FROM search_log c WHERE c.query = s.query AND c.selected_category_id IS NOT NULL)",
)
def _(t: Tables):
    clicked = t.search_log.where(F.col("selected_category_id").isNotNull()).select("query").distinct()
    return t.search_log.select("query").distinct().join(clicked, "query", "left_anti")


@query(
    "log3_selected_categories",
    "SELECT selected_category_id, min(selected_category_name) AS name, count(*) AS n FROM search_log WHERE selected_category_id IS NOT NULL GROUP BY selected_category_id ORDER BY n DESC, selected_category_id LIMIT 20",
)
def _(t: Tables):
    hit = t.search_log.where(F.col("selected_category_id").isNotNull())
    return hit.groupBy("selected_category_id").agg(F.min("selected_category_name").alias("name"), rows().alias("n")).orderBy(F.desc("n"), "selected_category_id").limit(20)


@query("log4_zero_results", "SELECT query, count(*) AS n FROM search_log WHERE result_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 20")
def _(t: Tables):
    return t.search_log.where("result_count = 0").groupBy("query").agg(rows().alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query(
    "log5_click_through",
    f"SELECT count(result_count) AS searches, count(selected_category_id) AS clicks, {round_to_sql('count(selected_category_id)::DOUBLE / count(result_count) * 100::DOUBLE', 2)} AS ctr FROM search_log",
)
def _(t: Tables):
    both = t.search_log.agg(F.count("result_count").alias("searches"), F.count("selected_category_id").alias("clicks"))
    return both.withColumn("ctr", F.when(F.col("searches") > 0, round_to(F.col("clicks") / F.col("searches") * 100, 2)))


@query(
    "log6_corrections",
    "SELECT corrected_from, count(*) AS n, arg_max(query, (m, query)) AS query FROM (SELECT corrected_from, query, count(*) OVER (PARTITION BY corrected_from, query) AS m FROM search_log WHERE corrected_from IS NOT NULL) GROUP BY corrected_from ORDER BY n DESC, corrected_from LIMIT 15",
)
def _(t: Tables):
    per = t.search_log.where(F.col("corrected_from").isNotNull()).groupBy("corrected_from", "query").agg(rows().alias("m"))
    return per.groupBy("corrected_from").agg(F.sum("m").alias("n"), F.max_by("query", F.struct("m", "query")).alias("query")).orderBy(F.desc("n"), "corrected_from").limit(15)


@query("log7_locations", "SELECT location, count(*) AS n FROM search_log WHERE location IS NOT NULL AND location <> '' GROUP BY location ORDER BY n DESC, location LIMIT 10")
def _(t: Tables):
    return t.search_log.where("location IS NOT NULL AND location <> ''").groupBy("location").agg(rows().alias("n")).orderBy(F.desc("n"), "location").limit(10)


@query(
    "agg3_popular_items",
    "SELECT selected_category_id, count(*) AS n FROM search_log WHERE selected_category_id IS NOT NULL AND ts > (SELECT max(ts) - INTERVAL 30 DAY FROM search_log) GROUP BY selected_category_id ORDER BY n DESC, selected_category_id LIMIT 10",
)
def _(t: Tables):
    last = t.search_log.agg((F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("since"))
    recent = t.search_log.where(F.col("selected_category_id").isNotNull()).join(F.broadcast(last), F.col("ts") > F.col("since"))
    return recent.groupBy("selected_category_id").agg(rows().alias("n")).orderBy(F.desc("n"), "selected_category_id").limit(10)


@query(
    "agg6_search_log_capture",
    """SELECT doc_id, substr(text, 1, 500) AS query, try_cast(n_chars::VARCHAR AS BIGINT) AS result_count, substr(source || ' ' || text, 1, 200) AS category_name,
 try_cast(lang AS DOUBLE) AS radius_km FROM documents""",
)
def _(t: Tables):
    from offerloom.streaming.logs import capture_search

    raw = t.read("documents").select(
        "doc_id", F.col("text").alias("query"), F.col("n_chars").cast("string").alias("result_count"),
        F.concat_ws(" ", "source", "text").alias("category_name"), F.col("lang").alias("radius_km"),
    )
    return capture_search(raw).select("doc_id", "query", "result_count", "category_name", "radius_km")


# --- catalogue and price reports ------------------------------------------------------------------------------------------


@query(
    "agg1_catalog_stats",
    """SELECT count(*) AS offers, count(DISTINCT chain) AS chains, max(valid_from) AS latest, CASE WHEN d < 0 THEN 'gerade eben' WHEN d = 0 THEN 'heute' WHEN d = 1 THEN 'vor 1 Tag'
 WHEN d < 7 THEN 'vor ' || d::VARCHAR || ' Tagen' WHEN d // 7 = 1 THEN 'vor 1 Woche' ELSE 'vor ' || (d // 7)::VARCHAR || ' Wochen' END AS age
FROM (SELECT *, date_diff('day', max(valid_from) OVER (), DATE '2002-01-05') AS d FROM unique_offers) GROUP BY d""",
)
def _(t: Tables):
    per_chain = t.offers.groupBy("chain").agg(rows().alias("n"), F.max("valid_from").alias("latest"))
    stats = per_chain.agg(F.sum("n").alias("offers"), rows().alias("chains"), F.max("latest").alias("latest"))
    d = F.datediff(F.lit("2002-01-05").cast("date"), "latest")
    weeks = F.floor(d / 7)
    age = (
        F.when(d < 0, "gerade eben").when(d == 0, "heute").when(d == 1, "vor 1 Tag")
        .when(d < 7, F.concat(F.lit("vor "), d.cast("string"), F.lit(" Tagen")))
        .when(weeks == 1, "vor 1 Woche").otherwise(F.concat(F.lit("vor "), weeks.cast("string"), F.lit(" Wochen")))
    )
    return stats.withColumn("age", age)


@query(
    "agg2_local_coverage",
    "SELECT city, count(DISTINCT chain) AS chains, count(*) AS stores FROM stores WHERE city IS NOT NULL AND city <> '' GROUP BY city ORDER BY chains DESC, stores DESC, city LIMIT 25",
)
def _(t: Tables):
    per = t.stores.where("city IS NOT NULL AND city <> ''").groupBy("city", "chain").agg(rows().alias("n"))
    return per.groupBy("city").agg(rows().alias("chains"), F.sum("n").alias("stores")).orderBy(F.desc("chains"), F.desc("stores"), "city").limit(25)


@query("agg2_places_per_chain", "SELECT chain, count(DISTINCT city) AS places FROM stores WHERE city IS NOT NULL AND city <> '' GROUP BY chain")
def _(t: Tables):
    return t.stores.where("city IS NOT NULL AND city <> ''").select("chain", "city").distinct().groupBy("chain").agg(rows().alias("places"))


_DAILY_SQL = f"""SELECT category_id, ts::DATE AS day, {round_to_sql('avg(price)', 2)} AS avg_price, min(price) AS min_price, max(price) AS max_price, count(*) AS samples
FROM price_history GROUP BY category_id, ts::DATE"""


def daily_prices(t: Tables):
    return t.price_history.groupBy("category_id", F.to_date("ts").alias("day")).agg(
        round_to(F.avg("price"), 2).alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), rows().alias("samples")
    )


@query("agg4_price_trend", _DAILY_SQL)
def _(t: Tables):
    return daily_prices(t)


@query(
    "agg4_price_direction",
    f"""SELECT category_id, count(*) AS days, CASE WHEN count(*) < 2 THEN 'stable' WHEN arg_max(avg_price, day) < arg_min(avg_price, day) * 0.95::DOUBLE THEN 'down'
 WHEN arg_max(avg_price, day) > arg_min(avg_price, day) * 1.05::DOUBLE THEN 'up' ELSE 'stable' END AS direction FROM ({_DAILY_SQL}) GROUP BY category_id""",
)
def _(t: Tables):
    first, last = F.min_by("avg_price", "day"), F.max_by("avg_price", "day")
    direction = F.when(rows() < 2, "stable").when(last < first * 0.95, "down").when(last > first * 1.05, "up").otherwise("stable")
    return daily_prices(t).groupBy("category_id").agg(rows().alias("days"), direction.alias("direction"))


@query(
    "agg5_price_samples",
    "SELECT l.category_id, l.q, r.chain, r.store_id, l.price FROM store_ranking r JOIN priced_lines l ON l.basket_id = r.basket_id AND l.chain = r.chain WHERE r.rank <= 3 AND l.price IS NOT NULL",
)
def _(t: Tables):
    from offerloom.plans.baskets import first_stores, priced

    top = first_stores(t, 3).select("basket_id", "chain", "store_id")
    return priced(t).where(F.col("price").isNotNull()).join(top, ["basket_id", "chain"]).select("category_id", "q", "chain", "store_id", "price")


@query("rep1_stores_per_chain", "SELECT chain, count(*) AS after, sum(CASE WHEN city IS NULL THEN 0 ELSE 1 END)::BIGINT AS before FROM stores GROUP BY chain")
def _(t: Tables):
    return t.stores.groupBy("chain").agg(rows().alias("after"), F.count("city").alias("before"))


_RECONCILE_SQL = """SELECT coalesce(a.chain, b.chain) AS chain, coalesce(a.n, 0) AS stores, coalesce(b.n, 0) AS brochures, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM (SELECT chain, count(*) AS n FROM stores WHERE chain <> 'Chain#2' GROUP BY chain) a FULL JOIN (SELECT chain, count(*) AS n FROM brochures WHERE chain <> 'Chain#5' GROUP BY chain) b ON a.chain = b.chain"""


@query("jn12_reconciliation", _RECONCILE_SQL)
def _(t: Tables):
    left = t.stores.where(F.col("chain") != "Chain#2").groupBy("chain").agg(rows().alias("stores"))
    right = t.brochures.where(F.col("chain") != "Chain#5").groupBy("chain").agg(rows().alias("brochures"))
    zero = F.lit(0).cast("bigint")
    both = left.join(right, "chain", "full_outer").select("chain", F.coalesce("stores", zero).alias("stores"), F.coalesce("brochures", zero).alias("brochures"))
    return both.withColumn("delta", F.col("brochures") - F.col("stores"))


@query(
    "rep2_source_vs_table",
    """SELECT coalesce(a.chain, b.chain) AS chain, coalesce(a.n, 0) AS raw_offers_n, coalesce(b.n, 0) AS unique_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM (SELECT chain, count(*) AS n FROM raw_offers GROUP BY chain) a FULL JOIN (SELECT chain, count(*) AS n FROM unique_offers GROUP BY chain) b ON a.chain = b.chain""",
)
def _(t: Tables):
    left = t.raw_offers.groupBy("chain").agg(rows().alias("raw_offers_n"))
    both = left.join(t.offers.groupBy("chain").agg(rows().alias("unique_n")), "chain", "full_outer").na.fill(0)
    return both.withColumn("delta", F.col("unique_n") - F.col("raw_offers_n"))


VIEWS["download_status"] = """
SELECT brochure_id, chain, pages, done, failed, CASE WHEN kind = 'P' THEN 'skipped' WHEN NOT saved THEN 'pending' WHEN pages > 0 AND done >= pages THEN 'done'
 WHEN done > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'pending' END AS status
FROM (SELECT l.l_orderkey AS brochure_id, 'Chain#' || (o.o_custkey % 10)::VARCHAR AS chain, o.o_orderstatus AS kind, o.o_orderpriority <> '5-LOW' AS saved, count(*) AS pages,
  sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::BIGINT AS done, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS failed
 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL)"""


def download_status(t: Tables):
    """Status of every brochure from the status of its pages."""
    pages = t.read("lineitem").groupBy("l_orderkey").agg(
        rows().alias("pages"), F.sum((F.col("l_returnflag") != "R").cast("bigint")).alias("done"), F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("failed")
    )
    head = t.read("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("Chain#"), (F.col("o_custkey") % 10).cast("string")).alias("chain"),
        (F.col("o_orderstatus") != "P").alias("plain"), (F.col("o_orderpriority") != "5-LOW").alias("saved"),
    )
    status = (
        F.when(~F.col("plain"), "skipped").when(~F.col("saved"), "pending").when((F.col("pages") > 0) & (F.col("done") >= F.col("pages")), "done")
        .when(F.col("done") > 0, "partial").when(F.col("failed") > 0, "failed").otherwise("pending")
    )
    return pages.join(head, "l_orderkey").select(F.col("l_orderkey").alias("brochure_id"), "chain", "pages", "done", "failed", status.alias("status"))


@query("rep3_download_status", "SELECT brochure_id, chain, pages, done, failed, status FROM download_status")
def _(t: Tables):
    return download_status(t)


@query(
    "rep3_chain_progress",
    """SELECT chain, count(*) AS total, sum(CASE WHEN status IN ('done', 'skipped') THEN 1 ELSE 0 END)::BIGINT AS finished, sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END)::BIGINT AS done_n,
 sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed_n FROM download_status GROUP BY chain""",
)
def _(t: Tables):
    def of(*states: str):
        return F.sum(F.col("status").isin(*states).cast("bigint"))

    return download_status(t).groupBy("chain").agg(rows().alias("total"), of("done", "skipped").alias("finished"), of("done").alias("done_n"), of("failed").alias("failed_n"))


@query(
    "rep4_catalog_index",
    """SELECT brochure_id, chain, row_number() OVER (ORDER BY chain, brochure_id) AS global_index, count(*) OVER () AS global_total,
 row_number() OVER (PARTITION BY chain ORDER BY brochure_id) AS chain_index, count(*) OVER (PARTITION BY chain) AS chain_total FROM brochures""",
)
def _(t: Tables):
    return catalog.ordered_index(t.brochures.select("chain", "brochure_id"), "chain", "brochure_id")


@query("rep5_import_status", "SELECT status, count(*) AS n FROM download_status GROUP BY status")
def _(t: Tables):
    return download_status(t).groupBy("status").agg(rows().alias("n"))


# --- search quality --------------------------------------------------------------------------------------------------------

VIEWS["hit_counts"] = """
SELECT query, sum(CASE WHEN event_id % 2 = 0 THEN result_count % 4 ELSE 0 END)::BIGINT AS ours, sum(CASE WHEN event_id % 2 = 1 AND query NOT LIKE '%7' THEN result_count % 3 ELSE 0 END)::BIGINT AS theirs
FROM search_log GROUP BY query"""


def hit_counts(t: Tables):
    """Hits of two systems per term, taken from alternating entries of the log."""
    even, hits = F.col("event_id") % 2 == 0, F.col("result_count")
    return t.search_log.groupBy("query").agg(
        F.sum(F.when(even, hits % 4).otherwise(0)).alias("ours"), F.sum(F.when(~even & ~F.col("query").like("%7"), hits % 3).otherwise(0)).alias("theirs")
    )


@query(
    "qlt1_quality_buckets",
    f"""SELECT count(*) AS terms, sum(CASE WHEN ours = 0 THEN 1 ELSE 0 END)::BIGINT AS zero, sum(CASE WHEN ours BETWEEN 1 AND 2 THEN 1 ELSE 0 END)::BIGINT AS low,
 sum(CASE WHEN ours >= 3 THEN 1 ELSE 0 END)::BIGINT AS good, sum(CASE WHEN ours > 0 AND theirs = 0 THEN 1 ELSE 0 END)::BIGINT AS our_wins,
 sum(CASE WHEN theirs > 0 AND ours = 0 THEN 1 ELSE 0 END)::BIGINT AS their_wins, floor(sum(CASE WHEN ours > 0 THEN 1 ELSE 0 END) * 100 / count(*))::BIGINT AS success,
 {round_to_sql('avg(CASE WHEN ours > 0 AND theirs > 0 THEN ours END)', 1)} AS our_mean, {round_to_sql('avg(CASE WHEN ours > 0 AND theirs > 0 THEN theirs END)', 1)} AS their_mean FROM hit_counts""",
)
def _(t: Tables):
    ours, theirs = F.col("ours"), F.col("theirs")

    def n(cond):
        return F.sum(cond.cast("bigint"))

    both = (ours > 0) & (theirs > 0)
    return hit_counts(t).agg(
        rows().alias("terms"), n(ours == 0).alias("zero"), n(ours.between(1, 2)).alias("low"), n(ours >= 3).alias("good"), n((ours > 0) & (theirs == 0)).alias("our_wins"),
        n((theirs > 0) & (ours == 0)).alias("their_wins"), F.floor(n(ours > 0) * 100 / rows()).alias("success"),
        round_to(F.avg(F.when(both, ours)), 1).alias("our_mean"), round_to(F.avg(F.when(both, theirs)), 1).alias("their_mean"),
    )


@query("qlt2_baseline_regression", "SELECT query, ours, theirs, ours - theirs AS diff, CASE WHEN ours < theirs THEN 1 ELSE 0 END AS lost FROM hit_counts")
def _(t: Tables):
    return hit_counts(t).withColumn("diff", F.col("ours") - F.col("theirs")).withColumn("lost", (F.col("diff") < 0).cast("int"))


@query(
    "qlt3_latency_summary",
    f"""SELECT event_type, count(*) AS n, {round_to_sql('avg(value)', 4)} AS mean_ms, min(value) AS min_ms, max(value) AS max_ms,
 quantile_disc(value, 0.5) AS median_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY event_type""",
)
def _(t: Tables):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return t.read("events").groupBy("event_type").agg(
        rows().alias("n"), round_to(F.avg("value"), 4).alias("mean_ms"), F.min("value").alias("min_ms"), F.max("value").alias("max_ms"),
        disc(0.5).alias("median_ms"), disc(0.95).alias("p95_ms"),
    )


@query(
    "qlt4_missing_chains",
    """SELECT chain, count(*) AS terms FROM (SELECT DISTINCT category_id, chain FROM price_history EXCEPT
SELECT DISTINCT p_type || '/' || p_brand, chain FROM (SELECT split_part(category_id, '/', 1) AS p_type, split_part(category_id, '/', 2) AS p_brand, chain FROM offers WHERE sales_price < 2)) GROUP BY chain""",
)
def _(t: Tables):
    """Chains that the price history knows for a term and the cheap offers do not, counted over terms."""
    group = F.substring_index("category_id", "/", 2)
    ours = t.offers.where("sales_price < 2").select(group.alias("category_id"), "chain").distinct()
    return t.price_history.select("category_id", "chain").distinct().join(ours, ["category_id", "chain"], "left_anti").groupBy("chain").agg(rows().alias("terms"))
