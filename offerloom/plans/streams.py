"""Streaming queries, and the reports that combine several steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.functions.numbers import round_to, round_to_sql
from offerloom.functions.text import normalize_search_text
from offerloom.operators import categories as cat
from offerloom.operators import scoring, search
from offerloom.plans.places import places_by
from offerloom.plans.registry import query
from offerloom.plans.reports import category_counts
from offerloom.plans.texts import offer_texts, phrases
from offerloom.plans.views import VIEWS, Tables
from offerloom.session import cut_lineage, shared_folder
from offerloom.streaming import logs
from offerloom.streaming.buckets import upsert_stream
from offerloom.streaming.expiry import rocks_state, valid_offers


def stream_of(t: Tables, name: str) -> DataFrame:
    """A table's file as a stream; times become instants, as watermarks need."""
    schema = t.read(name).schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name[:-1]}[{name[-1]}].parquet")
    times = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in times})


@query(
    "str1_popular_windows",
    """SELECT epoch(s)::BIGINT AS start_s, category_id, count(*) AS clicks FROM (SELECT k AS category_id, date_trunc('day', ts) - to_days(i::INT) AS s
 FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'click'), (SELECT unnest(range(30)) AS i))
WHERE s + INTERVAL 30 DAY <= (SELECT max(ts) FROM events WHERE event_type = 'click') - INTERVAL 1 HOUR GROUP BY ALL""",
)
def _(t: Tables):
    clicks = stream_of(t, "events").where("event_type = 'click'").select("ts", F.get_json_object("props", "$.k").cast("bigint").alias("category_id"))
    out = logs.run_to_table(logs.popular_windows(clicks), shared_folder(t.spark, "popular"))
    return out.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start_s"), "category_id", "clicks")


@query(
    "str2_daily_prices",
    f"""SELECT epoch(ts::DATE)::BIGINT AS day_s, category_id, {round_to_sql('avg(price)', 2)} AS avg_price, min(price) AS min_price, max(price) AS max_price, count(*) AS samples
FROM price_history WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM price_history) - INTERVAL 1 DAY GROUP BY ts::DATE, category_id""",
)
def _(t: Tables):
    part = t.read("part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("category_id"))
    line = stream_of(t, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    samples = line.select(F.col("l_shipdate").alias("ts"), "category_id", round_to(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"))
    out = logs.run_to_table(logs.daily_prices(samples), shared_folder(t.spark, "prices"))
    day = F.unix_seconds(F.col("day").cast("timestamp")).alias("day_s")
    return out.select(day, "category_id", round_to(F.col("avg_price"), 2).alias("avg_price"), "min_price", "max_price", "samples")


@query(
    "str3_store_upsert",
    "SELECT o_custkey AS store_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate)::DATE AS seen FROM orders GROUP BY o_custkey",
)
def _(t: Tables):
    """Newest state of every store out of a stream of reports."""
    reports = stream_of(t, "orders").select(
        F.col("o_custkey").alias("store_id"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("version"),
    )
    state = upsert_stream(reports, shared_folder(t.spark, "stores"), ["store_id"], "version")
    return state.select("store_id", "status", F.to_date("version.o_orderdate").alias("seen"))


@query("str4_streaming_dedup", "SELECT DISTINCT chain, product_name, brand, valid_year FROM (SELECT *, year(valid_from) AS valid_year FROM raw_offers)")
def _(t: Tables):
    """An offer is passed on until its year ends, and again in a later year."""
    part = t.read("part").select("p_partkey", F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"))
    line = stream_of(t, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    year = F.year("l_shipdate")
    offers = line.select(
        F.concat(F.lit("Chain#"), (F.col("l_suppkey") % 10).cast("string")).alias("chain"), "product_name", "brand",
        F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("starts"), F.make_timestamp(year, F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59)).alias("ends"),
    )
    key = ["chain", "product_name", "brand"]
    with rocks_state(t.spark):
        passed = logs.run_to_table(valid_offers(offers, key, "starts", "ends"), shared_folder(t.spark, "offers"))
    return passed.select(*key, F.year(F.timestamp_seconds("start_s")).cast("bigint").alias("valid_year"))


VIEWS["phrase_log"] = """
SELECT p_name AS query, CASE WHEN s.selected_category_id IS NOT NULL THEN p_type || '/' || p_brand || '/' || p_name END AS selected
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e JOIN search_log s ON s.event_id = e.event_id JOIN part ON p_partkey = k"""


@query(
    "log8_ranking_export",
    """WITH asked AS (SELECT query, count(*) AS searches FROM phrase_log WHERE length(query) >= 2 GROUP BY query HAVING count(*) >= 3),
clicked AS (SELECT query, selected, count(*) AS clicks FROM phrase_log WHERE selected IS NOT NULL GROUP BY ALL)
SELECT r.q AS query, r.category_id, r.rank - 1 AS rank, CASE WHEN c.clicks IS NULL THEN 0 ELSE 1 END AS clicked, coalesce(c.clicks, 0) AS click_count, r.n::BIGINT AS offer_count, a.searches
FROM asked a JOIN ranked_cats r ON r.q = a.query LEFT JOIN clicked c ON c.query = r.q AND c.selected = r.category_id""",
)
def _(t: Tables):
    """Ranked categories of every query searched three times or more, with the clicks on them and their offers."""
    key = F.get_json_object("props", "$.k").cast("bigint")
    part = t.read("part").select("p_partkey", F.col("p_name").alias("query"), F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"))
    clicks = t.search_log.select("event_id", F.col("selected_category_id").isNotNull().alias("clicked"))
    log = t.read("events").select("event_id", key.alias("p_partkey")).join(part, "p_partkey").join(clicks, "event_id")
    log = cut_lineage(logs.counted(log.select("query", F.when(F.col("clicked"), F.col("path")).alias("selected"))))
    asked = cut_lineage(logs.frequent_queries(log, 3))
    ranked = cat.rank_categories(
        cat.suggest(asked.select(F.col("query").alias("q")), t.search_labels, t.product_labels, t.categories), t.categories, category_counts(t)
    )
    return logs.ranking_examples(ranked, asked, log)


@query("geo4_place_resolution")
def _(t: Tables):
    """Typed place names to places: equal names first, else the best fuzzy match of at least 72."""
    places = places_by(t, "city").select("city", "stores", "chains", normalize_search_text(F.col("city")).alias("norm"))
    named = t.read("nation").select(F.explode(F.array(F.col("n_name"), F.lower("n_name"), F.regexp_replace("n_name", "NATION", "NATON"))).alias("q")).distinct()
    asked = named.withColumn("norm", normalize_search_text(F.col("q")))
    order = F.struct("chains", "stores", -F.length("city"), "city")
    exact = asked.join(places, "norm").groupBy("q").agg(F.max_by("city", order).alias("city")).withColumn("score", F.lit(100.0))
    rest = asked.join(exact, "q", "left_anti")
    pairs = scoring.candidate_pairs(rest.select("q"), places.select(F.col("city").alias("text")))
    scored = scoring.score_pairs(pairs).join(places.withColumnRenamed("city", "text"), "text").join(rest.withColumnRenamed("norm", "qn"), "q")
    bonus = F.when(F.startswith("norm", F.col("qn")), 8.0).when(F.contains("norm", F.col("qn")), 4.0).otherwise(0.0)
    near = scored.withColumn("score", F.col("score") + bonus).where("score >= 72")
    best = near.groupBy("q").agg(F.max_by(F.struct(F.col("text").alias("city"), "score"), F.struct("score", "chains", "stores", -F.length("text"), "text")).alias("b"))
    return exact.unionByName(best.select("q", "b.city", "b.score"))


@query(
    "txt9_substring_test",
    "SELECT q, text FROM phrases JOIN (SELECT DISTINCT brand || ' ' || product_name AS text FROM offers) ON contains(lower(text), lower(q))",
)
def _(t: Tables):
    low = offer_texts(t).select("text", F.lower("text").alias("word"))
    asked = phrases(t).select("q", F.lower("q").alias("needle"))
    return scoring.containing_words(asked, low.select("word").distinct()).join(low, "word").select("q", "text")


@query(
    "txt14_query_categories",
    """SELECT DISTINCT h.q, x.descendant_id AS category_id FROM (SELECT q, category_id FROM (SELECT DISTINCT f.q, f.n_tokens, f.token_no, c.category_id FROM phrase_forms f
 JOIN (SELECT category_id, unnest(string_split(replace(lower(name), '#', ' '), ' ')) AS token FROM categories) c ON starts_with(c.token, f.form)) GROUP BY q, category_id HAVING count(*) = max(n_tokens)) h
JOIN closure x ON x.ancestor_id = h.category_id""",
)
def _(t: Tables):
    from offerloom.operators.taxonomy import closure

    named = search.postings(t.categories, "category_id", {"name": F.col("name")})
    found = search.prefix_search(phrases(t), named, "category_id").withColumnRenamed("category_id", "ancestor_id")
    return found.join(closure(t.categories), "ancestor_id").select("q", F.col("descendant_id").alias("category_id")).distinct()


@query(
    "jn10_fuzzy_blocking",
    """SELECT q, count(*) AS candidates FROM (SELECT DISTINCT f.q, d.text FROM (SELECT q, form FROM phrase_forms WHERE length(token) >= 3) f
 JOIN (SELECT DISTINCT brand || ' ' || product_name AS text FROM offers) d ON contains(lower(d.text), f.form)) GROUP BY q""".replace(
        "SELECT q, form FROM phrase_forms WHERE length(token) >= 3",
        "SELECT f.q, f.form FROM phrase_forms f JOIN (SELECT q, unnest(range(len(tk))) AS token_no, unnest(tk) AS token FROM (SELECT q, string_split(replace(lower(q), '#', ' '), ' ') AS tk FROM phrases)) k "
        "ON k.q = f.q AND k.token_no = f.token_no WHERE length(k.token) >= 3",
    ),
)
def _(t: Tables):
    return scoring.candidate_pairs(phrases(t), offer_texts(t)).groupBy("q").agg(F.count(F.lit(1)).alias("candidates"))


@query(
    "bsk12_text_to_lines",
    """SELECT l.basket_id, l.pos, l.segment, r.category_id FROM (SELECT basket_id, pos, segment FROM (SELECT basket_id, unnest(range(len(w))) AS pos, trim(unnest(w)) AS segment FROM (
 SELECT basket_id, string_split(string_agg(q, ', ' ORDER BY item_no), ',') AS w FROM basket_lines GROUP BY basket_id))) l LEFT JOIN ranked_cats r ON r.q = l.segment AND r.rank = 1""",
)
def _(t: Tables):
    """Baskets typed as one text: each part becomes a category line where a category answers it, else a text line."""
    # the parts of a text are those of its lines, since a comma stands between them; so the distinct ones need no baskets
    wishes = t.basket_lines.select("q").distinct().select(F.explode(F.split("q", ",")).alias("q")).select(F.trim("q").alias("q"))
    asked = cut_lineage(wishes.where("q <> ''").distinct())
    typed = t.basket_lines.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "q"))).alias("l"))
    texts = typed.select("basket_id", F.array_join(F.transform("l", lambda x: x["q"]), ", ").alias("text"))
    parts = texts.select("basket_id", F.posexplode(F.split("text", ",")).alias("pos", "segment")).withColumn("segment", F.trim("segment")).where("segment <> ''")
    found = cat.suggest(asked, t.search_labels, t.product_labels, t.categories)
    first = cat.rank_categories(found, t.categories, category_counts(t)).where("rank = 1").select(F.col("q").alias("segment"), "category_id")
    return parts.join(first, "segment", "left").select("basket_id", F.col("pos").cast("bigint").alias("pos"), "segment", "category_id")
