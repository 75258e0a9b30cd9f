"""A sample of the registered queries against their SQL on the smallest data folder."""

import os

import duckdb
import pytest

from offerloom.plans import all_queries
from offerloom.plans.views import BASE

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "bld1_offer_dedup", "bld6_build_metrics", "jn8_radius_join", "geo10_scope_category_counts", "bsk2_best_by_category", "bsk7_store_ranking", "mix1_cheapest_split",
    "tax3_siblings", "log2_never_clicked", "agg4_price_direction", "txt3_bm25", "cat9_diversity", "src12_merged_pages", "bld20_regrouped_tree", "str2_daily_prices",
    "txt7_typo_search", "txt10_typo_test", "txt3_bm25_top", "cat13_local_counts", "tax3_local_siblings", "tax7_category_offers", "tax7_page_heads", "txt17_pages", "log8_ranking_export",
    "bsk0_basket_lines", "bsk0_rejected_items", "src1_brochure_folders", "src2_offer_details", "src15_mapped_sources", "str3_store_upsert", "str4_streaming_dedup", "bld4_brochure_details",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    registry = all_queries()
    df = registry.QUERIES[name](spark, FOLDER)
    cur = db.execute(registry.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=repr)
    want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    assert got == want and got


def test_split_never_costs_more_than_a_store_with_the_same_lines(spark):
    """By price alone; unit prices may prefer dearer packs, so they are taken away."""
    from pyspark.sql import functions as F

    from offerloom.operators import basket
    from offerloom.plans import baskets
    from offerloom.plans.views import Tables

    tables = Tables(spark, FOLDER)
    priced = baskets.priced(tables).withColumns({"unit_group": F.lit(None).cast("string"), "ppn": F.lit(None).cast("double")})
    reach = baskets.rounded_reach(tables)
    split = basket.split_totals(basket.cheapest_split(priced, reach))
    stores = basket.store_rows(basket.chain_totals(priced, baskets.lines(tables)), reach)
    both = split.join(stores, "basket_id").where("mix_lines = offers")
    assert both.count() > 0 and both.where("mix_total > total + 0.005").count() == 0


def test_names_are_unique_and_checked():
    registry = all_queries()
    assert len(registry.QUERIES) > 150
    assert set(registry.ORACLES) <= set(registry.QUERIES)
