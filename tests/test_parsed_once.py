"""Embedded data of pages is searched and parsed once a page, and typed baskets and search logs are read once."""

import pytest
from pyspark.sql import functions as F

from offerloom.operators import search
from offerloom.plans import all_queries, streams
from offerloom.sources import pages

SMALL = "/root/testdata/sf0.001"


def test_pages_are_parsed_once(spark):
    for name in ("src9_embedded_json", "src11_truncated_pages", "src10_page_offers"):
        plan = all_queries().QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, name
        assert plan.count("__NEXT_DATA__\"[^>]*>") == 1, name


def test_counting_reads_odd_items_as_parsing_does(spark):
    block = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"pageInformation":{"offers":{"main":{"items":%s,"totalItems":%s}}}}}}</script>'
    lists = [("[]", "0"), ('[{"id":"a"},{"title":"b"}]', "7"), ('[1,null,"x",{"id":{"y":1},"prices":"none"}]', "2"), ('[{"id":"a"}', "1"), ("null", "null"), ("[{}]", "NaN"), ('[{"id":{"y":1},"prices":"none"},{"prices":{"mainPrice":"x"}}]', "1")]
    rows = [(i, block % x) for i, x in enumerate(lists)] + [(10, "<html></html>"), (11, None), (12, '<script id="__NEXT_DATA__">[1]</script>')]
    html = spark.createDataFrame(rows, "page_id long, html string")
    found = F.col("data").isNotNull().alias("found")
    full, slim = (sorted(map(tuple, pages.truncation(p, found).collect())) for p in (pages.parse_pages(html), pages.parse_pages(html, pages.COUNTED_ITEM)))
    assert full == slim
    assert {r[0]: r[1:4] for r in slim} == {
        0: (True, 0, 0), 1: (True, 2, 7), 2: (True, 0, 2), 3: (False, 0, 0), 4: (True, 0, 0), 5: (False, 0, 0), 6: (True, 2, 2), 10: (False, 0, 0), 11: (False, 0, 0), 12: (True, 0, 0),
    }


def asked_plan(spark, monkeypatch, name):
    """Plan of the queries that a registered query hands to the category search."""
    class Seen(Exception):
        pass

    plans = []

    def see(queries, *rest):
        plans.append(queries._jdf.queryExecution().optimizedPlan().toString())
        raise Seen

    monkeypatch.setattr(streams.cat, "suggest", see)
    with pytest.raises(Seen):
        all_queries().QUERIES[name](spark, SMALL)
    return plans[0]


def test_the_category_search_does_not_read_baskets_and_logs_again(spark, monkeypatch):
    assert "collect_list" not in asked_plan(spark, monkeypatch, "bsk12_text_to_lines")
    assert "get_json_object" not in asked_plan(spark, monkeypatch, "log8_ranking_export")


def test_a_search_reads_its_index_once(spark):
    rows = [("milk", 1), ("whole", 1), ("milky", 2), ("whole", 2), ("bread", 3), ("milk", None)]
    index = spark.createDataFrame(rows, "token string, doc long").where("token <> 'marker'")
    found = search.prefix_search(spark.createDataFrame([("whole milk",), ("bread",), ("whole bread",)], "q string"), index, "doc")
    assert {(r.q, r.doc) for r in found.collect()} == {("whole milk", 1), ("whole milk", 2), ("bread", 3)}
    assert "marker" not in found._jdf.queryExecution().optimizedPlan().toString()
