"""Upsert by buckets, dedup until expiry, raw baskets and the entry module without the optional folders."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from offerloom.operators import basket
from offerloom.sources import stores
from offerloom.streaming.buckets import BucketTable, upsert_stream
from offerloom.streaming.expiry import rocks_state, valid_offers
from offerloom.streaming.logs import run_to_table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    rows = [(i, f"v{i}", 1) for i in range(200)]
    schema = spark.createDataFrame(rows, "id long, name string, version int").schema
    table = BucketTable(str(tmp_path / "t"), schema, ("id",), "version", 16)
    table.create(spark)
    table.merge(spark.createDataFrame(rows, schema), 0)
    before = table.manifest(spark)
    table.merge(spark.createDataFrame([(5, "new", 2), (6, "old", 0), (999, "more", 1)], schema), 1)
    after = table.manifest(spark)
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(before) == 16 and 1 <= len(changed) <= 3
    want = {i: n for i, n, _ in rows} | {5: "new", 999: "more"}
    assert {r.id: r.name for r in table.read(spark).collect()} == want
    # the batch again, as after a failure, and the table as it was before it
    table.merge(spark.createDataFrame([(5, "new", 2), (6, "old", 0), (999, "more", 1)], schema), 1)
    assert {r.id: r.name for r in table.read(spark).collect()} == want and table.manifest(spark) == after
    assert {r.id: r.name for r in table.read(spark, before=1).collect()} == {i: n for i, n, _ in rows}


def test_upsert_stream_keeps_the_newest_of_all_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(i, f"b{n}", 10 * n + i) for i in range(n, 6)], "id int, name string, version int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id int, name string, version int").option("maxFilesPerTrigger", 1).parquet(source)
    state = upsert_stream(stream, str(tmp_path / "out"), ["id"], "version", 4)
    assert {r.id: r.name for r in state.collect()} == {0: "b0", 1: "b1", 2: "b2", 3: "b2", 4: "b2", 5: "b2"}
    empty = spark.readStream.schema("id int, name string, version int").parquet(source).where("id < 0")
    assert upsert_stream(empty, str(tmp_path / "none"), ["id"], "version").count() == 0


def test_a_key_comes_back_after_its_offer_has_expired(spark, tmp_path):
    source = str(tmp_path / "offers")
    days = [
        [("a", "2024-01-01", "2024-01-10"), ("a", "2024-01-05", "2024-01-20"), ("b", "2024-01-02", "2024-03-01")],
        [("a", "2024-01-08", "2024-01-12"), ("a", "2024-01-11", "2024-01-15"), ("b", "2024-01-30", "2024-02-02")],
        [("a", "2024-02-01", "2024-02-03"), ("b", "2024-02-15", "2024-04-01"), ("c", "2024-02-01", "2024-02-01")],
        [("b", "2024-03-02", "2024-03-05"), ("c", "2024-02-20", "2024-02-21"), ("c", "2024-02-20", "2024-02-21")],
    ]
    for part in days:
        rows = spark.createDataFrame(part, "k string, s string, e string").select("k", F.to_timestamp("s").alias("s"), F.to_timestamp("e").alias("e"))
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, s timestamp, e timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    with rocks_state(spark):
        out = run_to_table(valid_offers(stream, ["k"], "s", "e", "30 days"), str(tmp_path / "out"))
    got = sorted((r.k, str(r.day)) for r in out.select("k", F.to_date(F.timestamp_seconds("start_s")).alias("day")).collect())
    assert got == [("a", "2024-01-01"), ("a", "2024-01-11"), ("a", "2024-02-01"), ("b", "2024-01-02"), ("b", "2024-03-02"), ("c", "2024-02-01"), ("c", "2024-02-20")]


def test_raw_baskets_give_lines_or_reasons(spark):
    payloads = [
        (1, '[{"q": " milk ", "brand": " ", "any_brand": false}, {"category_id": 7, "q": null}, {"category_id": "x/y", "brand": "B", "any_brand": false}]'),
        (2, '[1, "a", null, [2], {}, {"q": ""}, {"category_id": ""}, {"category_id": 1.5}, {"category_id": [1]}, {"q": 5}]'), (3, "{"), (4, None), (5, "{}"), (6, "[]"),
    ]
    rows = basket.parse_baskets(spark.createDataFrame(payloads, "basket_id int, payload string")).collect()
    lines = {(r.basket_id, r.pos): (r.q, r.brand, r.any_brand, r.category_id) for r in rows if r.reason is None}
    assert lines == {(1, 0): ("milk", None, True, None), (1, 1): ("", None, True, "7"), (1, 2): ("", "B", False, "x/y"), (2, 9): ("5", None, True, None)}
    reasons = {(r.basket_id, r.pos): r.reason for r in rows if r.reason}
    assert reasons == {(2, i): basket.NO_OBJECT for i in range(4)} | {(2, 4): basket.EMPTY, (2, 5): basket.EMPTY} | {(2, i): basket.BAD_ID for i in (6, 7, 8)} | {
        (3, None): basket.NOT_JSON, (4, None): basket.NOT_JSON, (5, None): basket.NO_LIST,
    }


def test_sources_with_odd_records(spark):
    records = ['{"id": 1, "lat": 50.1, "lng": 8, "city": "Bonn"}', '{"id": 2, "lat": 0, "lng": 8}', '{"lat": "x", "lng": 1}', "no json", None, '{"identifier": "z", "lat": "50,1", "lng": 8}']
    rows = stores.map_source(spark.createDataFrame([(r,) for r in records], "record string"), "aldi").collect()
    assert [(r.store_id, r.name, r.lat, r.lon) for r in rows] == [("1", "Aldi Bonn", 50.1, 8.0)]


def test_the_rest_registers_without_the_optional_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "offerloom"), copy / "offerloom", ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy)
    code = "import __spark_entry__ as e; names = e.queries(); assert len(names) > 150 and 'pipeline' not in names and set(e.oracle_sql()) <= set(names)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
