"""Brochure folders are written packed, and pages are cut down to what is asked before they meet their metadata."""

from pyspark.sql import functions as F

from offerloom.sources import brochures as br

CONTENT = "struct<id string, legacyId bigint, title string, type string, pageCount int, publisher struct<id string, name string>, validFrom string, validUntil string>"


def written(spark, root):
    head = F.from_json(F.concat(F.lit('{"id": "'), "folder", F.lit('", "title": "Angebote", "pageCount": 2}')), CONTENT)
    page = F.lit('{"number": 0, "images": [{"size": "1x1", "url": "u"}], "linkOuts": ["' + "link " * 200 + '"], "offers": []}')
    contents = F.from_json(F.concat(F.lit("["), page, F.lit(","), page, F.lit("]")), br.PAGES_SCHEMA.removeprefix("contents "))
    rows = spark.range(60).select(F.concat(F.lit("chain"), (F.col("id") % 3).cast("string")).alias("chain_key"), F.col("id").cast("string").alias("folder"))
    number = F.col("folder").cast("long")
    br.write_folders(rows.withColumns({"content": head, "contents": contents}), str(root), number % 7 != 0, number % 11 != 0)
    return {str(i) for i in range(60) if i % 7 and i % 11}


def test_folders_are_packed_and_hold_everything(spark, tmp_path):
    want = written(spark, tmp_path)
    files = [p for p in tmp_path.rglob("*") if p.is_file() and "part-" in p.name and not p.name.endswith(".crc")]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    found = br.read_folders(spark, str(tmp_path)).collect()
    assert {r.folder for r in found} == want and len(found) == len(want)
    assert all(len(r.contents) == 2 and r.contents[1].linkOuts == ["link " * 200] and r.content.id == r.folder for r in found)


def test_wanted_columns_are_made_before_the_join(spark, tmp_path):
    want = written(spark, tmp_path)
    found = br.read_folders(spark, str(tmp_path), {"pages": F.size("contents")})
    assert {(r.folder, r.content.id, r.pages) for r in found.collect()} == {(f, f, 2) for f in want} and found.columns == ["chain_key", "folder", "content", "pages"]
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "size(contents" in joined and joined.index("Join") < joined.index("size(contents")
