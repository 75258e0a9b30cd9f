"""Brochure folders: reading, flattening, prices, page manifest, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.numbers import round_to
from offerloom.functions.text import compact_text, lenient_decimal

METADATA_SCHEMA = (
    "content struct<id string, legacyId bigint, title string, type string, pageCount int, publisher struct<id string, name string>, validFrom string, validUntil string>"
)
_PRODUCT = "struct<name string, brandName string, description array<struct<paragraph string>>, categoryPaths array<struct<name string>>>"
_DEAL = "struct<type string, min string, currencyCode string, priceByBaseUnit string>"
_CORNER = "struct<x double, y double>"
_CONTENT = (
    f"struct<id string, type string, image string, deals array<{_DEAL}>, discountLabel struct<type string, value string>, products array<{_PRODUCT}>, "
    f"parentContent struct<page struct<area struct<topLeft {_CORNER}, bottomRight {_CORNER}>>>>"
)
PAGES_SCHEMA = (
    "contents array<struct<number int, images array<struct<size string, url string>>, linkOuts array<string>, "
    f"offers array<struct<placement string, adFormat string, content {_CONTENT}>>>>"
)

# Brochures in a packed file: a few MB.
BROCHURES_PER_FILE = 20_000


def read_brochures(spark: SparkSession, root: str) -> DataFrame:
    """(chain_key, folder, content, contents) of every chain/brochure folder that has both files."""
    parts = r"([^/]+)/([^/]+)/[^/]+\.json$"
    path = F.col("_metadata.file_path")
    place = [F.regexp_extract(path, parts, 1).alias("chain_key"), F.regexp_extract(path, parts, 2).alias("folder")]

    def read(name: str, schema: str) -> DataFrame:
        files = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/*/{name}.json")
        return files.select(*place, "*")

    return read("metadata", METADATA_SCHEMA).join(read("pages", PAGES_SCHEMA), ["chain_key", "folder"])


def write_folders(brochures: DataFrame, root: str, metadata: Column | None = None, pages_of: Column | None = None) -> None:
    """Brochures (chain_key, folder, content, contents) as packed JSON lines below ``root``, metadata and pages apart, by chain.

    The conditions choose which brochures get either of the two. A packed file is read by one task, so that its lines are bounded.
    """
    for name, column, chosen in (("metadata", "content", metadata), ("pages", "contents", pages_of)):
        rows = brochures if chosen is None else brochures.where(chosen)
        rows.select("chain_key", "folder", column).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", BROCHURES_PER_FILE).partitionBy("chain_key").json(f"{root}/{name}")


def read_folders(spark: SparkSession, root: str, pages: dict[str, Column] | None = None) -> DataFrame:
    """What ``write_folders`` wrote: (chain_key, folder, content, contents) of the brochures that have both.

    ``pages``, where given, are the columns wanted instead of ``contents``; they are made as pages are read, so that nothing else of them is shuffled.
    """
    def read(name: str, schema: str) -> DataFrame:
        return spark.read.schema(f"chain_key string, folder string, {schema}").option("basePath", f"{root}/{name}").json(f"{root}/{name}")

    found = read("pages", PAGES_SCHEMA)
    if pages is not None:
        found = found.select("chain_key", "folder", *[c.alias(name) for name, c in pages.items()])
    return read("metadata", METADATA_SCHEMA).join(found, ["chain_key", "folder"])


def brochure_dimension(brochures: DataFrame, order: str) -> DataFrame:
    """One row per brochure id with its title, publisher, validity, type and number of pages; the first by ``order`` wins."""
    rows = brochures.where("content.id IS NOT NULL").select(
        F.col("content.id").alias("brochure_id"), order, "chain_key", compact_text(F.col("content.title")).alias("title"), F.col("content.publisher.name").alias("publisher_name"),
        F.substring("content.validFrom", 1, 10).alias("valid_from"), F.substring("content.validUntil", 1, 10).alias("valid_until"),
        F.col("content.type").alias("brochure_type"), F.coalesce("content.pageCount", F.size("contents")).alias("page_count"),
    )
    rest = [c for c in rows.columns if c != "brochure_id"]
    first = rows.groupBy("brochure_id").agg(F.min_by(F.struct(*rest), order).alias("b"))
    return first.select("brochure_id", *[f"b.{c}" for c in rest if c != order])


def deal_values(deals: Column) -> Column:
    """First sale price, regular price, currency and non-empty base price of a list of deals, with the discount."""

    def first(kind: str) -> Column:
        known = F.filter(deals, lambda d: (F.upper(d["type"]) == kind) & lenient_decimal(d["min"]).isNotNull())
        return lenient_decimal(F.get(known, F.lit(0))["min"])

    sales, regular = first("SALES_PRICE"), first("REGULAR_PRICE")
    currency = F.get(F.filter(deals, lambda d: d["currencyCode"].isNotNull()), F.lit(0))["currencyCode"]
    base = F.get(F.filter(deals, lambda d: F.coalesce(d["priceByBaseUnit"], F.lit("")) != ""), F.lit(0))["priceByBaseUnit"]
    amount = F.when(regular > sales, round_to(regular - sales, 2))
    return F.struct(
        sales.alias("sales_price"), regular.alias("regular_price"), amount.alias("discount_amount"),
        round_to(amount / regular * 100, 2).alias("discount_percent"), currency.alias("currency_code"), compact_text(base).alias("base_price_text"),
    )


def pages(brochures: DataFrame) -> DataFrame:
    return brochures.select("chain_key", F.col("content.id").alias("brochure_id"), F.col("content").alias("head"), F.explode("contents").alias("page"))


def flatten_offers(brochures: DataFrame) -> DataFrame:
    """One row per printed offer."""
    each = pages(brochures).select("chain_key", "brochure_id", "head", (F.col("page.number") + 1).alias("page_number"), F.explode("page.offers").alias("offer"))
    product = F.get(F.col("offer.content.products"), F.lit(0))
    paragraphs = F.filter(F.transform(product["description"], lambda d: compact_text(d["paragraph"])), lambda p: p != "")
    names = F.filter(F.transform(product["categoryPaths"], lambda c: compact_text(c["name"])), lambda n: n != "")
    category_names = F.coalesce(names, F.array().cast("array<string>"))
    area = F.col("offer.content.parentContent.page.area")
    rows = each.select(
        "chain_key", "brochure_id", F.col("head.legacyId").alias("legacy_id"), compact_text(F.col("head.title")).alias("title"), F.col("head.publisher.name").alias("publisher_name"), F.substring("head.validFrom", 1, 10).alias("valid_from"),
        F.substring("head.validUntil", 1, 10).alias("valid_until"), "page_number", F.col("offer.content.id").alias("offer_content_id"), F.col("offer.content.type").alias("offer_type"), "offer.placement",
        F.col("offer.adFormat").alias("ad_format"), category_names.alias("category_names"), F.col("offer.content.discountLabel.type").alias("discount_label_type"),
        lenient_decimal(F.col("offer.content.discountLabel.value")).alias("discount_label_value"), F.col("offer.content.image").alias("offer_image_url"),
        F.struct(area["topLeft"]["x"].alias("left"), area["topLeft"]["y"].alias("top"), area["bottomRight"]["x"].alias("right"), area["bottomRight"]["y"].alias("bottom")).alias("bbox"),
        F.col("offer.content.deals").alias("raw_deals"),
        compact_text(product["name"]).alias("product_name"), compact_text(product["brandName"]).alias("brand_name"),
        F.coalesce(F.array_join(paragraphs, " "), F.lit("")).alias("description_text"), deal_values(F.col("offer.content.deals")).alias("d"),
    )
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("brand_name", "product_name", "description_text")]
    return rows.select(*[c for c in rows.columns if c != "d"], "d.*", F.concat_ws(" ", *filled).alias("search_text"))


def image_area(size: Column) -> Column:
    width = F.regexp_extract(size, r"^\s*(\d+)x(\d+)\s*$", 1).try_cast("bigint")
    height = F.regexp_extract(size, r"^\s*(\d+)x(\d+)\s*$", 2).try_cast("bigint")
    return F.coalesce(width * height, F.lit(0).cast("bigint"))


def largest_image(images: Column) -> Column:
    """URL of the image with the largest area, the first of equals."""
    ranked = F.transform(images, lambda im, i: F.struct(image_area(im["size"]).alias("area"), (-i).alias("place"), im["url"].alias("url")))
    return F.array_max(ranked)["url"]


def page_manifest(brochures: DataFrame) -> DataFrame:
    """One row per page with its numbers of offers and links and its largest image."""
    return pages(brochures).select(
        "chain_key", "brochure_id", (F.col("page.number") + 1).alias("page_number"), F.size("page.offers").alias("offers"), F.size("page.linkOuts").alias("links"),
        largest_image(F.col("page.images")).alias("image_url"),
    )


def write_dataset(offers: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Write both tables as JSON lines and return the summary of what was written."""
    offers.write.mode("overwrite").json(f"{folder}/offers")
    manifest.write.mode("overwrite").json(f"{folder}/pages")
    return dataset_summary(offers, manifest)


def dataset_summary(offers: DataFrame, manifest: DataFrame) -> DataFrame:
    per_page = manifest.groupBy("chain_key").agg(F.count(F.lit(1)).alias("pages"))
    per_offer = offers.groupBy("chain_key").agg(F.count(F.lit(1)).alias("offers"), F.count("sales_price").alias("priced"))
    return per_page.join(per_offer, "chain_key", "left").na.fill(0)
