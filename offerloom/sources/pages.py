"""Data embedded in crawled pages: offers, truncation, links, brochure discoveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.chains import canonical_chain, territory
from offerloom.operators.catalog import first_by, last_by

# Name of the embedded block and of the lists inside it.
BLOCK = r'(?s)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>'
BUCKETS = ["main", "topRanked", "otherPublishers"]
BONUS = r"(?iU)(\d+[.,]\d{1,2})\s*€\s*Bonus"

_ITEM = "struct<id string, title string, brand string, publisherName string, description string, prices struct<mainPrice double, secondaryPrice double, priceByBaseUnit string, description string>>"
# Enough of an item to count it.
COUNTED_ITEM = "struct<id string>"


def page_schema(item: str = _ITEM) -> str:
    lists = ", ".join(f"{b} struct<items array<{item}>, totalItems bigint>" for b in BUCKETS)
    return f"props struct<pageProps struct<pageInformation struct<offers struct<{lists}>>>>"


def embedded_json(html: Column) -> Column:
    """Text of the embedded block, null where there is none or it is not JSON."""
    # one element of an array, so that the block is searched once and not wherever its text is used
    text = F.array(F.regexp_extract(html, BLOCK, 1))
    return F.transform(text, lambda t: F.when((t != "") & F.get_json_object(t, "$").isNotNull(), t))[0]


def parse_pages(pages: DataFrame, item: str = _ITEM) -> DataFrame:
    """(page_id, data, offers) of (page_id, html): text and lists of the embedded block, null where there is none.

    Both are generated rows, which later filters and fields cannot be pushed through, so that a page is parsed once.
    """
    read = pages.select("page_id", F.explode(F.array(embedded_json(F.col("html")))).alias("data"))
    offers = F.from_json("data", page_schema(item))["props"]["pageProps"]["pageInformation"]["offers"]
    return read.select("page_id", "data", F.explode(F.array(offers)).alias("offers"))


def bonus_cents(*texts: Column) -> Column:
    """Bonus in cents out of the first text naming one."""
    found = [F.round(F.replace(F.regexp_extract(t, BONUS, 1), F.lit(","), F.lit(".")).try_cast("double") * 100).cast("bigint") for t in texts]
    return F.coalesce(*found)


def page_offers(parsed: DataFrame) -> DataFrame:
    """Offers of pages (page_id, offers): known chain, id and title only; prices must be positive."""
    bucket = [F.coalesce(F.col(f"offers.{b}.items"), F.array().cast(f"array<{_ITEM}>")) for b in BUCKETS]
    items = parsed.select("page_id", F.posexplode(F.concat(*bucket)).alias("place", "it"))
    price, was = F.col("it.prices.mainPrice"), F.col("it.prices.secondaryPrice")
    rows = items.select(
        "page_id", "place", canonical_chain(F.col("it.publisherName")).alias("chain"), territory(F.col("it.publisherName")).alias("territory"),
        F.trim("it.id").alias("item_id"), F.trim("it.title").alias("title"), F.when(price > 0, price).alias("price"), F.when(was > 0, was).alias("was_price"),
        F.col("it.prices.priceByBaseUnit").alias("base_price_text"), bonus_cents(F.col("it.prices.description"), F.col("it.description")).alias("bonus_cents"),
    )
    return rows.where("chain IS NOT NULL AND item_id <> '' AND title <> ''")


def truncation(parsed: DataFrame, *more: Column) -> DataFrame:
    """Listed and announced items per page, and the gap between them; ``more`` columns go along."""
    listed = [F.coalesce(F.array_size(F.col(f"offers.{b}.items")), F.lit(0)).cast("bigint") for b in BUCKETS]
    announced = [F.greatest(n, F.coalesce(F.col(f"offers.{b}.totalItems"), F.lit(0))) for n, b in zip(listed, BUCKETS)]
    embedded, total = sum(listed[1:], listed[0]), sum(announced[1:], announced[0])
    return parsed.select("page_id", *more, embedded.alias("embedded"), total.alias("total"), (total - embedded).alias("gap"))


def merge_pages(offers: DataFrame) -> DataFrame:
    """One offer per (chain, item): the one met last."""
    return last_by(offers, ["chain", "item_id"], [F.col("page_id"), F.col("place")])


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, link) of the internal links of a page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))).alias("link")).distinct()


def next_frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links not visited yet, with the number of pages naming them."""
    fresh = links.join(visited.select("link").distinct(), "link", "left_anti")
    return fresh.groupBy("link").agg(F.count(F.lit(1)).alias("pages"))


def discoveries(seen: DataFrame) -> DataFrame:
    """First record of every brochure and how often and where it was found: ``seen`` is (seq, content_id, chain_key, place)."""
    first = first_by(seen, ["content_id"], [F.col("seq")], ["content_id", "chain_key", "place"])
    per_place = seen.groupBy("content_id", "place").agg(F.count(F.lit(1)).alias("n"))
    found = per_place.groupBy("content_id").agg(F.sum("n").alias("found"), F.count(F.lit(1)).alias("places"))
    return first.join(found, "content_id")
