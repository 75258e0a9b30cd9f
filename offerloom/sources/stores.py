"""Stores from map elements and other lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.chains import chain_of_tags
from offerloom.operators.catalog import last_by


def _filled(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def format_address(street: Column, number: Column, postcode: Column, city: Column) -> Column:
    first = F.when(_filled(street).isNotNull(), F.concat_ws(" ", _filled(street), _filled(number)))
    second = _filled(F.concat_ws(" ", _filled(postcode), _filled(city)))
    return _filled(F.concat_ws(", ", first, second))


def flatten_elements(elements: DataFrame) -> DataFrame:
    """Stores out of map elements (seq, type, id, lat, lon, center, tags); the last of equal (type, id) wins."""
    tag = lambda key: F.try_element_at("tags", F.lit(key))
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = elements.select(
        "seq", F.coalesce("type", F.lit("node")).alias("type"), "id",
        F.coalesce(_filled(tag("name")), _filled(tag("brand")), _filled(tag("operator")), F.lit("Unbekannt")).alias("name"),
        chain_of_tags(tag("brand"), tag("operator"), tag("name")).alias("chain"),
        F.when(whole, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"), F.when(whole, F.col("lon")).otherwise(F.col("center.lon")).alias("lon"),
        format_address(tag("addr:street"), tag("addr:housenumber"), tag("addr:postcode"), tag("addr:city")).alias("address"),
    )
    return last_by(rows.where("lat IS NOT NULL AND lon IS NOT NULL"), ["type", "id"], [F.col("seq")]).drop("seq")


# Where the store lists of the sources keep what a store row needs, in the order they are tried.
SOURCE_FIELDS: dict[str, dict[str, list[str]]] = {
    "aldi": {"store_id": ["id", "identifier"], "name": [], "lat": ["lat"], "lon": ["lng"], "address": ["streetAndNumber"], "postcode": ["zip"], "city_name": ["city"]},
    "kaufland": {"store_id": ["n"], "name": [], "lat": ["lat"], "lon": ["lng"], "address": ["sn"], "postcode": ["pc"], "city_name": ["t"]},
    "globus": {
        "store_id": ["nummer", "id"], "name": ["name"], "lat": ["breitengrad", "lat"], "lon": ["laengengrad", "lng"], "address": ["strasse"], "postcode": ["plz"], "city_name": ["stadt"],
    },
    "lidl": {"store_id": ["EntityID"], "name": [], "lat": ["Latitude"], "lon": ["Longitude"], "address": ["AddressLine"], "postcode": ["PostalCode"], "city_name": ["Locality"]},
    "edeka": {
        "store_id": ["id"], "name": ["name"], "lat": ["coordinates.lat"], "lon": ["coordinates.lng"], "address": ["address.street"], "postcode": ["address.zipCode"], "city_name": ["address.city"],
    },
    "norma": {
        "store_id": ["id"], "name": ["name"], "lat": ["lat", "latitude"], "lon": ["lng", "longitude", "lon"], "address": ["street", "address"], "postcode": ["zip", "postcode"],
        "city_name": ["city", "ort"],
    },
    "penny": {
        "store_id": ["marketId"], "name": ["marketName"], "lat": ["latitude"], "lon": ["longitude"], "address": ["streetWithHouseNumber"], "postcode": ["zipCode"], "city_name": ["city"],
    },
}


def map_source(records: DataFrame, source: str, chain: Column | None = None, fields: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Store rows out of the JSON records (record) of one source; those without coordinates are left out.

    A store without name is called by its chain and city. ``chain`` defaults to the source's name,
    for Edeka to the split into its two chains.
    """
    from offerloom.functions.chains import split_chain

    paths = (fields or SOURCE_FIELDS)[source]

    def field(name: str) -> Column:
        found = [_filled(F.get_json_object("record", f"$.{path}")) for path in paths[name]]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    if chain is None:
        chain = split_chain(F.coalesce(F.get_json_object("record", "$.distributionChannel"), F.lit("")), F.coalesce(field("name"), F.lit(""))) if source == "edeka" else F.lit(source.title())
    rows = records.select(
        F.lit(source).alias("source"), field("store_id").alias("store_id"), field("name").alias("given"), chain.alias("chain"),
        F.nullif(field("lat").try_cast("double"), F.lit(0.0)).alias("lat"), F.nullif(field("lon").try_cast("double"), F.lit(0.0)).alias("lon"),
        field("address").alias("address"), field("postcode").alias("postcode"), field("city_name").alias("city_name"),
    ).where("lat IS NOT NULL AND lon IS NOT NULL")
    name = F.coalesce("given", F.trim(F.concat_ws(" ", "chain", "city_name")))
    return rows.select("source", "store_id", name.alias("name"), "chain", "lat", "lon", "address", "postcode", "city_name")


def upsert(batches: DataFrame, key: list[str], version: str, payload: list[str]) -> DataFrame:
    """Union of batches: the newest row per key, with the first and last version it was seen in."""
    seen = batches.groupBy(*key).agg(
        F.max_by(F.struct(*payload), F.col(version)).alias("p"), F.min(version).alias("created"), F.max(version).alias("updated")
    )
    return seen.select(*key, "p.*", "created", "updated")


def thin_grid(points: DataFrame, order: str) -> DataFrame:
    """First point per coordinates rounded to five places, inside the country's box only."""
    inside = points.where(F.col("lat").between(47, 56) & F.col("lon").between(5, 16))
    keyed = inside.withColumns({"la": F.round("lat", 5), "lo": F.round("lon", 5)})
    return keyed.groupBy("la", "lo").agg(F.min(order).alias(order))


def flatten_store_pages(pages: DataFrame) -> DataFrame:
    """Store pages (path, crawled, place, viewer, publisher): distinct brochure ids, the latest crawl wins."""
    rows = pages.withColumn("brochure_ids", F.array_sort(F.array_distinct(F.array_compact(F.concat("viewer", "publisher")))))
    return last_by(rows, ["path"], [F.col("crawled")], ["path", "place", "brochure_ids", "crawled"])
