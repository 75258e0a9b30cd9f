"""Canonical names of retail chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.literals import literal_map, literal_rows

# Exact lower-case spellings of a chain.
CHAIN_ALIASES: dict[str, str] = {
    "aldi": "Aldi",
    "aldi süd": "Aldi",
    "aldi sued": "Aldi",
    "aldi nord": "Aldi",
    "aldi-nord": "Aldi",
    "lidl": "Lidl",
    "rewe": "Rewe",
    "rewe city": "Rewe",
    "rewe center": "Rewe",
    "nahkauf": "Rewe",
    "edeka": "Edeka",
    "e center": "Edeka",
    "e-center": "Edeka",
    "edeka center": "Edeka",
    "netto marken-discount": "Netto",
    "kaufland": "Kaufland",
    "penny": "Penny",
    "penny markt": "Penny",
    "penny-markt": "Penny",
    "netto": "Netto",
    "norma": "Norma",
    "globus": "Globus",
    "marktkauf": "Marktkauf",
}
# Parts of names, in the order they are tried.
CHAIN_PARTS: list[tuple[str, str]] = [
    ("aldi", "Aldi"),
    ("lidl", "Lidl"),
    ("rewe", "Rewe"),
    ("nahkauf", "Rewe"),
    ("edeka", "Edeka"),
    ("kaufland", "Kaufland"),
    ("penny", "Penny"),
    ("netto", "Netto"),
    ("norma", "Norma"),
    ("globus", "Globus"),
    ("marktkauf", "Marktkauf"),
]


def _by_part(low: Column) -> Column:
    parts = literal_rows(["part", "name"], CHAIN_PARTS)
    return F.get(F.filter(parts, lambda p: F.contains(low, p["part"])), F.lit(0))["name"]


def canonical_chain(raw: Column) -> Column:
    """Exact alias, else the first part contained in the name, else null."""
    low = F.lower(F.trim(raw))
    return F.coalesce(F.try_element_at(literal_map(CHAIN_ALIASES.items()), low), _by_part(low))


def chain_of_tags(brand: Column, operator: Column, name: Column) -> Column:
    """Chain of a map element: parts only, over brand, operator and name together."""
    filled = [F.when(c != "", c) for c in (brand, operator, name)]
    return F.coalesce(_by_part(F.lower(F.concat_ws(" ", *filled))), F.lit("Sonstige"))


def territory(publisher: Column) -> Column:
    """Regional company of a divided chain: sued, nord or null."""
    up = F.upper(publisher)
    has = lambda *parts: F.lit(False) if not parts else F.contains(up, F.lit(parts[0])) | has(*parts[1:])
    return F.when(has("ALDI SÜD", "ALDI SUED"), "sued").when(has("ALDI NORD", "ALDI-NORD"), "nord")


def chain_with_fallback(publisher: Column, chain_key: Column, folder: Column) -> Column:
    """First of publisher, key and folder naming a known chain, else the folder as a title."""
    title = F.initcap(F.replace(folder, F.lit("-"), F.lit(" ")))
    return F.coalesce(canonical_chain(publisher), canonical_chain(chain_key), canonical_chain(folder), title)


def split_chain(channel: Column, market: Column) -> Column:
    """Two banners of one source told apart by channel or market name."""
    text = F.lower(F.concat_ws(" ", channel, market))
    return F.when(F.contains(text, F.lit("marktkauf")), "Marktkauf").otherwise("Edeka")
