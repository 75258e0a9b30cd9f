"""Quantities, units and unit prices read out of German price texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom.functions.literals import literal_map

# Unit token -> (unit group, factor to the canonical unit, canonical unit).
UNITS: dict[str, tuple[str, float, str]] = {
    "kg": ("weight", 1000.0, "g"),
    "g": ("weight", 1.0, "g"),
    "l": ("volume", 1000.0, "ml"),
    "liter": ("volume", 1000.0, "ml"),
    "ml": ("volume", 1.0, "ml"),
    "wl": ("laundry_load", 1.0, "wl"),
    "wa": ("laundry_load", 1.0, "wl"),
    "waschladung": ("laundry_load", 1.0, "wl"),
    "waesche": ("laundry_load", 1.0, "wl"),
    "wi": ("laundry_load", 1.0, "wl"),
    "tab": ("application", 1.0, "tab"),
    "anwendung": ("application", 1.0, "tab"),
    "me": ("application", 1.0, "tab"),
    "por": ("application", 1.0, "tab"),
    "blatt": ("sheet", 1.0, "blatt"),
    "tuecher": ("wipe", 1.0, "tuch"),
    "stueck": ("piece", 1.0, "stk"),
    "st": ("piece", 1.0, "stk"),
    "stk": ("piece", 1.0, "stk"),
    "dose": ("piece", 1.0, "stk"),
    "m": ("meter", 1.0, "m"),
}
# Spellings with umlauts.
UNIT_SPELLINGS = {"wäsche": "waesche", "tücher": "tuecher", "stück": "stueck"}


@dataclass(frozen=True)
class PriceForm:
    """One way of printing a unit price; the numbers are regex groups, 0 meaning absent."""

    pattern: str
    qty: int
    unit: int
    price: int
    price_max: int = 0


_UNIT = "([A-Za-zÄÖÜäöüß]{1,14})"
_NUM = r"(\d[\d.,]*)"
_QTY = r"(\d[\d.]*(?:,\d+)?)"
_NUM_DASH = r"(\d[\d.,]*(?:\.-)?)"

# The printed forms in the order they are tried.
PRICE_FORMS = [
    # "1 kg = 9.95", "1 WL = 0,21–0,18", "1 kg ab 3.98"
    PriceForm(
        _QTY + r"\s*" + _UNIT + r"\s*(?:[=:]|ab)\s*(?:ab\s*)?[€$]?\s*" + _NUM_DASH
        + r"(?:\s*[€])?(?:\s*[-–/]\s*[€$]?\s*" + _NUM + ")?",
        1, 2, 3, 4,
    ),
    # "1 Liter ab 1.66"
    PriceForm(_QTY + r"\s+" + _UNIT + r"\s+ab\s+[€$]?\s*" + _NUM, 1, 2, 3),
    # "9.27 €/kg", "10.- / kg"
    PriceForm(_NUM_DASH + r"\s*(?:€)?\s*/\s*" + _UNIT, 0, 2, 1),
    # "0.39 €/100g"
    PriceForm(_NUM + r"\s*(?:€)?\s*/\s*(\d+)\s*" + _UNIT, 2, 3, 1),
    # "kg-Preis 9.90"
    PriceForm(_UNIT + r"-Preis\s+" + _NUM, 0, 1, 2),
    # "8.99 pro kg", "1.89 per 100 g"
    PriceForm(_NUM + r"\s*(?:pro|per|je)\s+" + _NUM + r"?\s*" + _UNIT, 2, 3, 1),
    # "per Dose 0.67"
    PriceForm(r"(?:per|pro|je)\s+" + _UNIT + r"\s*(?:=\s*)?" + _NUM, 0, 1, 2),
    # "kg = 3.76"
    PriceForm(_UNIT + r"\s*=\s*" + _NUM, 0, 1, 2),
]

# Quantity forms inside a description, in the order they are tried (0 = one unit).
QUANTITY_FORMS = [
    (r"(\d[\d.,]*)-([A-Za-zÄÖÜäöüß]{1,6})(?:-(?:Packung|Flasche|Dose|Pack|Packet|Beutel|Becher|Tube))?", 1, 2),
    (r"(?:je\s+)?(\d[\d.,]*)\s*([A-Za-zÄÖÜäöüß]{1,14})(?:\s|$|,|\.|;|/)", 1, 2),
    (r"\bje\s+([A-Za-zÄÖÜäöüß]{1,14})\.?(?:\s|$|,|;)", 0, 1),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def german_number(text: Column) -> Column:
    """"1,29", "1.000" (thousand), "9.27", "1.299,00" and "10.-" as numbers, null for anything else."""
    t = F.regexp_replace(F.trim(text), r"(\d)\.-?$", "$1")
    t = F.regexp_replace(t, r"\.(?=.*,)|(?<=,.{0,99})\.", "")
    t = F.regexp_replace(t, r"^([^.,]*)\.([^.,]{3})$", "$1$2")
    t = F.replace(t, F.lit(","), F.lit("."))
    return F.regexp_extract(t, r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$", 0).try_cast("double")


def _unit_map(position: int | None) -> Column:
    return literal_map((k, k if position is None else v[position]) for k, v in UNITS.items())


def unit_key(raw: Column) -> Column:
    """Canonical token of a printed unit, null if unknown."""
    token = F.lower(F.rtrim(F.trim(raw), F.lit(".")))
    for spelled, plain in UNIT_SPELLINGS.items():
        token = F.replace(token, F.lit(spelled), F.lit(plain))
    return F.try_element_at(_unit_map(None), token)


def unit_attribute(key: Column, position: int) -> Column:
    return F.try_element_at(_unit_map(position), key)


def _with_unit_price(hit: Column) -> Column:
    return F.struct(
        hit["quantity"].alias("quantity"),
        hit["unit"].alias("unit"),
        unit_attribute(hit["unit"], 0).alias("unit_group"),
        hit["price"].alias("price"),
        hit["price_max"].alias("price_max"),
        unit_attribute(hit["unit"], 2).alias("normalized_unit"),
        (hit["price"] / (hit["quantity"] * unit_attribute(hit["unit"], 1))).alias("price_per_normalized"),
    )


def _base_price_hit(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    printed = []
    for form in PRICE_FORMS:
        pattern = "(?iU)" + form.pattern
        unit = F.regexp_extract(t, pattern, form.unit)
        printed.append(
            F.when(
                unit != "",
                F.struct(
                    (F.regexp_extract(t, pattern, form.qty) if form.qty else F.lit("1")).alias("quantity"),
                    unit_key(unit).alias("unit"),
                    F.regexp_extract(t, pattern, form.price).alias("price"),
                    (F.regexp_extract(t, pattern, form.price_max) if form.price_max else F.lit("")).alias("price_max"),
                ),
            )
        )
    read = F.transform(
        F.filter(F.array(*printed), lambda f: f["unit"].isNotNull()),
        lambda f: F.struct(
            F.when(f["quantity"].isin("", "1"), F.lit(1.0)).otherwise(german_number(f["quantity"])).alias("quantity"),
            f["unit"].alias("unit"),
            german_number(f["price"]).alias("price"),
            F.when(f["price_max"] != "", german_number(f["price_max"])).alias("price_max"),
        ),
    )
    return F.get(F.filter(read, lambda f: (f["quantity"] > 0) & f["price"].isNotNull()), F.lit(0))


def parse_base_price(text: Column) -> Column:
    """Struct with quantity, unit, group, price, upper price and the price of one canonical unit.

    The forms are tried in order; of each form only the first hit counts, and it must carry
    a known unit and readable numbers.
    """
    return let(_base_price_hit(text), _with_unit_price)


def _described_hit(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    found = []
    for pattern, qty_group, unit_group in QUANTITY_FORMS:
        regex = F.lit("(?iU)" + pattern)
        units = F.regexp_extract_all(t, regex, F.lit(unit_group))
        found.append(F.arrays_zip(F.regexp_extract_all(t, regex, F.lit(qty_group)).alias("q"), units.alias("u")) if qty_group
                     else F.transform(units, lambda u: F.struct(F.lit("1").alias("q"), u.alias("u"))))
    read = F.transform(F.concat(*found), lambda p: F.struct(german_number(p["q"]).alias("quantity"), unit_key(p["u"]).alias("unit")))
    return F.get(F.filter(read, lambda p: (p["quantity"] > 0) & p["unit"].isNotNull()), F.lit(0))


def quantity_from_description(text: Column) -> Column:
    """Struct (quantity, unit, unit_group, normalized_unit) of the first usable quantity, else null."""
    return let(
        _described_hit(text),
        lambda hit: F.when(
            hit.isNotNull(),
            F.struct(
                hit["quantity"].alias("quantity"),
                hit["unit"].alias("unit"),
                unit_attribute(hit["unit"], 0).alias("unit_group"),
                unit_attribute(hit["unit"], 2).alias("normalized_unit"),
            ),
        ),
    )


def enrich_unit_price(base_price_text: Column, description: Column, sales_price: Column) -> Column:
    """Unit price of the price text; where that is empty, sale price over the described quantity."""
    described = let(
        _described_hit(description),
        lambda hit: F.when(
            hit.isNotNull(),
            F.struct(
                hit["quantity"].alias("quantity"), hit["unit"].alias("unit"), sales_price.alias("price"),
                F.lit(None).cast("double").alias("price_max"),
            ),
        ),
    )
    no_text = F.trim(F.coalesce(base_price_text, F.lit(""))) == ""
    hit = F.when(no_text & sales_price.isNotNull(), described).otherwise(_base_price_hit(base_price_text))
    return let(hit, _with_unit_price)


def comparable(group_a: Column, unit_price_a: Column, group_b: Column, unit_price_b: Column) -> Column:
    """Two unit prices may be compared: same known group, both prices known."""
    return F.coalesce((group_a == group_b) & unit_price_a.isNotNull() & unit_price_b.isNotNull(), F.lit(False))


def display_unit_price(price: Column, unit: Column, quantity: Column) -> Column:
    """Price per kilogram, litre or piece for display, as (value, unit)."""
    u = F.lower(unit)
    per_thousand = price / quantity * 1000
    value = F.when(u.isin("g", "ml"), per_thousand).when(u.isin("kg", "l", "liter"), price / quantity).otherwise(price / quantity)
    label = F.when(u.isin("g", "kg"), "kg").when(u.isin("ml", "l", "liter"), "l").otherwise(u)
    return F.struct(value.alias("value"), label.alias("unit"))
