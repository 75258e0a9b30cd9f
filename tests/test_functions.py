import pytest
from pyspark.sql import functions as F

from offerloom.functions import chains, numbers, ratios, text, tokens, units
from offerloom.operators import labels
from offerloom.operators.matching import brand_matches


def values(spark, rows, build, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(build(F.col("x"))).collect()]


def test_unit_prices(spark):
    cases = [
        ("1 kg = 9.95", "weight", 9.95), ("100 g = 0,79 €", "weight", 0.79), ("(1 L = 2,39)", "volume", 2.39), ("1.000 Blatt = 2.88", "sheet", 2.88),
        ("9.27 €/kg", "weight", 9.27), ("10.- / kg", "weight", 10.0), ("kg-Preis 9.90", "weight", 9.9), ("kg = 3.76", "weight", 3.76),
        ("1 WL = 0,21–0,18", "laundry_load", 0.21), ("1 WA = ab €0.18", "laundry_load", 0.18), ("8.99 pro kg", "weight", 8.99), ("1.89 per 100 g", "weight", 1.89),
        ("per Dose 0.67", "piece", 0.67), ("1 Tab = 0,09", "application", 0.09), ("10 Tücher = 0.16", "wipe", 0.16), ("nur heute", None, None), (None, None, None),
    ]
    got = values(spark, [c[0] for c in cases], units.parse_base_price)
    assert [(g.unit_group, g.price) for g in got] == [c[1:] for c in cases]
    assert got[8].price_max == 0.18
    assert abs(got[1].price_per_normalized - 0.0079) < 1e-12


def test_description_quantities(spark):
    got = values(spark, ["auf Wunsch, HKL A 100 g", "je 1 kg", "1-kg-Packung", "je St.", "besonders zart je kg", "frisch"], units.quantity_from_description)
    assert [(g.quantity, g.unit) if g else None for g in got] == [(100.0, "g"), (1.0, "kg"), (1.0, "kg"), (1.0, "st"), (1.0, "kg"), None]


def test_german_numbers(spark):
    got = values(spark, ["1,29", "1.000", "9.27", "10.-", "1.299,00", "1.2.3", "x", ""], units.german_number)
    assert got == [1.29, 1000.0, 9.27, 10.0, 1299.0, None, None, None]


def test_text_forms(spark):
    assert values(spark, ["BÃ¤r", "â 5", "Ж€", "Bär"], text.repair_mojibake) == ["Bär", "â 5", "Ж€", "Bär"]
    assert values(spark, ["Müsli-Größe  Crème", None], text.normalize_search_text) == ["muesli groesse creme", ""]
    assert values(spark, ["Tafeläpfel"], text.base_vowel_text) == ["tafelapfel"]
    assert values(spark, ["Köln (West) / Süd"], text.city_slug) == ["Köln-Süd"]


def test_keywords(spark):
    got = values(spark, ["banane", "Tomaten", "äpfel", ""], tokens.keyword_variants)
    assert got == [["Banane", "banane", "Bananen"], ["Tomaten", "Tomate"], ["Äpfel", "äpfel", "Aepfel", "aepfel"], []]


def test_token_forms(spark):
    got = values(spark, ["aepfel", "bratapfel", "biere"], tokens.token_forms)
    assert got[0] == ["aepfel", "apfel"] and got[1] == ["brataepfel", "bratapfel"] and "bier" in got[2]
    assert values(spark, ["nuesse"], tokens.umlaut_variants) == [["nüsse", "nueße", "nüße"]]
    assert values(spark, ["steuer"], tokens.umlaut_variants) == [[]]


@pytest.mark.parametrize("raw,name", [("ALDI SÜD", "Aldi"), ("REWE City", "Rewe"), ("nahkauf", "Rewe"), ("Netto Marken-Discount", "Netto"), ("", None), ("Tante Emma", None)])
def test_chains(spark, raw, name):
    assert values(spark, [raw], chains.canonical_chain) == [name]


def test_brand_boundaries(spark):
    df = spark.createDataFrame([("milka", "Milka Tafel"), ("milka", "amilka"), ("milka", None), ("a+b", "A+B x")], "w string, b string")
    assert [r[0] for r in df.select(brand_matches(F.col("w"), F.col("b"))).collect()] == [True, False, False, True]


def test_validity(spark):
    df = spark.createDataFrame([(None, None), ("2024-01-01", None), (None, "2024-01-01"), ("2024-02-01", "2024-03-01")], "f string, t string")
    ok = numbers.valid_on(F.col("f").cast("date"), F.col("t").cast("date"), F.lit("2024-01-15").cast("date"))
    assert [r[0] for r in df.select(ok).collect()] == [True, True, False, False]


def test_ratios():
    assert ratios.token_set_ratio("milch", "frische milch") == 100.0
    assert ratios.partial_ratio("milch", "buttermilch") == 100.0
    assert abs(ratios.partial_ratio("abcd", "xabxd") - 75.0) < 1e-9
    assert ratios.token_set_ratio("abc", "xyz") == 0.0


def test_classifier(spark):
    names = spark.createDataFrame([("Buttercroissant",), ("H-Milch 1,5% Fett",), ("Hähnchenbrustfilet",), ("Scheuermilch",), ("Butter",)], "name string")
    got = {r.name: r for r in labels.classify(names, "name").collect()}
    assert got["Buttercroissant"].product_type == "Croissant" and got["Buttercroissant"].ingredients == "butter"
    assert (got["H-Milch 1,5% Fett"].semantic_group, got["H-Milch 1,5% Fett"].search_scope) == ("hmilch", "exact")  # "h milch 1 5 fett" has digits
    assert got["Hähnchenbrustfilet"].product_type == "Haehnchenbrustfilet"
    assert got["Scheuermilch"].parent_category == "Haushalt"
    assert (got["Butter"].search_scope, got["Butter"].confidence) == ("broad", 0.94)


def test_fixed_word_tables_are_whole(spark):
    """Expectations are stated here, not taken from the tables."""
    from offerloom.functions import tokens

    def forms(word):
        return set(spark.range(1).select(tokens.token_forms(F.lit(word))).first()[0])

    assert {"pflaume", "pflaumen"} <= forms("pflaumen") and forms("quark") == {"quark"} and forms("chips") == {"chips"}
    assert {"haselnuss", "haselnuesse"} <= forms("haselnuesse") and "currywuerste" in forms("currywurst") and "tomaten" in forms("tomate")

    def others(text):
        return set(spark.range(1).select(tokens.synonym_variants(F.lit(text))).first()[0])

    assert "spülmittel" in others("spüli") and "peperoni" in others("paprika") and {"zwetschgen", "zwetschken"} <= others("pflaumen")
    assert "wein" in others("rotwein") and "rotwein" not in others("wein") and "wurst" in others("salami") and "krapfen" in others("berliner")
