"""Building the product taxonomy: grouping of names, rule classification, label tables, hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.literals import literal_array, literal_rows
from offerloom.functions.text import compact_text, normalize_search_text, words
from offerloom.session import cut_lineage

# Beginnings and endings that do not make another product, in the order they are removed.
PREFIXES = [
    r"frische[rs]?\s+", r"deutsche[rs]?\s+", r"original\s+", r"delikatess\s+", r"premium\s+", r"xxl\s+", r"mini[- ]", r"bio[- ]", r"demeter\s+", r"bioland\s+",
    r"regionale[rs]?\s+", r"beste[rs]?\s+(?:vom?|von)\s+(?:huhn|rind|schwein)\s+", r"freiland[- ]", r"fairmast\s+", r"landbauern\s+", r"metzgerfrisch\s+",
    r"gqb\s+", r"kikok[- ]mais[- ]",
]
SUFFIXES = [
    r"\s+natur$", r"\s+gewuerzt$", r"\s+mariniert\s+\w+$", r"\s+mariniert$", r"\s+gefuellt\s+.*$", r"\s+nach art\s+.*$", r"\s+style$", r"\s+art$", r"\s+klassisch$",
    r"\s+classic$", r"\s+xxl$",
]
REWORDINGS = [(r"\bh\s*milch\b", "haltbare milch"), (r"\bhmilch\b", "haltbare milch"), (r"\bh\s*vollmilch\b", "haltbare vollmilch"), (r"(\d)\s+fett$", "$1"), (r"^unsere[rs]?\s+", "")]
NO_PRODUCT = ["original", "10 rabatt", "15", "20 rabatt"]
NO_PRODUCT_STARTS = ["rabatt", "bis zu ", "gutschein", "guthabenkarte", "coupon"]
# Fixed values: (part of the joined name, type, parent, group, scope, ingredients), before all other rules.
OVERRIDES = [
    ("scheuermilch", "Reiniger", "Haushalt", "reiniger", "exact", [], 0.98), ("reiniger", "Reiniger", "Haushalt", "reiniger", "broad", [], 0.98),
    ("butterchicken", "Chicken", "Fertiggerichte", "chicken", "exact", ["butter"], 0.97), ("erdnussbutter", "Erdnussbutter", "Aufstriche", "erdnussbutter", "group", [], 0.97),
    ("peanutbutter", "Erdnussbutter", "Aufstriche", "erdnussbutter", "group", [], 0.97), ("buttertoast", "Toast", "Backwaren", "toast", "group", ["butter"], 0.97),
]
# Fixed values: (last part of the name, type, parent, group), the first that fits.
HEADS = [
    ("brustfilet", "Brustfilet", "Gefluegel", "haehnchenbrust"), ("croissant", "Croissant", "Backwaren", "croissant"), ("toast", "Toast", "Backwaren", "toast"),
    ("broetchen", "Broetchen", "Backwaren", "broetchen"), ("baguette", "Baguette", "Backwaren", "baguette"), ("schnitte", "Schnitte", "Suesswaren", "schnitte"),
    ("riegel", "Riegel", "Suesswaren", "riegel"), ("dessert", "Dessert", "Molkerei", "dessert"), ("joghurt", "Joghurt", "Molkerei", "joghurt"),
    ("camembert", "Camembert", "Kaese", "camembert"), ("kaese", "Kaese", "Kaese", "kaese"), ("schokolade", "Schokolade", "Suesswaren", "schokolade"),
    ("schorle", "Schorle", "Getraenke", "schorle"), ("saft", "Saft", "Getraenke", "saft"), ("wurst", "Wurst", "Wurst", "wurst"),
    ("mortadella", "Mortadella", "Wurst", "mortadella"), ("salami", "Salami", "Wurst", "salami"), ("schenkel", "Schenkel", "Gefluegel", "haehnchenschenkel"),
    ("schnitzel", "Schnitzel", "Gefluegel", "haehnchenschnitzel"), ("geschnetzeltes", "Geschnetzeltes", "Gefluegel", "haehnchen_geschnetzeltes"),
    ("nuggets", "Nuggets", "Gefluegel", "haehnchen_nuggets"), ("milch", "Milch", "Molkerei", "trinkmilch"), ("butter", "Butter", "Molkerei", "butter"),
]
POULTRY = ["haehnchen", "huhn", "gefluegel", "maishaehnchen"]
INGREDIENTS = ["butter", "milch", "kaese", "honig", "vanille", "schokolade", "tomate"]
WIDE_GROUPS = ["hmilch", "haltbare_milch", "haehnchenschenkel", "haehnchenschnitzel", "gefluegelwurst"]


def grouping_key(name: Column) -> Column:
    """Name without beginnings, endings and spellings that do not make another product."""
    text = normalize_search_text(name)
    for pattern in PREFIXES:
        text = F.trim(F.regexp_replace(text, "^" + pattern, ""))
    for pattern in SUFFIXES:
        text = F.trim(F.regexp_replace(text, pattern, ""))
    for pattern, replacement in REWORDINGS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "(filet|steak)s$", "$1")


def is_no_product(name: Column) -> Column:
    norm = normalize_search_text(name)
    starts = F.exists(literal_array(NO_PRODUCT_STARTS), lambda p: F.startswith(norm, p))
    return (norm == "") | norm.isin(*NO_PRODUCT) | starts | F.contains(norm, F.lit(" rabatt"))


def canonical_names(names: DataFrame) -> DataFrame:
    """(key, canonical, products, offers) out of (product_name, n): no prefix first, then short, then frequent."""
    kept = names.where(~is_no_product(F.col("product_name"))).withColumn("key", grouping_key(F.col("product_name"))).where("key <> ''")
    prefixed = (normalize_search_text(F.col("product_name")) != F.col("key")).cast("int")
    order = F.struct(prefixed, F.length(compact_text(F.col("product_name"))), -F.col("n"), "product_name")
    return kept.groupBy("key").agg(F.min_by("product_name", order).alias("canonical"), F.count(F.lit(1)).alias("products"), F.sum("n").alias("offers"))


def _scope(norm: Column, kind: Column, group: Column) -> Column:
    narrow = F.exists(literal_array(["filet", "kirschtomate", "curry"]), lambda p: F.contains(norm, p))
    return (
        F.when(norm.rlike(r"\d"), "exact").when(norm == F.lower(kind), "broad").when(group.isin(*WIDE_GROUPS), "group").when(narrow, "exact").otherwise("group")
    )


def classify(names: DataFrame, column: str) -> DataFrame:
    """Product type, parent, group, scope, ingredients and confidence of every distinct name, first rule first."""
    text = normalize_search_text(F.col(column))
    base = names.select(column).distinct().withColumn("norm", text).withColumn("joined", F.replace("norm", F.lit(" ")))
    over = literal_rows(["part", "type", "parent", "grp", "scope", "ingredients", "confidence"], [(*o[:5], o[5] or ["-"], o[6]) for o in OVERRIDES])
    heads = literal_rows(["part", "type", "parent", "grp"], HEADS)
    norm, joined = F.col("norm"), F.col("joined")
    inside = lambda part: F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))
    base = base.withColumns({
        "o": F.get(F.filter(over, lambda r: F.contains(joined, r["part"])), F.lit(0)),
        "h": F.get(F.filter(heads, lambda r: F.endswith(joined, r["part"]) | inside(r["part"])), F.lit(0)),
        "poultry": F.exists(literal_array(POULTRY), lambda p: F.contains(joined, p)),
    })
    kind = F.coalesce("h.type", compact_text(F.col(column)))
    group = F.coalesce("h.grp", F.when(norm != "", norm).otherwise("sonstige"))
    has = lambda part: F.contains(norm, F.lit(part))
    bird = (
        F.when(has("brust") & has("filet"), F.array(F.lit("Haehnchenbrustfilet"), F.lit("haehnchenbrust"), F.lit("exact")))
        .when(has("brust"), F.array(F.lit("Haehnchenbrust"), F.lit("haehnchenbrust"), F.lit("broad")))
        .when(has("schenkel") | has("keule"), F.array(F.lit("Haehnchenschenkel"), F.lit("haehnchenschenkel"), F.lit("group")))
        .when(has("schnitzel"), F.array(F.lit("Haehnchenschnitzel"), F.lit("haehnchenschnitzel"), F.lit("group")))
        .when(has("mortadella") | has("wurst") | has("salami"), F.array(F.lit("Gefluegelwurst"), F.lit("gefluegelwurst"), F.lit("group")))
        .when(group != norm, F.array(kind, group, F.lit("group")))
        .otherwise(F.array(F.lit("Haehnchen"), F.lit("haehnchen"), F.lit("broad")))
    )
    milk = F.when(has("h milch") | F.contains(joined, F.lit("hmilch")), "hmilch").when(has("haltbare milch"), "haltbare_milch").otherwise("trinkmilch")
    ruled = base.withColumns({
        "kind": F.when(F.col("poultry"), F.get(bird, F.lit(0))).otherwise(kind), "grp0": F.when(F.col("poultry"), F.get(bird, F.lit(1))).otherwise(group),
        "scope0": F.when(F.col("poultry"), F.get(bird, F.lit(2))).when(F.col("h").isNotNull(), _scope(norm, kind, group)).otherwise("exact"),
        "parent0": F.coalesce("h.parent", F.when(F.col("poultry"), "Gefluegel").otherwise("Sonstige")),
    })
    grp = F.when(F.col("kind") == "Milch", milk).otherwise(F.col("grp0"))
    scope = F.when(F.col("kind").isin("Milch", "Butter"), _scope(norm, F.col("kind"), grp)).otherwise(F.col("scope0"))
    confidence = F.greatest(
        F.when(F.col("h").isNotNull(), 0.86).otherwise(0.55), F.when(F.col("poultry"), 0.9).otherwise(0.0),
        F.when(F.col("kind") == "Milch", 0.92).when(F.col("kind") == "Butter", 0.94).otherwise(0.0),
    )
    named = F.filter(literal_array(INGREDIENTS), lambda i: (i != F.lower(F.col("kind"))) & (inside(i) | F.startswith(joined, i)))
    more = F.array_compact(F.array(
        F.when((F.col("kind") == "Croissant") & F.contains(joined, F.lit("butter")), "butter"),
        F.when(F.col("kind").isin("Schnitte", "Riegel", "Dessert", "Joghurt", "Schokolade") & F.contains(joined, F.lit("milch")), "milch"),
    ))
    o = F.col("o")
    tags = F.when(o.isNotNull(), F.filter(o["ingredients"], lambda i: i != "-")).otherwise(F.array_distinct(F.concat(named, more)))
    return ruled.select(
        column, F.coalesce(o["type"], "kind").alias("product_type"), F.coalesce(o["parent"], "parent0").alias("parent_category"), F.coalesce(o["grp"], grp).alias("semantic_group"),
        F.coalesce(o["scope"], scope).alias("search_scope"), F.array_join(F.array_sort(tags), ",").alias("ingredients"), F.coalesce(o["confidence"], confidence).alias("confidence"),
    )


# Words of a normalised name and the attribute they give; a later entry replaces an earlier one of its name.
ATTRIBUTES: list[tuple[str, str, str]] = [
    (r"\bbio\b", "bio", "true"),
    (r"\bdemeter\b", "demeter", "true"),
    (r"\blaktosefrei\b", "laktosefrei", "true"),
    (r"\bh milch\b|\bhmilch\b", "haltbar", "true"),
    (r"\bhaltbare?\b", "haltbar", "true"),
    (r"\b1 5\b", "fett", "1.5"),
    (r"\b3 5\b", "fett", "3.5"),
]


def attributes(name: Column) -> Column:
    """Sorted "attribute=value" texts of a name."""
    norm = normalize_search_text(name)
    found = {}
    for pattern, attribute, value in ATTRIBUTES:
        found[attribute] = F.when(norm.rlike(pattern), F.lit(f"{attribute}={value}")).otherwise(found.get(attribute, F.lit(None).cast("string")))
    return F.array_sort(F.array_compact(F.array(*found.values())))


def family_tree(classified: DataFrame) -> DataFrame:
    """Kind, family and expanded count of (name, product_type, search_scope, offers): the name equal to its type is the family."""
    norm, kind = normalize_search_text(F.col("name")), normalize_search_text(F.col("product_type"))
    rows = classified.withColumn("type_norm", kind).withColumn("family", (norm == kind) & F.col("search_scope").isin("broad", "group"))
    per_type = rows.groupBy("type_norm").agg(F.sum("offers").alias("type_offers"), F.min(F.when(F.col("family"), F.col("name"))).alias("family_name"))
    return rows.join(per_type, "type_norm").select(
        "name", F.when(F.col("family"), "family").otherwise("category").alias("kind"), F.when(~F.col("family"), F.col("family_name")).alias("parent"), "offers",
        F.when(F.col("family"), F.col("type_offers")).otherwise(F.col("offers")).alias("expanded"),
    )


def apply_merges(results: DataFrame, sub_merges: list[tuple[str, str]], parent_moves: list[tuple[str, str, str]]) -> DataFrame:
    """Parent and sub-category of classification results (product_name, ok, uk): merged subs, then moved parents."""
    uk = F.trim(F.coalesce("uk", F.lit("Sonstiges")))
    title = F.concat(F.upper(F.substring(uk, 1, 1)), F.substring(uk, F.lit(2), F.length(uk)))
    merged = F.get(F.filter(literal_rows(["a", "b"], sub_merges), lambda m: m["a"] == F.lower(uk)), F.lit(0))["b"]
    rows = results.withColumn("sub", F.coalesce(merged, title)).withColumn("ok", F.trim(F.coalesce("ok", F.lit("Sonstiges"))))
    moves = literal_rows(["ok", "uk", "to"], parent_moves)
    moved = F.get(F.filter(moves, lambda m: (m["ok"] == F.lower("ok")) & (m["uk"] == F.lower("sub"))), F.lit(0))["to"]
    return rows.withColumn("parent", F.coalesce(moved, "ok"))


def two_levels(merged: DataFrame) -> DataFrame:
    """Distinct categories (level, key, name, parent_key); of spellings differing in case the first by text is shown."""
    pairs = merged.select(F.lower("parent").alias("pk"), F.lower("sub").alias("sk"), "parent", "sub")
    top = pairs.groupBy(F.col("pk").alias("key")).agg(F.min("parent").alias("name")).select(F.lit(1).alias("level"), "key", "name", F.lit(None).cast("string").alias("parent_key"))
    sub = pairs.groupBy("pk", "sk").agg(F.min("sub").alias("name")).select(F.lit(2).alias("level"), F.concat_ws("/", "pk", "sk").alias("key"), "name", F.col("pk").alias("parent_key"))
    return top.unionByName(sub)


def product_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Category key of (product_name, parent, sub): the exact pair, else any with the same sub (smallest key), else the parent."""
    exact = categories.where("level = 2").select(F.col("key").alias("exact_key"))
    by_sub = categories.where("level = 2").groupBy(F.lower("name").alias("sk")).agg(F.min("key").alias("sub_key"))
    top = categories.where("level = 1").select(F.col("key").alias("top_key"))
    rows = products.withColumns({"exact_key": F.concat_ws("/", F.lower("parent"), F.lower("sub")), "sk": F.lower("sub"), "top_key": F.lower("parent")})
    found = rows.join(exact.withColumn("e", F.lit(1)), "exact_key", "left").join(by_sub, "sk", "left").join(top.withColumn("p", F.lit(1)), "top_key", "left")
    return found.select("product_name", F.coalesce(F.when(F.col("e") == 1, F.col("exact_key")), "sub_key", F.when(F.col("p") == 1, F.col("top_key"))).alias("key"))


def label_rows(products: DataFrame) -> DataFrame:
    """Search labels of (product_name, terms, brand, generic): terms, brand and generic term, trimmed and lower case."""
    typed = lambda text, kind: F.struct(F.lower(F.trim(text)).alias("label"), F.lit(kind).alias("label_type"))
    every = F.concat(F.transform("terms", lambda s: typed(s, "suchbegriff")), F.array(typed(F.col("brand"), "marke"), typed(F.col("generic"), "gattung")))
    return products.select("product_name", F.explode(every).alias("l")).select("product_name", "l.*").where("label <> ''")


def decompose(labels: DataFrame, manual: list[tuple[str, list[str]]], min_length: int = 8) -> DataFrame:
    """(product_name, label) of the parts of long one-word labels: listed splits first, else both parts being labels themselves.

    All split positions of a word are joined with the label vocabulary twice; of several splits
    the one with the longest second part counts.
    """
    long = labels.where(~F.contains("label", F.lit(" ")) & (F.length("label") >= min_length)).select("product_name", "label").distinct()
    whole = long.select("label").distinct()
    listed = F.get(F.filter(literal_rows(["word", "parts"], manual), lambda m: m["word"] == F.col("label")), F.lit(0))["parts"]
    known = whole.withColumn("parts", listed)
    vocabulary = labels.select(F.col("label").alias("w")).where(F.length("w") >= 3).distinct()
    cuts = known.where("parts IS NULL").select("label", F.explode(F.sequence(F.lit(3), F.length("label") - 3)).alias("at"))
    cuts = cuts.select("label", "at", F.substring(F.col("label"), F.lit(1), F.col("at")).alias("a"), F.substring(F.col("label"), F.col("at") + 1, F.length("label")).alias("b"))
    both = cuts.join(vocabulary.withColumnRenamed("w", "a"), "a", "left_semi").join(vocabulary.withColumnRenamed("w", "b"), "b", "left_semi")
    auto = both.groupBy("label").agg(F.min_by(F.array("a", "b"), "at").alias("parts"))
    parts = known.where("parts IS NOT NULL").unionByName(auto)
    return long.join(parts, "label").select("product_name", F.explode("parts").alias("label"))


def resolve_merges(merges: DataFrame, rounds: int = 64) -> DataFrame:
    """(source, target) pairs followed to their last target; pointer doubling, so chains halve every round.

    Two names that merge into each other swap; a longer cycle has no last target and is an error.
    """
    current = merges.where("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    for _ in range(rounds):
        onward = current.select(F.col("source").alias("target"), F.col("target").alias("further"))
        linked = current.join(onward, "target", "left")
        moved = linked.where((F.col("further").isNotNull()) & (F.col("further") != F.col("source")))
        current = cut_lineage(linked.select("source", F.when(F.col("further") != F.col("source"), F.col("further")).otherwise(F.col("target")).alias("target")))
        if moved.isEmpty():
            return current
    raise ValueError("the merges contain a cycle of more than two names")


def regroup(categories: DataFrame, merges: DataFrame, groups: DataFrame) -> DataFrame:
    """Three-level tree (ober, name, level, parent, n) out of second-level categories (ober, name, n).

    ``merges`` is (source, target) and ``groups`` (ober, group, child), all names lower case. Equal
    names under different top categories stay apart. A merged category adds its count to its
    target; a group reuses the category of its name; what no group lists goes to the group
    "sonstiges" of its top category.
    """
    final = resolve_merges(merges)
    key = ["ober", "name"]
    moved = categories.join(final, categories["name"] == final["source"], "left").select("ober", F.coalesce("target", "name").alias("name"), "n")
    level2 = moved.groupBy(*key).agg(F.sum("n").alias("n"))
    heads = groups.select("ober", F.col("group").alias("name")).distinct()
    placed = groups.where("child <> group").groupBy("ober", F.col("child").alias("name")).agg(F.min("group").alias("parent"))
    own = level2.join(heads.withColumn("is_head", F.lit(True)), key, "left").join(placed, key, "left")
    children = own.where("is_head IS NULL").select(*key, F.coalesce("parent", F.concat(F.lit("sonstiges/"), "ober")).alias("parent"), "n")
    direct = own.where("is_head").select(*key, "n")
    below = children.groupBy("ober", F.col("parent").alias("name")).agg(F.sum("n").alias("below"))
    zero = F.lit(0).cast("bigint")
    head_rows = heads.join(direct, key, "left").join(below, key, "full_outer").select(*key, (F.coalesce("n", zero) + F.coalesce("below", zero)).alias("n"))
    tops = head_rows.groupBy("ober").agg(F.sum("n").alias("n"))
    columns = ["ober", "name", "level", "parent", "n"]
    return (
        children.withColumn("level", F.lit(3)).select(*columns)
        .unionByName(head_rows.withColumns({"level": F.lit(2), "parent": F.col("ober")}).select(*columns))
        .unionByName(tops.withColumns({"level": F.lit(1), "name": F.col("ober"), "parent": F.lit(None).cast("string")}).select(*columns))
    )


def ordered_labels(labels: DataFrame, order: list[str]) -> DataFrame:
    """Distinct labels per product in the order they were added."""
    first = labels.groupBy("product_key", "label").agg(F.min(F.struct(*order)).alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", "label")))
    return first.groupBy("product_key").agg(F.array_join(F.transform(listed, lambda x: x["label"]), "|").alias("labels"))
