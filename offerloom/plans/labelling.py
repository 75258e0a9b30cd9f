"""Queries over the taxonomy builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import labels as lb
from offerloom.plans.clean import _pick, _pick_sql
from offerloom.plans.registry import query
from offerloom.plans.sqltext import norm_sql
from offerloom.plans.views import VIEWS, Tables

FRONT = ["", "Frische ", "Bio ", "Unsere ", "H-Milch ", "XXL ", "Original ", "Bis zu 20 ", "Rabatt "]
BACK = ["", " Natur", " classic", " Steaks", " 1,5% Fett", " mariniert pikant", " filets", " Butter", " Coupon", " Vollmilch", " Kaese", " Buttertoast"]
SUB_MERGES = [("brand#3", "Brand#4"), ("brand#7", "Brand#8"), ("brand#9", "Brand#4")]
PARENT_MOVES = [("small", "brand#4", "LARGE"), ("promo", "brand#5", "MEDIUM")]
MANUAL_SPLITS = [("standard", ["stand", "ard"])]

_STRIP = norm_sql("product_name")
for _p in lb.PREFIXES:
    _STRIP = f"trim(regexp_replace({_STRIP}, '^{_p}', ''))"
for _p in lb.SUFFIXES:
    _STRIP = f"trim(regexp_replace({_STRIP}, '{_p}', ''))"
for _p, _r in lb.REWORDINGS:
    _STRIP = "regexp_replace(" + _STRIP + f", '{_p}', '" + _r.replace("$1", "\\1") + "', 'g')"
_KEY = f"regexp_replace(trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')), '(filet|steak)s$', '\\1')"

VIEWS["shop_names"] = f"SELECT {_pick_sql(FRONT, 'p_partkey')} || p_name || {_pick_sql(BACK, 'p_size')} AS product_name, count(*) AS n FROM part GROUP BY 1"
VIEWS["grouped_names"] = f"SELECT product_name, n, nn, {_KEY} AS key FROM (SELECT *, {norm_sql('product_name')} AS nn FROM shop_names) WHERE NOT (nn = '' OR nn IN ('original', '10 rabatt', '15', '20 rabatt') OR starts_with(nn, 'rabatt') OR starts_with(nn, 'bis zu ') OR starts_with(nn, 'gutschein') OR starts_with(nn, 'guthabenkarte') OR starts_with(nn, 'coupon') OR contains(nn, ' rabatt'))"


def shop_names(t: Tables):
    """Product names as shops print them, with how often."""
    name = F.concat(_pick(FRONT, "p_partkey"), "p_name", _pick(BACK, "p_size"))
    return t.read("part").groupBy(name.alias("product_name")).agg(F.count(F.lit(1)).alias("n"))


@query("bld8_grouping_key", "SELECT product_name, key FROM grouped_names")
def _(t: Tables):
    kept = shop_names(t).where(~lb.is_no_product(F.col("product_name")))
    return kept.select("product_name", lb.grouping_key(F.col("product_name")).alias("key"))


@query("bld9_no_products", "SELECT product_name FROM shop_names WHERE product_name NOT IN (SELECT product_name FROM grouped_names)")
def _(t: Tables):
    return shop_names(t).where(lb.is_no_product(F.col("product_name"))).select("product_name")


VIEWS["canonical_names"] = "SELECT key, arg_min(product_name, (CASE WHEN nn <> key THEN 1 ELSE 0 END, length(product_name), -n, product_name)) AS canonical, count(*) AS products, sum(n)::BIGINT AS offers_n FROM grouped_names WHERE key <> '' GROUP BY key"


@query("bld10_canonical_names", "SELECT key, canonical, products, offers_n FROM canonical_names")
def _(t: Tables):
    return lb.canonical_names(shop_names(t)).withColumnRenamed("offers", "offers_n")


_HEAD = " ".join(f"WHEN suffix(jn, '{h[0]}') OR contains(' ' || nn || ' ', ' {h[0]} ') THEN {{'t': '{h[1]}', 'p': '{h[2]}', 'g': '{h[3]}'}}" for h in lb.HEADS)
_OVER = " ".join(f"WHEN contains(jn, '{o[0]}') THEN {{'t': '{o[1]}', 'p': '{o[2]}', 'g': '{o[3]}', 's': '{o[4]}', 'c': {o[6]}::DOUBLE}}" for o in lb.OVERRIDES)
_SCOPE = "CASE WHEN regexp_matches(nn, '\\d') THEN 'exact' WHEN nn = lower(h.t) THEN 'broad' WHEN g IN ('hmilch', 'haltbare_milch') THEN 'group' WHEN contains(nn, 'filet') OR contains(nn, 'curry') THEN 'exact' ELSE 'group' END"
VIEWS["classified"] = f"""
SELECT canonical, coalesce(o.t, h.t, canonical) AS product_type, coalesce(o.p, h.p, 'Sonstige') AS parent_category, coalesce(o.g, g) AS semantic_group,
 coalesce(o.s, CASE WHEN h IS NULL THEN 'exact' ELSE {_SCOPE} END) AS search_scope, coalesce(o.c, CASE WHEN h IS NULL THEN 0.55 WHEN h.t = 'Milch' THEN 0.92 WHEN h.t = 'Butter' THEN 0.94 ELSE 0.86 END::DOUBLE) AS confidence
FROM (SELECT *, CASE WHEN h.t = 'Milch' THEN CASE WHEN contains(nn, 'h milch') OR contains(jn, 'hmilch') THEN 'hmilch' WHEN contains(nn, 'haltbare milch') THEN 'haltbare_milch' ELSE 'trinkmilch' END ELSE coalesce(h.g, nn) END AS g
 FROM (SELECT *, CASE {_OVER} END AS o, CASE {_HEAD} END AS h FROM (SELECT canonical, {norm_sql('canonical')} AS nn, replace({norm_sql('canonical')}, ' ', '') AS jn FROM canonical_names)))"""


@query("bld11_rule_classification", "SELECT canonical, product_type, parent_category, semantic_group, search_scope, confidence FROM classified")
def _(t: Tables):
    return lb.classify(lb.canonical_names(shop_names(t)), "canonical").drop("ingredients")


@query(
    "bld11_attributes",
    f"""SELECT canonical, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(n, '\\bbio\\b') THEN 'bio=true' END, CASE WHEN regexp_matches(n, '\\bdemeter\\b') THEN 'demeter=true' END,
 CASE WHEN regexp_matches(n, '\\blaktosefrei\\b') THEN 'laktosefrei=true' END, CASE WHEN regexp_matches(n, '\\bh milch\\b|\\bhmilch\\b|\\bhaltbare?\\b') THEN 'haltbar=true' END,
 CASE WHEN regexp_matches(n, '\\b3 5\\b') THEN 'fett=3.5' WHEN regexp_matches(n, '\\b1 5\\b') THEN 'fett=1.5' END], lambda x: x IS NOT NULL)), ',') AS attributes
FROM (SELECT canonical, {norm_sql('canonical')} AS n FROM canonical_names)""",
)
def _(t: Tables):
    return lb.canonical_names(shop_names(t)).select("canonical", F.array_join(lb.attributes(F.col("canonical")), ",").alias("attributes"))


@query("bld12_category_of_names", "SELECT g.product_name, c.canonical FROM shop_names s JOIN grouped_names g USING (product_name) JOIN canonical_names c USING (key)")
def _(t: Tables):
    names = shop_names(t)
    keyed = names.where(~lb.is_no_product(F.col("product_name"))).select("product_name", lb.grouping_key(F.col("product_name")).alias("key"))
    return keyed.join(lb.canonical_names(names).select("key", "canonical"), "key").select("product_name", "canonical")


@query(
    "bld13_family_tree",
    f"""WITH r AS (SELECT c.canonical AS name, n.offers_n AS products_n, {norm_sql('c.product_type')} AS tn, {norm_sql('c.canonical')} = {norm_sql('c.product_type')} AND c.search_scope IN ('broad', 'group') AS fam
 FROM classified c JOIN canonical_names n USING (canonical))
SELECT r.name, CASE WHEN fam THEN 'family' ELSE 'category' END AS kind, CASE WHEN NOT fam THEN x.family_name END AS parent, products_n, CASE WHEN fam THEN x.total ELSE products_n END AS expanded
FROM r JOIN (SELECT tn, sum(products_n)::BIGINT AS total, min(CASE WHEN fam THEN name END) AS family_name FROM r GROUP BY tn) x USING (tn)""",
)
def _(t: Tables):
    names = lb.canonical_names(shop_names(t))
    rows = lb.classify(names, "canonical").join(names.select("canonical", "offers"), "canonical").withColumnRenamed("canonical", "name")
    return lb.family_tree(rows).withColumnRenamed("offers", "products_n")


def _results(t: Tables):
    """Classification answers, one per product name and brand."""
    part = t.read("part").groupBy("p_name", "p_brand").agg(F.min("p_type").alias("ok"))
    return part.select(F.concat_ws(" ", "p_name", "p_brand").alias("product_name"), "ok", F.lower("p_brand").alias("uk"), "p_name", "p_brand")


_MERGED_CASE = "CASE lower(p_brand) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SUB_MERGES) + " ELSE p_brand END"
VIEWS["merged_results"] = f"""
SELECT product_name, p_name, p_brand, sub, CASE {' '.join(f"WHEN lower(ok) = '{a}' AND lower(sub) = '{b}' THEN '{c}'" for a, b, c in PARENT_MOVES)} ELSE ok END AS parent
FROM (SELECT p_name || ' ' || p_brand AS product_name, p_name, p_brand, min(p_type) AS ok, {_MERGED_CASE} AS sub FROM part GROUP BY p_name, p_brand)"""
VIEWS["two_levels"] = """
SELECT DISTINCT 1 AS level, lower(parent) AS key, parent AS name, NULL::VARCHAR AS parent_key FROM merged_results
UNION ALL SELECT DISTINCT 2, lower(parent) || '/' || lower(sub), sub, lower(parent) FROM merged_results"""


def merged(t: Tables):
    return lb.apply_merges(_results(t), SUB_MERGES, PARENT_MOVES)


@query("bld14_label_taxonomy", "SELECT level, key, name, parent_key FROM two_levels")
def _(t: Tables):
    return lb.two_levels(merged(t))


@query(
    "bld15_product_category",
    """SELECT product_name, coalesce(e.key, s.key, p.key) AS key FROM merged_results m LEFT JOIN (SELECT key FROM two_levels WHERE level = 2 AND name <> 'Brand#11' AND key NOT LIKE 'small/%') e ON e.key = lower(m.parent) || '/' || lower(m.sub)
 LEFT JOIN (SELECT lower(name) AS sk, min(key) AS key FROM two_levels WHERE level = 2 AND name <> 'Brand#11' AND key NOT LIKE 'small/%' GROUP BY lower(name)) s ON s.sk = lower(m.sub)
 LEFT JOIN (SELECT key FROM two_levels WHERE level = 1) p ON p.key = lower(m.parent)""",
)
def _(t: Tables):
    """Products placed in a taxonomy that lost one brand and the subs of one parent."""
    tree = lb.two_levels(merged(t)).where("level = 1 OR (name <> 'Brand#11' AND NOT key LIKE 'small/%')")
    return lb.product_category(merged(t), tree)


VIEWS["label_rows"] = """
SELECT product_name, unnest(string_split(p_name, ' ')) AS label, 'suchbegriff' AS label_type FROM merged_results
UNION ALL SELECT product_name, replace(p_name, ' ', ''), 'suchbegriff' FROM merged_results
UNION ALL SELECT product_name, lower(p_brand), 'marke' FROM merged_results UNION ALL SELECT product_name, lower(parent), 'gattung' FROM merged_results"""


def label_rows(t: Tables):
    terms = F.concat(F.split("p_name", " "), F.array(F.replace("p_name", F.lit(" ")), F.lit(" ")))
    return lb.label_rows(merged(t).select("product_name", terms.alias("terms"), F.col("p_brand").alias("brand"), F.col("parent").alias("generic")))


@query("bld16_search_labels", "SELECT product_name, label, label_type FROM label_rows")
def _(t: Tables):
    return label_rows(t)


@query(
    "bld17_decomposed_labels",
    """WITH v AS (SELECT DISTINCT label FROM label_rows WHERE length(label) >= 3), w AS (SELECT DISTINCT product_name, label FROM label_rows WHERE NOT contains(label, ' ') AND length(label) >= 8),
s AS (SELECT label, min(i) AS cut_at FROM (SELECT label, unnest(range(3, length(label) - 2)) AS i FROM (SELECT DISTINCT label FROM w WHERE label <> 'standard'))
 WHERE substr(label, 1, i::BIGINT) IN (SELECT label FROM v) AND substr(label, i::BIGINT + 1) IN (SELECT label FROM v) GROUP BY label)
SELECT product_name, unnest(CASE WHEN w.label = 'standard' THEN ['stand', 'ard'] ELSE [substr(w.label, 1, cut_at::BIGINT), substr(w.label, cut_at::BIGINT + 1)] END) AS label FROM w LEFT JOIN s USING (label) WHERE w.label = 'standard' OR cut_at IS NOT NULL""",
)
def _(t: Tables):
    return lb.decompose(label_rows(t), MANUAL_SPLITS)


VIEWS["placed_products"] = "SELECT product_name, lower(parent) || '/' || lower(sub) AS key FROM merged_results"


@query(
    "bld18_category_counts",
    "SELECT key, count(*) AS n FROM placed_products GROUP BY key UNION ALL SELECT split_part(key, '/', 1), count(*) FROM placed_products GROUP BY split_part(key, '/', 1)",
)
def _(t: Tables):
    tree = lb.two_levels(merged(t))
    sub = lb.product_category(merged(t), tree).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    top = sub.join(tree.where("level = 2").select("key", "parent_key"), "key").groupBy(F.col("parent_key").alias("key")).agg(F.sum("n").alias("n"))
    return sub.unionByName(top)


@query("bld19_remapped_offers", "SELECT o.offer_id, coalesce(p.key, o.own_category_id) AS category FROM unique_offers o LEFT JOIN placed_products p ON p.product_name = o.product_key")
def _(t: Tables):
    placed = lb.product_category(merged(t), lb.two_levels(merged(t))).withColumnRenamed("product_name", "product_key")
    return t.offers.select("offer_id", "product_key", "own_category_id").join(placed, "product_key", "left").select("offer_id", F.coalesce("key", "own_category_id").alias("category"))


@query(
    "bld20_regrouped_tree",
    """WITH c AS (SELECT split_part(p_type, ' ', 1) AS ober, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2),
m AS (SELECT ober, CASE split_part(name, ' ', 1) WHEN 'new' THEN 'hot ' || split_part(name, ' ', 2) WHEN 'old' THEN 'hot ' || split_part(name, ' ', 2) ELSE name END AS name, n FROM c),
l AS (SELECT ober, name, sum(n)::BIGINT AS n FROM m GROUP BY ober, name),
k AS (SELECT l.ober, l.name, n, CASE WHEN p.name IS NOT NULL THEN split_part(l.name, ' ', 2) ELSE 'sonstiges/' || l.ober END AS parent FROM l
  LEFT JOIN (SELECT DISTINCT split_part(p_type, ' ', 1) AS ober, p_name AS name FROM part WHERE split_part(p_name, ' ', 2) IN ('bolt', 'ring', 'gear')) p ON p.ober = l.ober AND p.name = l.name),
h AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS ober, split_part(p_name, ' ', 2) AS name FROM part WHERE split_part(p_name, ' ', 2) IN ('bolt', 'ring', 'gear')),
g AS (SELECT ober, name, coalesce(n, 0)::BIGINT AS n FROM h FULL JOIN (SELECT ober, parent AS name, sum(n)::BIGINT AS n FROM k GROUP BY ober, parent) USING (ober, name))
SELECT ober, name, 3 AS level, parent, n FROM k UNION ALL SELECT ober, name, 2, ober, n FROM g UNION ALL SELECT ober, ober, 1, NULL, sum(n)::BIGINT FROM g GROUP BY ober""",
)
def _(t: Tables):
    """Names grouped by noun under each kind of product; "new" merges into "old" and "old" into "hot"; some nouns have no group."""
    noun, ober = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("ober")
    part = t.read("part")
    names = part.groupBy(ober, F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    chain = lambda a, b: F.struct(F.concat(F.lit(a + " "), noun).alias("source"), F.concat(F.lit(b + " "), noun).alias("target"))
    merges = part.select(F.explode(F.array(chain("new", "old"), chain("old", "hot"))).alias("m")).select("m.*").distinct()
    groups = part.where(noun.isin("bolt", "ring", "gear")).select(ober, noun.alias("group"), F.col("p_name").alias("child")).distinct()
    return lb.regroup(names.select("ober", "name", "n"), merges, groups)


@query("bld21_rejected_labels", "SELECT product_key, label, label_type FROM search_labels WHERE NOT (label = 'red' OR (label_type = 'marke' AND length(label) = 7))")
def _(t: Tables):
    rejected = t.search_labels.where("label = 'red' OR (label_type = 'marke' AND length(label) = 7)").select("product_key", "label").distinct()
    return t.search_labels.join(rejected, ["product_key", "label"], "left_anti")


@query(
    "bld22_ordered_labels",
    "SELECT product_key, string_agg(label, '|' ORDER BY o, label) AS labels FROM (SELECT product_key, label, min(label_type) AS o FROM search_labels GROUP BY product_key, label) GROUP BY product_key",
)
def _(t: Tables):
    return lb.ordered_labels(t.search_labels, ["label_type"])
