"""Queries over category search and spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import categories as cat
from offerloom.plans.places import reach
from offerloom.plans.registry import query
from offerloom.plans.reports import category_counts
from offerloom.plans.sqltext import norm_sql
from offerloom.plans.texts import phrases
from offerloom.plans.views import VIEWS, Tables
from offerloom.session import cut_lineage

_NAME = norm_sql("lower(name)")
_Q = "regexp_replace(v, '([.\\[\\]{}()*+?^$|\\\\])', '\\\\\\1', 'g')"


def _label_score_sql() -> str:
    return """(CASE WHEN label = v THEN 140 WHEN len(qt) > 1 AND common = len(qt) AND len(lt) = len(qt) THEN 135 WHEN common = len(qt) AND len(lt) = len(qt) THEN 130
 WHEN common = len(qt) THEN greatest(60, 95 - (len(lt) - len(qt)) * 15) WHEN starts_with(v, label || ' ') THEN 90 WHEN len(qt) = 1 AND len(lt) = 1 AND starts_with(label, v) THEN 85
 WHEN contains(label, v) THEN 50 WHEN contains(v, label) THEN 55 WHEN common > 0 THEN 40 + common * 5 ELSE 20 END + CASE label_type WHEN 'gattung' THEN 5 WHEN 'marke' THEN 15 ELSE 0 END)"""


def _either(test: str) -> str:
    return "(" + test.replace("@", "nn") + " OR " + test.replace("@", "lower(name)") + ")"


_TIER = f"""(CASE WHEN {_either('@ = v')} THEN 1 WHEN {_either(f"regexp_matches(@, '^' || {_Q} || '($|[ \\-&/,])')")} THEN 2
 WHEN {_either('starts_with(@, v)')} AND length(v) >= 5 THEN 2 WHEN {_either(f"regexp_matches(@, '(^|[ \\-&/,])' || {_Q} || '($|[ \\-&/,])')")} THEN 3
 WHEN {_either('contains(@, v)')} THEN CASE WHEN {_either("len(list_filter(string_split(@, ' '), lambda w: suffix(w, v) AND length(w) >= length(v) + 3)) > 0")} THEN 2 ELSE 4 END ELSE 5 END)"""

VIEWS["phrase_variants"] = f"SELECT q, {norm_sql('q')} AS v FROM phrases UNION SELECT q, lower(trim(q)) FROM phrases UNION SELECT q, replace(v, 'ue', 'ü') FROM (SELECT q, {norm_sql('q')} AS v FROM phrases UNION SELECT q, lower(trim(q)) FROM phrases) WHERE contains(v, 'ue')"
VIEWS["label_counts"] = "SELECT l.category_id, s.label, s.label_type, count(*) AS n FROM search_labels s JOIN product_labels l USING (product_key) GROUP BY ALL"
VIEWS["label_prefix"] = f"""
SELECT x.q, x.v, h.label FROM phrase_variants x JOIN (SELECT v, label FROM (SELECT DISTINCT f.v, f.n_tokens, f.token_no, p.label FROM (
  SELECT v, len(tk) AS n_tokens, unnest(range(len(tk))) AS token_no, unnest(tk) AS token FROM (SELECT v, string_split({norm_sql('v')}, ' ') AS tk FROM (SELECT DISTINCT v FROM phrase_variants))) f0
  JOIN (SELECT token, unnest(forms) AS form FROM (SELECT token, @FORMS@ AS forms FROM (SELECT DISTINCT unnest(string_split({norm_sql('v')}, ' ')) AS token FROM phrase_variants))) g USING (token)
  JOIN (SELECT label, unnest(string_split({norm_sql('label')}, ' ')) AS token FROM (SELECT DISTINCT label FROM search_labels)) p ON starts_with(p.token, g.form)
  CROSS JOIN LATERAL (SELECT f0.v AS v, f0.n_tokens AS n_tokens, f0.token_no AS token_no) f) GROUP BY v, label HAVING count(*) = max(n_tokens)) h ON h.v = x.v"""
from offerloom.plans.clean import token_forms_sql  # noqa: E402

VIEWS["label_prefix"] = VIEWS["label_prefix"].replace("@FORMS@", token_forms_sql("token"))
VIEWS["label_found"] = """
SELECT q, v, label FROM label_prefix UNION SELECT x.q, x.v, d.label FROM phrase_variants x JOIN (SELECT DISTINCT label FROM search_labels) d ON contains(d.label, x.v)
WHERE x.q NOT IN (SELECT q FROM label_prefix JOIN label_counts USING (label) GROUP BY q HAVING count(DISTINCT category_id) >= 3)"""
VIEWS["label_scored"] = f"""
SELECT *, {_label_score_sql()} AS raw, {_TIER} AS tier FROM (SELECT f.q, f.v, f.label, k.label_type, k.n, c.category_id, c.name, {norm_sql('lower(c.name)')} AS nn,
 list_distinct(string_split(f.v, ' ')) AS qt, list_distinct(string_split(f.label, ' ')) AS lt, len(list_intersect(list_distinct(string_split(f.v, ' ')), list_distinct(string_split(f.label, ' ')))) AS common
 FROM label_found f JOIN label_counts k USING (label) JOIN categories c ON c.category_id = k.category_id)"""
VIEWS["cat_scores"] = """
SELECT q, category_id, max(least(greatest(raw, CASE tier WHEN 1 THEN 200 WHEN 2 THEN 155 WHEN 3 THEN 125 WHEN 4 THEN 85 ELSE least(20 + floor(raw * 0.55::DOUBLE)::INT, 80) END),
 CASE tier WHEN 1 THEN 200 WHEN 2 THEN 170 WHEN 3 THEN 140 WHEN 4 THEN 100 ELSE 80 END)) AS score, sum(n)::BIGINT AS hits, min(tier) AS tier FROM label_scored GROUP BY q, category_id"""
VIEWS["multi_scores"] = f"""
SELECT q, category_id, products, CASE WHEN contains({_NAME}, array_to_string(tk, ' ')) OR contains(lower(name), array_to_string(tk, ' ')) THEN 170
 WHEN len(list_filter(tk, lambda w: contains({_NAME}, w) OR contains(lower(name), w))) > 0 THEN 140 ELSE 80 END AS score FROM (
 SELECT q, tk, category_id, count(*) AS products FROM (SELECT q, tk, product_key FROM (SELECT DISTINCT a.q, a.tk, a.token_no, s.product_key FROM (
  SELECT q, tk, unnest(range(len(tk))) AS token_no, unnest(tk) AS token FROM (SELECT q, string_split({norm_sql('q')}, ' ') AS tk FROM phrases) WHERE len(tk) BETWEEN 2 AND 5) a
  JOIN search_labels s ON contains(s.label, a.token)) GROUP BY q, tk, product_key HAVING count(*) = len(tk)) JOIN product_labels USING (product_key) GROUP BY q, tk, category_id)
JOIN categories USING (category_id)"""
VIEWS["all_scores"] = """
SELECT q, category_id, max(score) AS score, sum(hits)::BIGINT AS hits, min(tier) AS tier FROM (SELECT * FROM cat_scores
 UNION ALL SELECT q, category_id, score, 1, CASE score WHEN 170 THEN 2 WHEN 140 THEN 3 ELSE 5 END FROM multi_scores) GROUP BY q, category_id"""
VIEWS["rolled_scores"] = """
SELECT q, category_id, score, hits, tier FROM all_scores UNION ALL
SELECT s.q, c.parent_id, greatest(max(score) - 15, CASE least(min(tier) + 1, 5) WHEN 2 THEN 155 WHEN 3 THEN 125 WHEN 4 THEN 85 ELSE 50 END), sum(hits)::BIGINT, least(min(tier) + 1, 5)
FROM all_scores s JOIN categories c ON c.category_id = s.category_id AND c.level = 3 GROUP BY s.q, c.parent_id"""
VIEWS["ranked_cats"] = """
SELECT q, category_id, name, level, ober, score, hits, tier, n, row_number() OVER (PARTITION BY q ORDER BY tier, score // 5 + floor(log2(greatest(1, hits))) DESC, n DESC, hits DESC, category_id) AS rank
FROM (SELECT s.*, c.name, c.level, k.n, split_part(c.category_id, '/', 1) AS ober, max(s.score) OVER (PARTITION BY s.q) AS best FROM rolled_scores s JOIN categories c USING (category_id)
 JOIN category_counts k ON k.category_id = s.category_id WHERE NOT (k.n <= 2 AND s.score < 140))
WHERE score >= greatest(floor(best * 0.65::DOUBLE), 50) AND (best < 155 OR score >= 85 OR n >= 20) AND (best >= 100 OR n >= 3 OR score >= 80)"""
VIEWS["merged_cats"] = f"""
SELECT q, min(rank) AS rank, CASE WHEN max(level) FILTER (level = 2) = 2 THEN arg_min(category_id, rank) FILTER (level = 2) ELSE arg_min(category_id, rank) END AS category_id,
 CASE WHEN max(level) FILTER (level = 2) = 2 THEN arg_min(ober, rank) FILTER (level = 2) ELSE arg_min(ober, rank) END AS ober,
 CASE WHEN max(level) FILTER (level = 2) = 2 THEN greatest(arg_min(n, rank) FILTER (level = 2), coalesce(sum(n) FILTER (level = 3 AND rank < g), 0)) + sum(n) FILTER (level = 2) - arg_min(n, rank) FILTER (level = 2)
  ELSE sum(n) END::BIGINT AS n
FROM (SELECT *, min(rank) FILTER (level = 2) OVER (PARTITION BY q, name_key) AS g FROM (SELECT *, array_to_string(list_sort(string_split({norm_sql('name')}, ' ')), ' ') AS name_key FROM ranked_cats))
GROUP BY q, name_key"""


def found(t: Tables):
    """(label hits, label counts) of every phrase."""
    counts = cat.label_counts(t.search_labels, t.product_labels)
    return cat.label_hits(cat.query_variants(phrases(t)), counts), counts


def scores(t: Tables):
    return cat.suggest(phrases(t), t.search_labels, t.product_labels, t.categories)


def ranked(t: Tables):
    return cat.rank_categories(scores(t), t.categories, category_counts(t))


@query("cat1_label_score", "SELECT DISTINCT q, v, label, label_type, raw AS score FROM label_scored")
def _(t: Tables):
    hits, counts = found(t)
    rows = hits.join(counts.select("label", "label_type").distinct(), "label")
    return rows.select("q", "v", "label", "label_type", cat.label_score(F.col("v"), F.col("label"), F.col("label_type")).alias("score"))


@query("cat2_match_tier", "SELECT DISTINCT v, name, tier FROM label_scored")
def _(t: Tables):
    hits, counts = found(t)
    named = hits.join(counts, "label").join(t.categories.select("category_id", "name"), "category_id").select("v", "name").distinct()
    return named.select("v", "name", cat.match_tier(F.col("v"), F.col("name")).alias("tier"))


@query("cat3_category_scores", "SELECT q, category_id, score, hits, tier FROM cat_scores")
def _(t: Tables):
    hits, counts = found(t)
    return cat.category_scores(hits, counts, t.categories)


@query("cat4_label_retrieval", "SELECT q, v, label FROM label_found")
def _(t: Tables):
    return found(t)[0]


@query("jn9_label_intersection", "SELECT q, category_id, products FROM multi_scores")
def _(t: Tables):
    return cat.multi_token_scores(phrases(t), t.search_labels, t.product_labels, t.categories).select("q", "category_id", "products")


@query("cat5_group_rollup", "SELECT q, category_id, score, hits, tier FROM rolled_scores")
def _(t: Tables):
    return scores(t)


@query("cat6_multi_token_score", "SELECT q, category_id, score FROM multi_scores")
def _(t: Tables):
    return cat.multi_token_scores(phrases(t), t.search_labels, t.product_labels, t.categories).select("q", "category_id", "score")


@query("cat7_ranking", "SELECT q, category_id, score, hits, tier, n, rank FROM ranked_cats")
def _(t: Tables):
    return ranked(t).select("q", "category_id", "score", "hits", "tier", "n", "rank")


@query("cat8_name_dedup", "SELECT q, rank, category_id, n FROM merged_cats")
def _(t: Tables):
    return cat.merge_same_names(ranked(t)).select("q", "rank", "category_id", "n")


@query(
    "cat9_diversity",
    """SELECT q, category_id, position FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY q, ober ORDER BY rank) AS place, (SELECT count(DISTINCT m.ober) FROM merged_cats m WHERE m.q = x.q) AS obers FROM merged_cats x)
 WHERE place <= CASE WHEN obers >= 3 THEN 2 ELSE 4 END) WHERE position <= 8""",
)
def _(t: Tables):
    return cat.diversify(cat.merge_same_names(ranked(t)), 8).select("q", "category_id", "position")


@query(
    "cat10_brand_search",
    f"""SELECT q, marke, products, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, products DESC, marke) AS rank FROM (
 SELECT q, marke, products, CASE WHEN starts_with(w, lower(q)) THEN 1 ELSE 2 END AS tier FROM (SELECT DISTINCT p_brand AS q FROM part UNION SELECT DISTINCT {norm_sql("p_brand")} FROM part UNION SELECT 'brand') b
 JOIN (SELECT marke, replace(lower(marke), '-', ' ') AS w, count(*) AS products FROM product_labels GROUP BY marke HAVING count(*) >= 2) m
 ON starts_with(w, replace(lower(q), '-', ' ')) OR contains(w, {norm_sql('q')}))) WHERE rank <= 3""",
)
def _(t: Tables):
    from offerloom.functions.text import normalize_search_text

    brand = t.read("part").select("p_brand").distinct()
    asked = brand.select(F.explode(F.array(F.col("p_brand"), normalize_search_text(F.col("p_brand")), F.lit("brand"))).alias("q")).distinct()
    return cat.search_brands(asked, t.product_labels, 3)


VIEWS["spell_terms"] = """
SELECT term, sum(freq)::BIGINT AS freq FROM (
 SELECT unnest(list_filter(string_split(lower(name), ' '), lambda w: length(w) >= 3)) AS term, 1 AS freq FROM categories WHERE level = 2
 UNION ALL SELECT lower(name), 1 FROM categories WHERE level = 2 AND contains(name, ' ')
 UNION ALL SELECT lower(trim(label)), freq FROM (SELECT label, count(*) AS freq FROM search_labels WHERE label_type IN ('suchbegriff', 'gattung') GROUP BY label)
  WHERE length(trim(label)) >= 3) GROUP BY term"""


@query("bld23_spelling_terms", "SELECT term, freq FROM spell_terms")
def _(t: Tables):
    return cat.spelling_terms(t.search_labels, t.categories)


@query(
    "cat11_spell_correction",
    """SELECT token, arg_min(term, (d, -shared, -freq, term)) AS term, min(d) AS dist FROM (SELECT token, term, freq, levenshtein(token, term) AS d,
 len(list_filter(range(1, length(term) + 1), lambda n: starts_with(token, substr(term, 1, n::BIGINT)))) AS shared
 FROM (SELECT DISTINCT unnest(string_split(lower(q), ' ')) AS token FROM phrases) JOIN spell_terms ON levenshtein(token, term) <= 2) GROUP BY token""",
)
def _(t: Tables):
    asked = phrases(t).select(F.explode(F.split(F.lower("q"), " ")).alias("token")).distinct()
    return cat.correct_words(asked, cat.spelling_terms(t.search_labels, t.categories))


@query("cat12_correction_gate")
def _(t: Tables):
    """Suggestions for whole phrases, every word corrected where the correction scores better."""
    return cat.suggest_with_correction(phrases(t), t.search_labels, t.product_labels, t.categories)


VIEWS["place_requests"] = "SELECT DISTINCT l_suppkey AS location_id, p_name AS q FROM lineitem JOIN part ON l_partkey = p_partkey"
VIEWS["local_cats"] = """
SELECT location_id, q, category_id, score, n, row_number() OVER (PARTITION BY location_id, q ORDER BY tier, score // 5 + floor(log2(greatest(1, hits))) DESC, n DESC, hits DESC, category_id) AS rank
FROM (SELECT s.*, r.location_id, k.offers AS n, max(s.score) OVER (PARTITION BY r.location_id, s.q) AS best FROM place_requests r JOIN rolled_scores s ON s.q = r.q JOIN categories c ON c.category_id = s.category_id
 JOIN scope_counts k ON k.location_id = r.location_id AND k.category_id = s.category_id WHERE NOT (k.offers <= 2 AND s.score < 140))
WHERE score >= greatest(floor(best * 0.65::DOUBLE), 50) AND (best < 155 OR score >= 85 OR n >= 20) AND (best >= 100 OR n >= 3 OR score >= 80)"""


@query(
    "cat13_local_counts",
    """SELECT location_id, q, category_id, score, n::BIGINT AS n, rank, 0 AS not_local FROM local_cats WHERE rank <= 8
UNION ALL SELECT r.location_id, r.q, g.category_id, g.score, g.n::BIGINT, g.rank, 1 FROM place_requests r JOIN ranked_cats g ON g.q = r.q
WHERE g.rank <= 5 AND NOT EXISTS (SELECT 1 FROM local_cats l WHERE l.location_id = r.location_id AND l.q = r.q)""",
)
def _(t: Tables):
    """Product names asked at every place: hits ranked by the offers around it, else the national hits, marked."""
    from offerloom.operators.scope import Scope

    near, places = reach(t)
    scope = Scope(*near, t.offers, *places)
    asked = t.read("lineitem").select("l_partkey", F.col("l_suppkey").alias("location_id")).join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    requests = cut_lineage(asked.select("location_id", F.col("p_name").alias("q")).distinct().join(scope.leaders, "location_id", "left"))
    found = scores(t)
    wanted = requests.where("leader IS NOT NULL").select("leader", "q").distinct()
    counts = scope.category_counts(t.categories).withColumnRenamed("offers", "n")
    local = cut_lineage(cat.rank_categories(found.join(wanted, "q"), t.categories, counts, ("leader", "q")))
    national = cat.rank_categories(found, t.categories, category_counts(t))
    return cat.local_or_national(requests, local, national).drop("leader")


VIEWS["place_categories"] = "SELECT DISTINCT l_suppkey AS location_id, p_type || '/' || p_brand || '/' || p_name AS category_id FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(
    "tax3_local_siblings",
    """SELECT r.location_id, s.category_id, s.sibling_id, k.offers AS n FROM place_categories r JOIN siblings s ON s.category_id = r.category_id
JOIN scope_counts k ON k.location_id = r.location_id AND k.category_id = s.sibling_id
QUALIFY row_number() OVER (PARTITION BY r.location_id, s.category_id ORDER BY k.offers DESC, s.sibling_id) <= 6""",
)
def _(t: Tables):
    """Siblings with offers around a place, by those offers, for the categories asked there."""
    from offerloom.operators import taxonomy
    from offerloom.operators.scope import Scope

    near, places = reach(t)
    scope = Scope(*near, t.offers, *places)
    part = t.read("part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand", "p_name").alias("category_id"))
    asked = t.read("lineitem").select("l_partkey", F.col("l_suppkey").alias("location_id")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    requests = asked.select("location_id", "category_id").distinct().join(scope.leaders, "location_id")
    counts = scope.category_counts(t.categories).withColumnRenamed("offers", "n")
    return taxonomy.local_siblings(requests, t.categories, category_counts(t), counts, 6).drop("leader")
