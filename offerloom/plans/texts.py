"""Queries over text retrieval and matching."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions.numbers import discount_percent, round_to, round_to_sql
from offerloom.functions.text import normalize_text
from offerloom.operators import scoring, search, typos
from offerloom.plans.clean import token_forms_sql
from offerloom.plans.registry import query
from offerloom.plans.sqltext import base_vowel_sql, norm_sql
from offerloom.plans.views import VIEWS, Tables
from offerloom.session import cut_lineage

# Misspellings put into the last word of product names.
TYPOS = [("gizmo", "gizzmo"), ("widget", "widgt"), ("plate", "plade"), ("anvil", "anvul")]

_TYPO_SQL = "p_name"
for _a, _b in TYPOS:
    _TYPO_SQL = f"replace({_TYPO_SQL}, '{_a}', '{_b}')"

VIEWS["phrases"] = f"""
SELECT DISTINCT p_name AS q FROM part UNION SELECT DISTINCT p_brand || ' ' || split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT {_TYPO_SQL} FROM part"""
VIEWS["offer_docs"] = """
SELECT *, coalesce(brand, '') || ' ' || product_name || ' ' || coalesce(description, '') AS search FROM offers"""
VIEWS["tokens_of_offers"] = f"""
SELECT token, offer_id, field, count(*) AS tf FROM (
 SELECT offer_id, 'name' AS field, unnest(string_split({norm_sql('product_name')}, ' ')) AS token FROM offer_docs
 UNION ALL SELECT offer_id, 'brand', unnest(string_split({norm_sql('brand')}, ' ')) FROM offer_docs
 UNION ALL SELECT offer_id, 'description', unnest(string_split({norm_sql('description')}, ' ')) FROM offer_docs
 UNION ALL SELECT offer_id, 'search', unnest(string_split({norm_sql('search')}, ' ')) FROM offer_docs
 UNION ALL SELECT offer_id, 'chain', unnest(string_split({norm_sql('chain')}, ' ')) FROM offer_docs) WHERE token <> '' GROUP BY token, offer_id, field"""
VIEWS["phrase_forms"] = f"""
SELECT q, n_tokens, token_no, unnest({token_forms_sql('token')}) AS form FROM (
 SELECT q, len(tk) AS n_tokens, unnest(range(len(tk))) AS token_no, unnest(tk) AS token FROM (SELECT q, list_filter(string_split({norm_sql('q')}, ' '), lambda x: x <> '') AS tk FROM phrases))"""


def _boolean_sql(test: str) -> str:
    return f"""SELECT q, offer_id FROM (SELECT DISTINCT f.q, f.n_tokens, f.token_no, p.offer_id FROM (SELECT DISTINCT token FROM tokens_of_offers) v
 JOIN phrase_forms f ON {test} JOIN (SELECT DISTINCT token, offer_id FROM tokens_of_offers) p ON p.token = v.token) GROUP BY q, offer_id HAVING count(*) = max(n_tokens)"""


VIEWS["prefix_hits"] = _boolean_sql("starts_with(v.token, f.form)")
VIEWS["substring_hits"] = _boolean_sql("contains(v.token, f.form)")
VIEWS["ranked_hits"] = """
SELECT m.q, m.offer_id, -sum(greatest(1e-6::DOUBLE, ln((s.n_docs - w.n_with + 0.5::DOUBLE) / (w.n_with + 0.5::DOUBLE))) * d.f * 2.2::DOUBLE
 / (d.f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.avg_dl))) AS score
FROM prefix_hits m JOIN phrase_forms f ON f.q = m.q
JOIN (SELECT form, offer_id, sum(tf * CASE field WHEN 'name' THEN 8::DOUBLE WHEN 'brand' THEN 5::DOUBLE WHEN 'description' THEN 1.5::DOUBLE WHEN 'search' THEN 3::DOUBLE ELSE 0.5::DOUBLE END) AS f
 FROM (SELECT DISTINCT form FROM phrase_forms) x JOIN tokens_of_offers t ON starts_with(t.token, x.form) GROUP BY form, offer_id) d ON d.form = f.form AND d.offer_id = m.offer_id
JOIN (SELECT form, count(DISTINCT offer_id) AS n_with FROM (SELECT DISTINCT form FROM phrase_forms) x JOIN tokens_of_offers t ON starts_with(t.token, x.form) GROUP BY form) w ON w.form = f.form
JOIN (SELECT offer_id, sum(tf) AS dl FROM tokens_of_offers GROUP BY offer_id) l ON l.offer_id = m.offer_id
CROSS JOIN (SELECT count(*)::DOUBLE AS n_docs, avg(dl) AS avg_dl FROM (SELECT offer_id, sum(tf) AS dl FROM tokens_of_offers GROUP BY offer_id)) s
GROUP BY m.q, m.offer_id"""
VIEWS["shown_hits"] = f"""
SELECT h.q, o.offer_id, o.chain, o.product_name, o.brand, o.category_id, o.sales_price, o.regular_price, o.valid_from, o.valid_until, {round_to_sql('-h.score', 6)} AS score
FROM ranked_hits h JOIN offers o USING (offer_id)"""


def phrases(t: Tables):
    part = t.read("part").select("p_name", "p_brand").distinct()
    typo = F.col("p_name")
    for right, wrong in TYPOS:
        typo = F.replace(typo, F.lit(right), F.lit(wrong))
    brand = F.concat_ws(" ", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return part.select(F.explode(F.array("p_name", brand, typo)).alias("q")).distinct()


def search_column(brand="brand", title="product_name", note="description"):
    return F.concat_ws(" ", F.coalesce(brand, F.lit("")), title, F.coalesce(note, F.lit("")))


def index(t: Tables):
    """Postings of the offers, written once because every search step reads them."""
    if "index" not in t.__dict__:
        t.__dict__["index"] = cut_lineage(offer_postings(t))
    return t.__dict__["index"]


def offer_postings(t: Tables):
    columns = {
        "name": F.col("product_name"), "brand": F.col("brand"), "description": F.col("description"), "search": search_column(), "chain": F.col("chain"),
    }
    return search.postings(t.offers, "offer_id", columns)


def shown_hits(t: Tables):
    """Prefix hits with the offer columns and the ranking score turned so that higher is better."""
    ranked = search.bm25(phrases(t), index(t), "offer_id")
    cols = ["offer_id", "chain", "product_name", "brand", "category_id", "sales_price", "regular_price", "valid_from", "valid_until"]
    return ranked.join(t.offers.select(*cols), "offer_id").select("q", *cols, round_to(-F.col("score"), 6).alias("score"))


@query("txt1_offer_postings", "SELECT token, offer_id, field, tf FROM tokens_of_offers")
def _(t: Tables):
    return offer_postings(t)


@query(
    "txt1_document_postings",
    f"SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(string_split({norm_sql('text')}, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token, doc_id",
)
def _(t: Tables):
    return search.postings(t.read("documents"), "doc_id", {"text": F.col("text")}).select("token", "doc_id", "tf")


@query("txt2_prefix_search", "SELECT q, offer_id FROM prefix_hits")
def _(t: Tables):
    return search.prefix_search(phrases(t), index(t), "offer_id")


@query("txt3_bm25", f"SELECT q, offer_id, {round_to_sql('score', 6)} AS score FROM ranked_hits")
def _(t: Tables):
    return search.bm25(phrases(t), index(t), "offer_id").withColumn("score", round_to(F.col("score"), 6))


@query(
    "txt4_candidate_groups",
    """SELECT q, chain, product_name, brand, category_id, min(offer_id) AS offer_id, min(sales_price) AS sales_price, min(regular_price) AS regular_price,
 max(valid_from) AS valid_from, max(valid_until) AS valid_until, max(image_url) AS image_url FROM (SELECT * FROM prefix_hits JOIN offers USING (offer_id)) GROUP BY q, chain, product_name, brand, category_id""",
)
def _(t: Tables):
    found = search.prefix_search(phrases(t), index(t), "offer_id")
    return search.group_candidates(found.join(t.offers, "offer_id"))


@query("txt6_substring_search", "SELECT q, offer_id FROM substring_hits")
def _(t: Tables):
    return search.substring_search(phrases(t), index(t), "offer_id")


VIEWS["typo_windows"] = f"""
SELECT DISTINCT norm, unnest(flatten([[substr(norm, i, n) FOR i IN range(1, length(norm) - n + 2)] FOR n IN range(1, least(length(norm), longest) + 1)])) AS part FROM (SELECT DISTINCT {norm_sql('text')} AS norm FROM typo_texts), (SELECT max(length(form) + k) AS longest FROM typo_forms)"""
VIEWS["typo_texts"] = "SELECT DISTINCT brand || ' ' || product_name AS text FROM offers"
VIEWS["typo_forms"] = "SELECT DISTINCT form, CASE WHEN length(form) < 3 THEN 0 WHEN length(form) < 8 THEN 1 ELSE 2 END AS k FROM phrase_forms"
VIEWS["typo_parts"] = """
SELECT form, part FROM typo_forms JOIN (SELECT DISTINCT part FROM typo_windows) w ON length(part) BETWEEN length(form) - k AND length(form) + k AND levenshtein(form, part) <= k"""
VIEWS["typo_hits"] = f"""
SELECT q, text FROM (SELECT DISTINCT f.q, f.token_no, f.n_tokens, w.norm FROM phrase_forms f JOIN typo_parts USING (form) JOIN typo_windows w USING (part)) h
JOIN (SELECT text, {norm_sql('text')} AS norm FROM typo_texts) t USING (norm) GROUP BY q, text HAVING count(*) = max(n_tokens)"""


def offer_texts(t: Tables):
    """Distinct texts of the offers, written once because the searches read them several times."""
    if "offer_texts" not in t.__dict__:
        t.__dict__["offer_texts"] = cut_lineage(t.offers.select(F.concat_ws(" ", "brand", "product_name").alias("text")).distinct())
    return t.__dict__["offer_texts"]


@query("txt7_typo_search", "SELECT q, text FROM typo_hits")
def _(t: Tables):
    return search.typo_search(phrases(t), offer_texts(t))


def _text_boolean_sql(test: str) -> str:
    return f"""SELECT q, text FROM (SELECT DISTINCT f.q, f.n_tokens, f.token_no, p.text FROM phrase_forms f JOIN (
 SELECT text, unnest(string_split({norm_sql('text')}, ' ')) AS token FROM (SELECT DISTINCT brand || ' ' || product_name AS text FROM offers)) p ON {test})
GROUP BY q, text HAVING count(*) = max(n_tokens)"""


@query(
    "txt5_cascade",
    f"""WITH a AS (SELECT q, text, 1 AS tier FROM ({_text_boolean_sql('starts_with(p.token, f.form)')}) UNION ALL SELECT q, text, 2 FROM ({_text_boolean_sql('contains(p.token, f.form)')}))
SELECT q, text, min(tier) AS tier FROM (SELECT * FROM a UNION ALL SELECT q, text, 3 FROM typo_hits WHERE q NOT IN (SELECT q FROM a)) GROUP BY q, text""",
)
def _(t: Tables):
    texts, q = offer_texts(t), phrases(t)
    docs = search.postings(texts, "text", {"text": F.col("text")})
    return search.cascade(search.prefix_search(q, docs, "text"), search.substring_search(q, docs, "text"), search.typo_search(q, texts), "text")


def _inside_sql(w: str, ow: str) -> str:
    return f"len(list_filter({w}, lambda x: len(list_filter({ow}, lambda y: contains(y, x))) > 0))"


@query(
    "txt8_structure_terms",
    f"""SELECT q, text, len(qw) AS n_words, {_inside_sql('qw', 'ow')} AS n_found, CASE WHEN len(list_filter(qw, lambda x: NOT list_contains(ow, x))) = 0 THEN 1 ELSE 0 END AS exact,
 CASE WHEN contains(lower(text), lower(q)) OR contains({norm_sql('text')}, {norm_sql('q')}) OR contains({base_vowel_sql('text')}, {base_vowel_sql('q')}) THEN 1 ELSE 0 END AS sub
FROM (SELECT q, text, string_split({norm_sql('q')}, ' ') AS qw, string_split({norm_sql('text')}, ' ') AS ow FROM
 (SELECT DISTINCT f.q, d.text FROM phrase_forms f JOIN (SELECT DISTINCT brand || ' ' || product_name AS text FROM offers) d
  ON length(f.token) >= 3 AND contains({norm_sql('d.text')}, f.form)))""".replace(
        "phrase_forms f JOIN",
        f"(SELECT q, token, unnest({token_forms_sql('token')}) AS form FROM (SELECT q, unnest(string_split({norm_sql('q')}, ' ')) AS token FROM phrases)) f JOIN",
    ),
)
def _(t: Tables):
    """Word-level terms of the match score for every pair that shares a word part."""
    pairs = scoring.candidate_pairs(phrases(t), offer_texts(t))
    known = pairs.select("q", "text", normalize_text(F.col("q")).alias("qv"), normalize_text(F.col("text")).alias("ov"))
    f = scoring.structure()
    from offerloom.functions.text import base_vowel_text

    sub = (
        F.contains(F.lower("text"), F.lower("q")) | F.contains(F.col("ov"), F.col("qv"))
        | F.contains(base_vowel_text(F.col("text")), base_vowel_text(F.col("q")))
    )
    return known.select("q", "text", f["n_words"].alias("n_words"), f["n_found"].alias("n_found"), f["exact"].cast("int").alias("exact"), sub.cast("int").alias("sub"))


VIEWS["typo_words"] = f"""
SELECT x, y FROM (SELECT DISTINCT unnest(string_split({norm_sql('q')}, ' ')) AS x FROM phrases) a JOIN (SELECT DISTINCT unnest(string_split({norm_sql('text')}, ' ')) AS y FROM typo_texts) b
ON length(x) >= 5 AND ((abs(length(x) - length(y)) <= (CASE WHEN length(x) <= 7 THEN 1 ELSE 2 END) AND levenshtein(x, y) <= (CASE WHEN length(x) <= 7 THEN 1 ELSE 2 END))
 OR (length(y) > length(x) AND length(x)::DOUBLE / length(y) > 0.85
  AND len(list_filter(range(1, length(y) - length(x) + 2), lambda i: levenshtein(x, substr(y, i::BIGINT, length(x))) <= (CASE WHEN length(x) <= 7 THEN 1 ELSE 2 END))) > 0))"""


@query(
    "txt10_typo_test",
    f"""SELECT q, text FROM (SELECT DISTINCT q.q, q.n, q.i, o.text FROM (SELECT q, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS x FROM (SELECT q, string_split({norm_sql('q')}, ' ') AS w FROM phrases)) q
 JOIN typo_words USING (x) JOIN (SELECT text, unnest(string_split({norm_sql('text')}, ' ')) AS y FROM typo_texts) o USING (y)) GROUP BY q, text HAVING count(*) = max(n)""",
)
def _(t: Tables):
    return typos.typo_test(phrases(t), offer_texts(t))


@query("txt11_match_score")
def _(t: Tables):
    """Best score over all wordings, for every phrase and offer text sharing a word part."""
    return scoring.score_pairs(scoring.candidate_pairs(phrases(t), offer_texts(t))).withColumn("score", round_to(F.col("score"), 6))


@query("txt11_scored_wordings")
def _(t: Tables):
    """Wordings by whether their bounds decide them or they go through the ratios, with the number of pairs."""
    bounds = cut_lineage(scoring.bound_pairs(scoring.candidate_pairs(phrases(t), offer_texts(t))))
    return bounds.groupBy("q").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.size("left") > 0).alias("open_pairs"), F.sum(F.size("left")).alias("open_wordings"))


def primary_text():
    return F.concat_ws(" ", "brand", "product_name")


@query("txt12_search_ranking")
def _(t: Tables):
    """Every accepted hit of every whole phrase."""
    found = search.ranked_hits(phrases(t), t.offers, primary_text(), search_column())
    return found.select("q", "chain", "offer_id", round_to(F.col("score"), 6).alias("score"))


def suggestions(t: Tables):
    return search.top_hits(phrases(t), t.offers, primary_text(), search_column(), 15)


@query("txt15_suggestions")
def _(t: Tables):
    """Fifteen best suggestions per phrase with their discount."""
    return suggestions(t)[0].select(
        "q", "rank", "chain", "offer_id", "sales_price", discount_percent(F.col("sales_price"), F.col("regular_price")).alias("discount")
    )


@query("txt15_scored_pairs")
def _(t: Tables):
    """How many pairs the suggestions of a phrase had to score."""
    return suggestions(t)[1].groupBy("q").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.size("left") > 0).alias("open_pairs"))


@query(
    "txt3_bm25_top",
    f"""SELECT q, offer_id, {round_to_sql('score', 6)} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {round_to_sql('score', 6)}, offer_id) AS rank FROM ranked_hits)
WHERE rank <= 15""",
)
def _(t: Tables):
    return search.bm25_top(phrases(t), index(t), "offer_id", 15)


@query(
    "txt13_hit_dedup",
    f"""SELECT q, chain, offer_id, score FROM shown_hits QUALIFY row_number() OVER (PARTITION BY q, chain, {norm_sql('brand')}, {norm_sql('product_name')}
 ORDER BY score DESC, sales_price, offer_id DESC) = 1""",
)
def _(t: Tables):
    return search.dedupe_hits(shown_hits(t)).select("q", "chain", "offer_id", "score")


@query(
    "txt16_products_across_chains",
    f"""WITH c AS (SELECT q, {norm_sql('brand')} AS nb, {norm_sql('product_name')} AS nt, chain, max(score) AS score, min(sales_price) AS price FROM shown_hits GROUP BY ALL),
g AS (SELECT q, nb, nt, max(score) AS score, min(price) AS price, arg_min(chain, (price, chain)) AS cheapest_chain, string_agg(chain, ',' ORDER BY score DESC, chain) AS chains,
 count(*) AS chain_count FROM c GROUP BY q, nb, nt)
SELECT q, nb, nt, score, price, cheapest_chain, chains, chain_count, count(*) OVER (PARTITION BY q) AS products_total FROM g
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, nb, nt) <= 5""",
)
def _(t: Tables):
    return search.products_across_chains(shown_hits(t), 5).select(
        "q", "nb", "nt", "score", "price", "cheapest_chain", "chains", "chain_count", "products_total"
    )


@query(
    "txt17_facets",
    "SELECT q, count(*) AS total, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands FROM shown_hits GROUP BY q",
)
def _(t: Tables):
    return search.facets(shown_hits(t))


@query(
    "txt17_pages",
    """SELECT q, count(*) AS total, CASE WHEN 40 < count(*) THEN 1 ELSE 0 END AS has_more, coalesce(string_agg(offer_id, ',' ORDER BY rn) FILTER (WHERE rn > 20 AND rn <= 40), '') AS page
FROM (SELECT q, offer_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, offer_id) AS rn FROM shown_hits) GROUP BY q""",
)
def _(t: Tables):
    """The second page of twenty hits of every phrase."""
    return search.hit_pages(shown_hits(t), "offer_id", 20, 20)


@query(
    "txt18_client_sorts",
    """SELECT q, offer_id, by_price, by_price_desc, by_discount FROM (SELECT q, offer_id,
 row_number() OVER (PARTITION BY q ORDER BY coalesce(sales_price, 9999), offer_id) AS by_price,
 row_number() OVER (PARTITION BY q ORDER BY coalesce(sales_price, 0) DESC, offer_id) AS by_price_desc,
 row_number() OVER (PARTITION BY q ORDER BY coalesce(CASE WHEN regular_price > sales_price THEN round_even((1::DOUBLE - sales_price / regular_price) * 100::DOUBLE, 0) END, 0) DESC, offer_id) AS by_discount
 FROM shown_hits)""",
)
def _(t: Tables):
    off = discount_percent(F.col("sales_price"), F.col("regular_price"))
    order = {
        "by_price": [F.coalesce("sales_price", F.lit(9999.0)).asc()], "by_price_desc": [F.coalesce("sales_price", F.lit(0.0)).desc()],
        "by_discount": [F.coalesce(off, F.lit(0)).desc()],
    }
    ranked = shown_hits(t)
    for name, keys in order.items():
        ranked = ranked.withColumn(name, F.row_number().over(W.partitionBy("q").orderBy(*keys, "offer_id")))
    return ranked.select("q", "offer_id", *order)


@query(
    "flt9_chain_facet",
    "SELECT q, offer_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, offer_id) AS rank FROM shown_hits WHERE chain IN ('Chain#1', 'Chain#3')",
)
def _(t: Tables):
    kept = shown_hits(t).where(F.col("chain").isin("Chain#1", "Chain#3"))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "offer_id"))).select("q", "offer_id", "rank")
