"""Full-text retrieval over offers: postings, prefix and substring search, BM25, result shaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions.literals import literal_map
from offerloom.functions.numbers import round_to
from offerloom.functions.text import normalize_search_text, normalize_text, words
from offerloom.functions.tokens import token_forms
from offerloom.operators import typos
from offerloom.operators.matching import accepted
from offerloom.operators.scoring import bound_pairs, candidate_pairs, containing_words, settle
from offerloom.session import cut_lineage

# Column weights and the usual constants of the ranking function.
COLUMN_WEIGHTS = {"name": 8.0, "brand": 5.0, "description": 1.5, "search": 3.0, "chain": 0.5}
K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc_id: str, columns: dict[str, Column]) -> DataFrame:
    """(token, doc, column, tf) of the normalised columns."""
    fields = F.array(*[F.struct(F.lit(name).alias("field"), words(normalize_search_text(c)).alias("tokens")) for name, c in columns.items()])
    rows = docs.select(F.col(doc_id), F.explode(fields).alias("f")).select(doc_id, "f.field", F.explode("f.tokens").alias("token"))
    return rows.groupBy("token", doc_id, "field").agg(F.count(F.lit(1)).alias("tf"))


def query_forms(queries: DataFrame) -> DataFrame:
    """(q, n_tokens, token_no, form) of every word form of a query."""
    tokens = words(normalize_search_text(F.col("q")))
    each = queries.select("q", F.size(tokens).alias("n_tokens"), F.posexplode(tokens).alias("token_no", "token"))
    return each.select("q", "n_tokens", "token_no", F.explode(token_forms(F.col("token"))).alias("form"))


def prefix_words(forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary words starting with a form, joined on the prefixes of the words."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substring(F.col("token"), F.lit(1), n))
    return vocabulary.select("token", F.explode(prefixes).alias("form")).join(forms, "form")


def all_tokens_hit(hits: DataFrame, doc_id: str) -> DataFrame:
    """(q, doc) pairs in which every query token was hit by some form."""
    once = hits.select("q", "n_tokens", "token_no", doc_id).distinct()
    return once.groupBy("q", doc_id).agg(F.count(F.lit(1)).alias("hit"), F.first("n_tokens").alias("n")).where("hit = n").select("q", doc_id)


def all_tokens_met(found: DataFrame, forms: DataFrame, index: DataFrame, doc_id: str, meets: Callable[[Column, Column], Column]) -> DataFrame:
    """(q, doc) in which every query token is met, from the rarest token of each query.

    ``found`` is (q, n_tokens, token_no, token) of the vocabulary words that meet a form. The token
    whose words stand in the fewest documents gives the candidates; the others are tested against
    the candidate's own words, so that a word of all documents is never expanded.
    """
    # written once, since the counts, the candidates and the words of a document come from it
    held = cut_lineage(index.select("token", doc_id).distinct())
    found = cut_lineage(found.select("q", "n_tokens", "token_no", "token").distinct())
    cost = found.join(held.groupBy("token").agg(F.count(F.lit(1)).alias("docs")), "token").groupBy("q", "n_tokens", "token_no").agg(F.sum("docs").alias("docs"))
    first = cost.groupBy("q", "n_tokens").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("docs", "token_no"))["token_no"].alias("first")).where("met = n_tokens")
    first = first.select("q", "first")
    rarest = found.join(first, "q").where("token_no = first").select("q", "token")
    candidates = rarest.join(held, "token").select("q", doc_id).distinct()
    by_token = forms.join(first, "q").where("token_no <> first").groupBy("q", "token_no").agg(F.collect_set("form").alias("forms"))
    tests = by_token.groupBy("q").agg(F.collect_list("forms").alias("tests"))
    own = held.groupBy(doc_id).agg(F.collect_set("token").alias("own"))
    tested = candidates.join(tests, "q").join(own, doc_id).where(
        F.forall("tests", lambda fs: F.exists("own", lambda w: F.exists(fs, lambda f: meets(w, f))))
    )
    alone = candidates.join(tests.select("q"), "q", "left_anti")
    return tested.select("q", doc_id).unionByName(alone)


def prefix_search(queries: DataFrame, index: DataFrame, doc_id: str) -> DataFrame:
    """Documents containing, for every query word, a word starting with one of its forms."""
    forms = query_forms(queries)
    found = prefix_words(forms, index.select("token").distinct())
    return all_tokens_met(found, forms, index, doc_id, F.startswith)


def substring_search(queries: DataFrame, index: DataFrame, doc_id: str) -> DataFrame:
    """As prefix search, with the forms anywhere inside a word."""
    forms = query_forms(queries)
    found = containing_words(forms.withColumnRenamed("form", "needle"), index.select(F.col("token").alias("word")).distinct())
    return all_tokens_met(found.withColumnRenamed("word", "token"), forms, index, doc_id, F.contains)


def impacts(forms: DataFrame, index: DataFrame, doc_id: str) -> DataFrame:
    """(form, doc, dl, part): what a form adds to the score of a document; ``dl`` is the document's length."""
    weights = literal_map(COLUMN_WEIGHTS.items())
    lengths = index.groupBy(doc_id).agg(F.sum("tf").alias("dl"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    weighted = index.groupBy("token", doc_id).agg(F.sum(F.col("tf") * F.element_at(weights, F.col("field"))).alias("f"))
    terms = prefix_words(forms.select("form").distinct(), index.select("token").distinct())
    per_doc = terms.join(weighted, "token").groupBy("form", doc_id).agg(F.sum("f").alias("f"))
    docs_with = per_doc.groupBy("form").agg(F.count(F.lit(1)).alias("n_with"))
    known = per_doc.join(docs_with, "form").join(lengths, doc_id).crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5)))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return known.select("form", doc_id, "dl", part.alias("part"))


def _scored(matched: DataFrame, forms: DataFrame, parts: DataFrame, doc_id: str) -> DataFrame:
    joined = matched.select("q", doc_id).join(forms.select("q", "token_no", "form"), "q").join(parts.select("form", doc_id, "part"), ["form", doc_id])
    return joined.groupBy("q", doc_id).agg((-F.sum("part")).alias("score"))


def bm25(queries: DataFrame, index: DataFrame, doc_id: str) -> DataFrame:
    """(q, doc, score) of the prefix search; lower is better, every form is a phrase of its own."""
    forms = query_forms(queries)
    return _scored(prefix_search(queries, index, doc_id), forms, impacts(forms, index, doc_id), doc_id)


def bm25_top(queries: DataFrame, index: DataFrame, doc_id: str, k: int) -> DataFrame:
    """(q, doc, score, rank): the best ``k`` hits of each query, scoring only blocks of documents that can hold one of them.

    Documents of one length are a block, and the largest part of each form in a block bounds the
    scores of its documents. The blocks with the best bounds that hold ``k`` hits are scored first;
    the k-th score among them is the threshold that all other blocks must be able to reach.
    """
    forms = cut_lineage(query_forms(queries))
    parts = cut_lineage(impacts(forms, index, doc_id))
    lengths = index.groupBy(doc_id).agg(F.sum("tf").alias("dl"))
    matched = cut_lineage(prefix_search(queries, index, doc_id).join(lengths, doc_id))
    tops = parts.groupBy("form", "dl").agg(F.max("part").alias("most"))
    sizes = matched.groupBy("q", "dl").agg(F.count(F.lit(1)).alias("docs"))
    bounds = sizes.join(forms.select("q", "token_no", "form"), "q").join(tops, ["form", "dl"]).groupBy("q", "dl", "docs").agg(F.sum("most").alias("most"))
    before = W.partitionBy("q").orderBy(F.desc("most"), "dl").rowsBetween(W.unboundedPreceding, -1)
    blocks = cut_lineage(bounds.withColumn("head", F.coalesce(F.sum("docs").over(before), F.lit(0)) < k))
    best = W.partitionBy("q").orderBy("score")
    head = cut_lineage(_scored(matched.join(blocks.where("head").select("q", "dl"), ["q", "dl"]), forms, parts, doc_id))
    threshold = head.withColumn("rn", F.row_number().over(best)).where(F.col("rn") == k).select("q", (-F.col("score")).alias("least"))
    # Ranks go by rounded scores, so that a block within the rounding of the threshold still counts.
    able = blocks.where("not head").join(threshold, "q").where(F.col("most") >= F.col("least") - 2e-6).select("q", "dl")
    scored = head.unionByName(_scored(matched.join(able, ["q", "dl"]), forms, parts, doc_id)).withColumn("score", round_to(F.col("score"), 6))
    rank = W.partitionBy("q").orderBy("score", doc_id)
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def typo_search(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, text): every query word is met, by one of its forms with one or two typos, somewhere in the normalised text."""
    return typos.typo_search(query_forms(queries), texts)


def cascade(prefix: DataFrame, substring: DataFrame, fuzzy: DataFrame, doc_id: str) -> DataFrame:
    """Prefix hits before substring hits; fuzzy hits only for queries answered by neither."""
    tiers = prefix.withColumn("tier", F.lit(1)).unionByName(substring.withColumn("tier", F.lit(2)))
    answered = tiers.select("q").distinct()
    tiers = tiers.unionByName(fuzzy.join(answered, "q", "left_anti").withColumn("tier", F.lit(3)))
    return tiers.groupBy("q", doc_id).agg(F.min("tier").alias("tier"))


def group_candidates(hits: DataFrame) -> DataFrame:
    """One candidate per (query, chain, product, brand, category): first id, lowest prices, latest validity."""
    keys = ["q", "chain", "product_name", "brand", "category_id"]
    return hits.groupBy(*keys).agg(
        F.min("offer_id").alias("offer_id"),
        F.min("sales_price").alias("sales_price"),
        F.min("regular_price").alias("regular_price"),
        F.max("valid_from").alias("valid_from"),
        F.max("valid_until").alias("valid_until"),
        F.max("image_url").alias("image_url"),
    )


def final_score(primary: Column, search: Column, boosted: Column) -> Column:
    """Better of both scores; a hit in the description only is capped at 79 and gets no category boost."""
    description_only = (search > primary) & (primary < 55)
    return F.when(description_only, F.least(search, F.lit(79.0))).otherwise(F.greatest(primary, search) + F.when(boosted, 15.0).otherwise(0.0))


def best_first(score: Column, price: Column) -> list[Column]:
    """Order of hits: score (a known price counts one point), known price, lower price."""
    known = price.isNotNull().cast("int")
    return [score + known, known, -F.coalesce(price, F.lit(1e9))]


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Best hit per (query, chain, normalised brand and title)."""
    keyed = hits.withColumns({"nb": normalize_text(F.col("brand")), "nt": normalize_text(F.col("product_name"))})
    rest = [c for c in hits.columns if c not in ("q", "chain")]
    order = F.struct(*best_first(F.col("score"), F.col("sales_price")), F.col("offer_id"))
    best = keyed.groupBy("q", "chain", "nb", "nt").agg(F.max_by(F.struct(*rest), order).alias("h"))
    return best.select("q", "chain", *[F.col(f"h.{c}").alias(c) for c in rest])


def _reduced(offers: DataFrame, primary: Column, search: Column) -> DataFrame:
    """Of the offers of a chain with the same texts and category, the one that ranks first whatever the score."""
    keyed = offers.withColumns({"primary_text": primary, "search_text": search})
    keys = ["chain", "brand", "product_name", "primary_text", "search_text", "category_id"]
    order = F.struct(F.col("sales_price").isNotNull(), -F.coalesce("sales_price", F.lit(1e9)), F.col("offer_id"))
    best = keyed.groupBy(*keys).agg(F.max_by(F.struct("offer_id", "sales_price", "regular_price"), order).alias("o"))
    return best.select(*keys, "o.*")


def _hits(queries: DataFrame, offers: DataFrame, primary: Column, search: Column) -> tuple[DataFrame, DataFrame]:
    """Bounds of all (q, text) that may be accepted, and the offers (q, ...) they come from."""
    reduced = cut_lineage(_reduced(offers, primary, search))
    texts = reduced.select(F.explode(F.array("primary_text", "search_text")).alias("text")).distinct()
    bounds = cut_lineage(bound_pairs(candidate_pairs(queries, texts), accepted_only=True))
    by_search = bounds.select("q", F.col("text").alias("search_text"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    by_primary = bounds.select("q", F.col("text").alias("primary_text"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    hits = reduced.join(by_search, "search_text").join(by_primary, ["q", "primary_text"], "left").na.fill(0.0, ["low1", "high1"])
    return bounds, hits.withColumn("boosted", F.contains(F.lower("category_id"), F.lower("q")))


def _final(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Accepted hits with their final score, the best per chain, brand and title."""
    by_search = scores.select("q", F.col("text").alias("search_text"), F.col("score").alias("s2"))
    by_primary = scores.select("q", F.col("text").alias("primary_text"), F.col("score").alias("s1"))
    rated = hits.join(by_search, ["q", "search_text"]).join(by_primary, ["q", "primary_text"], "left")
    rated = rated.withColumn("score", final_score(F.coalesce("s1", F.lit(0.0)), F.col("s2"), F.col("boosted")))
    columns = ["q", "chain", "offer_id", "product_name", "brand", "sales_price", "regular_price", "score"]
    return dedupe_hits(rated.where(accepted(F.col("score"), F.col("sales_price"))).select(*columns))


def ranked_hits(queries: DataFrame, offers: DataFrame, primary: Column, search: Column) -> DataFrame:
    """All accepted hits of every query: better of the scores of the primary and the search text, the best per chain, brand and title."""
    bounds, hits = _hits(queries, offers, primary, search)
    return _final(hits, settle(bounds))


def top_hits(queries: DataFrame, offers: DataFrame, primary: Column, search: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` of ``ranked_hits`` with their rank, and the bounds of the pairs that had to be scored for them.

    Each hit's final score lies between bounds. The k-th best of what the hits of a query reach for
    certain, one per chain, brand and title, is the threshold; pairs that only occur in hits that
    cannot reach it are never scored.
    """
    bounds, hits = _hits(queries, offers, primary, search)
    boost = F.when(F.col("boosted"), 15.0).otherwise(0.0)
    name_first = (F.col("low1") >= 55) | (F.col("high2") <= F.col("low1"))
    low = F.when(name_first, F.greatest("low1", "low2") + boost).otherwise(F.least(F.col("low2"), F.lit(79.0)))
    only_described = (F.col("high1") < 55) & (F.col("low2") > F.col("high1"))
    high = F.when(only_described, F.least(F.col("high2"), F.lit(79.0))).otherwise(F.greatest("high1", "high2") + boost)
    known = F.col("sales_price").isNotNull().cast("int")
    keyed = cut_lineage(hits.withColumns({"low": low, "high": high, "known": known}).where(accepted(F.col("high"), F.col("sales_price"))))
    product = [normalize_text(F.col("brand")).alias("nb"), normalize_text(F.col("product_name")).alias("nt")]
    certain = keyed.where(accepted(F.col("low"), F.col("sales_price"))).groupBy("q", "chain", *product).agg(F.max(F.col("low") + F.col("known")).alias("reached"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("reached")))
    threshold = certain.withColumn("rn", place).where(F.col("rn") == k).select("q", "reached")
    able = keyed.join(threshold, "q", "left").where(F.col("reached").isNull() | (F.col("high") + F.col("known") >= F.col("reached") - 2e-6))
    able = cut_lineage(able.drop("reached", "low", "high", "known"))
    needed = able.select("q", F.explode(F.array("primary_text", "search_text")).alias("text")).distinct()
    wanted = cut_lineage(bounds.join(needed, ["q", "text"], "left_semi"))
    found = _final(able, settle(wanted))
    order = [c.desc() for c in best_first(round_to(F.col("score"), 6), F.col("sales_price"))]
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order, "offer_id"))).where(F.col("rank") <= k)
    return ranked, wanted


def products_across_chains(hits: DataFrame, top: int) -> DataFrame:
    """Same product of several chains as one row: best title, cheapest price, chains by score; the best per query."""
    product = {"nb": normalize_text(F.col("brand")), "nt": normalize_text(F.col("product_name"))}
    by_chain = hits.withColumns(product).groupBy("q", "nb", "nt", "chain").agg(
        F.max("score").alias("score"), F.min("sales_price").alias("price"), F.max_by("product_name", F.struct("score", "offer_id")).alias("title")
    )
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("chain").alias("chain"))))
    grouped = by_chain.groupBy("q", "nb", "nt").agg(
        F.max("score").alias("score"), F.max_by("title", F.struct("score", "title")).alias("title"), F.min("price").alias("price"),
        F.min_by("chain", F.struct("price", "chain")).alias("cheapest_chain"),
        F.array_join(F.transform(listed, lambda x: x["chain"]), ",").alias("chains"), F.count(F.lit(1)).alias("chain_count"),
    )
    totals = grouped.groupBy("q").agg(F.count(F.lit(1)).alias("products_total"))
    w = W.partitionBy("q").orderBy(F.desc(round_to(F.col("score"), 6)), "nb", "nt")
    return grouped.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).join(totals, "q")


def hit_pages(hits: DataFrame, doc_id: str, offset: int, limit: int) -> DataFrame:
    """(q, total, has_more, page): one page of each query's hits by score, with how many there are."""
    totals = hits.groupBy("q").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), doc_id))
    shown = hits.select("q", "score", doc_id).withColumn("rn", place).where(F.col("rn") <= offset + limit).where(F.col("rn") > offset)
    page = shown.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", doc_id))), lambda x: x[doc_id]), ",").alias("page"))
    return totals.join(page, "q", "left").select("q", "total", (F.lit(offset + limit) < F.col("total")).cast("int").alias("has_more"), F.coalesce("page", F.lit("")).alias("page"))


def facets(hits: DataFrame) -> DataFrame:
    """Hits, chains and brands per query, from pre-aggregated pairs."""
    per = hits.groupBy("q", "chain", "brand").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("q").agg(
        F.sum("n").alias("total"),
        F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"),
        F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("brands"),
    )
