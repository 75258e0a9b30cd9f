"""Category search: label scores, tiers, roll-up and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerloom.functions.literals import literal_array
from offerloom.functions.text import normalize_search_text, words
from offerloom.functions.tokens import synonym_variants, umlaut_variants
from offerloom.operators.scoring import containing_words
from offerloom.operators.search import postings, prefix_search
from offerloom.session import cut_lineage

# Parts of category names that are never suggested.
BLOCKED_PARTS = [
    "coupon", "gutschein", "aktion", "promotion", "eisenbahn", "puppen", "spielzeug", "gartenspritze", "spritzbeutel",
    "rindenmulch", "wasserfilter", "eismaschine", "eiswürfelbeutel", "eiswuerfelbeutel", "eiswürfelbereiter",
    "eiswuerfelbereiter", "seifenblasen", "reisegepäck", "reisegepaeck", "reisekoffer",
]


def is_blocked(name: Column, parts: list[str] | None = None) -> Column:
    """Name contains a blocked part or is a catch-all category, as written or normalised."""
    low, norm = F.lower(name), normalize_search_text(F.lower(name))
    listed = literal_array(["sonstig", *(BLOCKED_PARTS if parts is None else parts)])
    return F.exists(listed, lambda p: F.contains(low, p) | F.contains(norm, p))


# Tiers from best to worst, with the floor and the cap they put on a score.
EXACT, STRONG, PARTIAL, WEAK, INDIRECT = 1, 2, 3, 4, 5
TIER_FLOOR = {EXACT: 200, STRONG: 155, PARTIAL: 125, WEAK: 85, INDIRECT: 50}
TIER_CAP = {EXACT: 200, STRONG: 170, PARTIAL: 140, WEAK: 100, INDIRECT: 80}


def query_variants(queries: DataFrame) -> DataFrame:
    """(q, v): the normalised query, the query as typed, umlaut spellings and synonyms of all of them."""
    norm, raw = normalize_search_text(F.col("q")), F.lower(F.trim("q"))
    spelled = F.array_distinct(F.concat(F.array(norm, raw), umlaut_variants(norm), umlaut_variants(raw)))
    base = queries.select("q", spelled.alias("base")).where(norm != "")
    every = F.array_distinct(F.concat("base", F.flatten(F.transform("base", lambda b: synonym_variants(b)))))
    return base.select("q", F.explode(every).alias("v")).where("v <> ''")


def label_score(query: Column, label: Column, kind: Column) -> Column:
    """How well one label answers a query."""
    bonus = F.when(kind == "gattung", 5).when(kind == "marke", 15).otherwise(0)
    qt, lt = F.array_distinct(words(query)), F.array_distinct(words(label))
    common = F.size(F.array_intersect(qt, lt))
    every, extra = common == F.size(qt), F.size(lt) - F.size(qt)
    score = (
        F.when(label == query, 140)
        .when((F.size(qt) > 1) & every & (extra == 0), 135)
        .when(every & (extra == 0), 130)
        .when(every, F.greatest(F.lit(60), F.lit(95) - extra * 15))
        .when(F.startswith(query, F.concat(label, F.lit(" "))), 90)
        .when((F.size(qt) == 1) & (F.size(lt) == 1) & F.startswith(label, query), 85)
        .when(F.contains(label, query), 50)
        .when(F.contains(query, label), 55)
        .when(common > 0, F.lit(40) + common * 5)
        .otherwise(20)
    )
    return score + bonus


def match_tier(query: Column, name: Column) -> Column:
    """Relation of a query to a category name, from exact to indirect."""
    forms = [normalize_search_text(F.lower(name)), F.lower(name)]
    quoted = F.regexp_replace(query, r"([\\.\[\]{}()*+?^$|])", r"\\$1")

    def either(test) -> Column:
        return test(forms[0]) | test(forms[1])

    def bounded(left: str, right: str) -> Column:
        pattern = F.concat(F.lit(left), quoted, F.lit(right))
        return either(lambda n: F.regexp_like(n, pattern))

    prefix = either(lambda n: F.startswith(n, query))
    suffix = either(
        lambda n: F.exists(F.split(n, r"\s+"), lambda w: F.endswith(w, query) & (F.length(w) >= F.length(query) + 3))
    )
    return (
        F.when(either(lambda n: n == query), EXACT)
        .when(bounded("^", "(?:$|[ \\-&/,])"), STRONG)
        .when(prefix & (F.length(query) >= 5), STRONG)
        .when(bounded("(?:^|[ \\-&/,])", "(?:$|[ \\-&/,])"), PARTIAL)
        .when(either(lambda n: F.contains(n, query)), F.when(suffix, STRONG).otherwise(WEAK))
        .otherwise(INDIRECT)
    )


def _of_tier(tier: Column, table: dict[int, int]) -> Column:
    out = F.lit(table[INDIRECT])
    for key in (EXACT, STRONG, PARTIAL, WEAK):
        out = F.when(tier == key, table[key]).otherwise(out)
    return out


def bounded_score(score: Column, tier: Column) -> Column:
    """Score lifted to the floor and cut at the cap of its tier."""
    indirect = F.least(F.lit(20) + F.floor(score * 0.55).cast("int"), F.lit(80))
    floor = F.when(tier == INDIRECT, indirect).otherwise(_of_tier(tier, TIER_FLOOR))
    return F.least(F.greatest(score, floor), _of_tier(tier, TIER_CAP))


def label_hits(variants: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, v, label): labels whose words start with forms of all query words; labels merely containing
    the query only for queries reaching fewer than three categories that way."""
    distinct = labels.select("label").distinct()
    variants = cut_lineage(variants)
    prefix = prefix_search(variants.select(F.col("v").alias("q")).distinct(), postings(distinct, "label", {"label": F.col("label")}), "label")
    first = cut_lineage(variants.join(prefix.withColumnRenamed("q", "v"), "v").select("q", "v", "label"))
    reached = first.join(labels.select("label", "category_id").distinct(), "label").select("q", "category_id").distinct().groupBy("q").agg(F.count(F.lit(1)).alias("c"))
    poor = variants.join(reached.where("c >= 3"), "q", "left_anti")
    needles = poor.withColumn("needle", F.col("v"))
    second = containing_words(needles, distinct.withColumnRenamed("label", "word")).select("q", "v", F.col("word").alias("label"))
    return first.unionByName(second).distinct()


def label_counts(search_labels: DataFrame, product_labels: DataFrame) -> DataFrame:
    """(category_id, label, label_type, n): label rows per category, counted before any query meets them."""
    placed = search_labels.join(product_labels.select("product_key", "category_id"), "product_key")
    return placed.groupBy("category_id", "label", "label_type").agg(F.count(F.lit(1)).alias("n"))


def category_scores(hits: DataFrame, counts: DataFrame, categories: DataFrame) -> DataFrame:
    """(q, category_id, score, hits, tier) over all label hits of a query."""
    rows = hits.join(counts, "label").join(categories.select("category_id", "name"), "category_id")
    rows = rows.withColumn("raw", label_score(F.col("v"), F.col("label"), F.col("label_type"))).withColumn("tier", match_tier(F.col("v"), F.col("name")))
    rows = rows.withColumn("score", bounded_score(F.col("raw"), F.col("tier")))
    return rows.groupBy("q", "category_id").agg(F.max("score").alias("score"), F.sum("n").alias("hits"), F.min("tier").alias("tier"))


def multi_token_scores(queries: DataFrame, search_labels: DataFrame, product_labels: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories of products having, for each of two to five query words, a label containing it."""
    tokens = words(normalize_search_text(F.col("q")))
    cut = queries.select("q", tokens.alias("tk")).where(F.size("tk").between(2, 5))
    needles = cut.select("q", F.size("tk").alias("n_tokens"), F.posexplode("tk").alias("token_no", "needle"))
    labels = search_labels.select("product_key", F.col("label").alias("word")).distinct()
    found = containing_words(needles, labels.select("word").distinct()).join(labels, "word")
    once = found.select("q", "n_tokens", "token_no", "product_key").distinct()
    full = once.groupBy("q", "n_tokens", "product_key").agg(F.count(F.lit(1)).alias("hit")).where("hit = n_tokens")
    placed = full.join(product_labels.select("product_key", "category_id"), "product_key").groupBy("q", "category_id").agg(F.count(F.lit(1)).alias("products"))
    named = placed.join(categories.select("category_id", "name"), "category_id").join(cut, "q")
    low, norm = F.lower("name"), normalize_search_text(F.lower("name"))
    phrase = F.array_join("tk", " ")
    inside = F.contains(norm, phrase) | F.contains(low, phrase)
    some = F.exists("tk", lambda w: F.contains(norm, w) | F.contains(low, w))
    return named.select("q", "category_id", "products", F.when(inside, 170).when(some, 140).otherwise(80).alias("score"))


def roll_up(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """Third-level hits also count for their groups, a little below the best child; groups hit directly rank above it."""
    child = categories.where("level = 3 AND parent_id IS NOT NULL").select("category_id", "parent_id")
    grouped = scores.join(child, "category_id").groupBy("q", F.col("parent_id").alias("category_id")).agg(
        F.max("score").alias("child_score"), F.sum("hits").alias("child_hits"), F.least(F.min("tier") + 1, F.lit(INDIRECT)).alias("child_tier")
    )
    both = scores.join(grouped, ["q", "category_id"], "full_outer")
    lifted = F.greatest(F.col("child_score") - 15, _of_tier(F.col("child_tier"), TIER_FLOOR))
    score = (
        F.when(F.col("child_score").isNull(), F.col("score")).when(F.col("score").isNull(), lifted)
        .otherwise(F.greatest(F.col("child_score") + 5, F.col("score")))
    )
    zero = F.lit(0)
    return both.select(
        "q", "category_id", score.alias("score"), (F.coalesce("hits", zero) + F.coalesce("child_hits", zero)).alias("hits"), F.least("tier", "child_tier").alias("tier")
    )


def rank_categories(scores: DataFrame, categories: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """Filtered hits with their rank per ``keys``: ``counts`` is (category_id, n), and has those of the keys that it depends on."""
    node = categories.select("category_id", "name", "level", "parent_id")
    up = categories.select(F.col("category_id").alias("parent_id"), F.col("name").alias("p1"), F.col("parent_id").alias("grand_id"))
    top = categories.select(F.col("category_id").alias("grand_id"), F.col("name").alias("p2"))
    known = scores.join(counts, [c for c in (*keys, "category_id") if c in counts.columns]).join(node, "category_id").join(up, "parent_id", "left").join(top, "grand_id", "left")
    known = known.withColumn("ober", F.coalesce(F.when(F.col("level") == 3, F.col("p2")).otherwise(F.col("p1")), F.lit("")))
    kept = known.where(
        (F.col("n") > 0) & ~is_blocked(F.col("name")) & ~F.contains(F.lower("ober"), F.lit("sonstig")) & ~((F.col("n") <= 2) & (F.col("score") < 140))
    )
    kept = kept.withColumn("best", F.max("score").over(W.partitionBy(*keys))).where(
        (F.col("score") >= F.greatest(F.floor(F.col("best") * 0.65), F.lit(50)))
        & ((F.col("best") < 155) | (F.col("score") >= 85) | (F.col("n") >= 20))
        & ((F.col("best") >= 100) | (F.col("n") >= 3) | (F.col("score") >= 80))
    )
    log2 = lambda c: F.log2(F.greatest(F.lit(1), c))
    bucket = F.floor(F.col("score") / 5) + F.floor(log2(F.col("hits")))
    order = [F.col("tier"), bucket.desc(), F.col("n").desc(), F.col("hits").desc(), F.col("category_id")]
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).select(
        *keys, "category_id", "name", "level", "ober", "score", "hits", "tier", "n", "rank"
    )


def local_or_national(requests: DataFrame, local: DataFrame, national: DataFrame, local_limit: int = 8, national_limit: int = 5) -> DataFrame:
    """Hits of the requests (place, leader, q): the local ones (leader, q, ...), or where there are none the national ones (q, ...), marked."""
    columns = ["category_id", "score", "n", "rank"]
    near = local.where(F.col("rank") <= local_limit).select("leader", "q", *columns)
    far = national.where(F.col("rank") <= national_limit).select("q", *columns)
    answered = requests.join(near, ["leader", "q"]).withColumn("not_local", F.lit(0))
    missed = requests.join(local.select("leader", "q").distinct(), ["leader", "q"], "left_anti").join(far, "q").withColumn("not_local", F.lit(1))
    return answered.unionByName(missed)


def merge_same_names(ranked: DataFrame) -> DataFrame:
    """One row per query and set of name words; a group stands for its child of the same name."""
    parts = F.filter(F.split(normalize_search_text(F.col("name")), r"[\s&/,]+"), lambda w: w != "")
    keyed = ranked.withColumn("name_key", F.array_join(F.array_sort(parts), " "))
    group = F.col("level") == 2
    row = F.struct("category_id", "name", "level", "ober", "score", "tier", "n")
    keyed = keyed.withColumn("g", F.min(F.when(group, F.col("rank"))).over(W.partitionBy("q", "name_key")))
    agg = keyed.groupBy("q", "name_key").agg(
        F.min("rank").alias("rank"), F.min_by(row, "rank").alias("first"), F.min_by(row, F.when(group, F.col("rank"))).alias("grp"),
        F.sum("n").alias("n_all"), F.sum(F.when(group, F.col("n"))).alias("n_grp"),
        F.coalesce(F.sum(F.when(~group & (F.col("rank") < F.col("g")), F.col("n"))), F.lit(0)).alias("n_before"),
    )
    total = F.when(F.col("grp").isNull(), F.col("n_all")).otherwise(F.greatest(F.col("grp.n"), "n_before") + F.col("n_grp") - F.col("grp.n"))
    merged = agg.select("q", "rank", F.coalesce("grp", "first").alias("c"), total.alias("n"))
    return merged.select("q", "rank", "c.category_id", "c.name", "c.level", "c.ober", "c.score", "c.tier", "n")


def diversify(merged: DataFrame, limit: int) -> DataFrame:
    """At most two hits per top-level category when there are three or more of those, else four; then the limit."""
    place = F.row_number().over(W.partitionBy("q", "ober").orderBy("rank"))
    obers = F.size(F.collect_set("ober").over(W.partitionBy("q")))
    kept = merged.withColumn("place", place).where("place <= 4").withColumn("obers", obers).where("obers < 3 OR place <= 2")
    return kept.withColumn("position", F.row_number().over(W.partitionBy("q").orderBy("rank"))).where(F.col("position") <= limit)


def search_brands(queries: DataFrame, product_labels: DataFrame, limit: int) -> DataFrame:
    """Brands by prefix, then by substring, with at least two products; largest first."""
    folded = F.replace(F.lower("marke"), F.lit("-"), F.lit(" "))
    per = product_labels.where("marke IS NOT NULL AND marke <> ''").groupBy("marke").agg(
        F.count(F.lit(1)).alias("products"), F.min("category_id").alias("category_id")
    ).where("products >= 2").withColumn("word", folded)
    asked = queries.select("q", F.replace(F.lower("q"), F.lit("-"), F.lit(" ")).alias("raw"), normalize_search_text(F.col("q")).alias("norm")).where(F.length("norm") >= 2)
    needles = asked.select("q", F.explode(F.array(F.struct(F.col("raw").alias("needle"), F.lit(1).alias("tier")), F.struct(F.col("norm").alias("needle"), F.lit(2).alias("tier")))).alias("x")).select("q", "x.*")
    found = containing_words(needles, per.select("word").distinct()).where("tier = 2 OR startswith(word, needle)")
    best = found.groupBy("q", "word").agg(F.min("tier").alias("tier")).join(per, "word")
    w = W.partitionBy("q").orderBy("tier", F.desc("products"), "marke")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("q", "marke", "products", "tier", "rank")


def spelling_terms(search_labels: DataFrame, categories: DataFrame, top: int | None = None) -> DataFrame:
    """(term, freq): words and multi-word names of second-level categories, and the labels of two kinds, or the ``top`` most frequent of them."""
    names = categories.where("level = 2").select(F.lower("name").alias("name"))
    parts = names.select(F.explode(F.filter(F.split("name", r"\s+"), lambda w: F.length(w) >= 3)).alias("term"), F.lit(1).alias("freq"))
    whole = names.where(F.contains("name", F.lit(" "))).select(F.col("name").alias("term"), F.lit(1).alias("freq"))
    labels = search_labels.where(F.col("label_type").isin("suchbegriff", "gattung")).groupBy("label").agg(F.count(F.lit(1)).alias("freq"))
    if top is not None:
        labels = labels.orderBy(F.desc("freq"), "label").limit(top)
    frequent = labels.select(F.lower(F.trim("label")).alias("term"), "freq").where(F.length("term") >= 3)
    return parts.unionByName(whole).unionByName(frequent).groupBy("term").agg(F.sum("freq").alias("freq"))


def deletions(text: Column) -> Column:
    """The text with no, one or two letters taken out, letters swapped with a neighbour included by the second."""
    def cut(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    once = F.when(F.length(text) > 0, cut(text)).otherwise(F.array().cast("array<string>"))
    twice = F.flatten(F.transform(once, lambda d: F.when(F.length(d) > 0, cut(d)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(text), once, twice))


def correct_words(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term): nearest dictionary term within two edits; ties by shared start, then frequency, then text.

    Terms and tokens meet on strings they share after up to two deletions each.
    """
    left = tokens.select("token").distinct().withColumn("key", F.explode(deletions(F.col("token"))))
    right = terms.select("term", "freq", F.explode(deletions(F.col("term"))).alias("key"))
    near = left.join(right, "key").select("token", "term", "freq").distinct()
    near = near.withColumn("dist", F.levenshtein("token", "term", 2)).where("dist >= 0")
    shared = F.size(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length("term"), F.lit(1))), lambda n: F.startswith(F.col("token"), F.substring(F.col("term"), F.lit(1), n)))
    )
    best = near.groupBy("token").agg(F.min_by("term", F.struct("dist", -shared, -F.col("freq"), "term")).alias("term"), F.min("dist").alias("dist"))
    return best


def correct_queries(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(q, corrected): every word replaced by its nearest term, only where that changes the query."""
    each = queries.select("q", F.posexplode(words(F.lower(F.trim("q")))).alias("pos", "token"))
    fixed = each.join(correct_words(each, terms), "token", "left")
    whole = fixed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("term", "token").alias("t")))).alias("l"))
    return whole.select("q", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("corrected")).where(F.col("corrected") != F.lower(F.trim("q")))


def suggest(queries: DataFrame, search_labels: DataFrame, product_labels: DataFrame, categories: DataFrame) -> DataFrame:
    """(q, category_id, score, hits, tier) of a query after variants, word intersections and roll-up."""
    counts = label_counts(search_labels, product_labels)
    scores = category_scores(label_hits(query_variants(queries), counts), counts, categories)
    multi = multi_token_scores(queries, search_labels, product_labels, categories)
    tier = F.when(F.col("score") == 170, STRONG).when(F.col("score") == 140, PARTIAL).otherwise(INDIRECT)
    boosted = multi.select("q", "category_id", "score", F.lit(1).cast("bigint").alias("hits"), tier.alias("tier"))
    every = scores.unionByName(boosted).groupBy("q", "category_id").agg(F.max("score").alias("score"), F.sum("hits").alias("hits"), F.min("tier").alias("tier"))
    return roll_up(cut_lineage(every), categories)


def suggest_with_correction(queries: DataFrame, search_labels: DataFrame, product_labels: DataFrame, categories: DataFrame) -> DataFrame:
    """As ``suggest``; queries with no hit, or at most three hits all below 100, use their correction if it scores better."""
    found = suggest(queries, search_labels, product_labels, categories)
    state = queries.select("q").distinct().join(found.groupBy("q").agg(F.count(F.lit(1)).alias("c"), F.max("score").alias("best")), "q", "left")
    weak = state.where("c IS NULL OR (c <= 3 AND best < 100)")
    fixes = correct_queries(weak.select("q"), spelling_terms(search_labels, categories))
    again = suggest(fixes.select(F.col("corrected").alias("q")).distinct(), search_labels, product_labels, categories).withColumnRenamed("q", "corrected")
    better = fixes.join(again.groupBy("corrected").agg(F.max("score").alias("fixed_best")), "corrected").join(weak, "q").where("best IS NULL OR fixed_best > best")
    replaced = better.select("q", "corrected").join(again, "corrected").select("q", "category_id", "score", "hits", "tier", "corrected")
    plain = found.join(better.select("q"), "q", "left_anti").withColumn("corrected", F.lit(None).cast("string"))
    return plain.unionByName(replaced)
