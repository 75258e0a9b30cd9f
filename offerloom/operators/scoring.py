"""Match score of search phrases against offer texts, after blocking on shared word parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.literals import literal_rows
from offerloom.functions.ratios import mean_ratio
from offerloom.functions.text import base_vowel_text, normalize_text, words
from offerloom.functions.tokens import BLOCKING_SYNONYMS, SCORING_SYNONYMS, expand_abbreviation, token_forms
from offerloom.operators.matching import MIN_SCORE_PRICED
from offerloom.session import cut_lineage


def grams(word: Column, sizes: list[int]) -> Column:
    """Distinct substrings of the given lengths."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    cut = [of_size(n) for n in sizes]
    return F.array_distinct(F.concat(*cut))


def containing_words(needles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(needle columns, word) for every vocabulary word that contains the needle.

    Both meet on the first three letters of the needle among the letter triples of the word,
    so the substring test never becomes a cross join.
    """
    cut = needles.where(F.col("needle") != "").withColumn("__gram", F.substring(F.col("needle"), F.lit(1), F.least(F.lit(3), F.length("needle"))))
    pieces = vocabulary.select("word", F.explode(grams(F.col("word"), [1, 2, 3])).alias("__gram"))
    return pieces.join(cut, "__gram").where(F.contains(F.col("word"), F.col("needle"))).drop("__gram")


def query_needles(queries: DataFrame) -> DataFrame:
    """(q, needle): word forms and synonyms of the longer words; of phrases with short words only, those words and what they abbreviate."""
    tokens = words(normalize_text(F.col("q")))
    longer = F.filter(tokens, lambda w: F.length(w) >= 3)
    pairs = [(a, b) for x, y in BLOCKING_SYNONYMS for a, b in ((x, y), (y, x))]
    table = literal_rows(["a", "b"], pairs)
    synonyms = F.flatten(F.transform(longer, lambda w: F.transform(F.filter(table, lambda p: p["a"] == w), lambda p: p["b"])))
    wide = F.concat(F.flatten(F.transform(longer, lambda w: token_forms(w))), synonyms)
    spelled = words(expand_abbreviation(normalize_text(F.col("q"))))
    chosen = F.when(F.size(longer) > 0, wide).otherwise(F.concat(tokens, spelled))
    return queries.select("q", F.explode(F.array_distinct(chosen)).alias("needle"))


def candidate_pairs(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (q, text) where some form of some query word occurs inside the normalised text."""
    postings = texts.select("text", F.explode(F.array_distinct(words(normalize_text(F.col("text"))))).alias("word"))
    hits = containing_words(query_needles(queries), postings.select("word").distinct())
    return hits.select("q", "word").distinct().join(postings, "word").select("q", "text").distinct()


def near_word(word: Column, other: Column) -> Column:
    """The query word has five or more letters and is within one or two edits of the other, or of a part of it if that is barely longer."""
    limit = F.when(F.length(word) <= 7, 1).otherwise(2)

    def within(text: Column) -> Column:
        return F.levenshtein(word, text) <= limit

    starts = F.sequence(F.lit(1), F.greatest(F.length(other) - F.length(word) + 1, F.lit(1)))
    direct = (F.abs(F.length(word) - F.length(other)) <= limit) & within(other)
    longer = (F.length(other) > F.length(word)) & (F.length(word) / F.length(other) > 0.85)
    return (F.length(word) >= 5) & (direct | (longer & F.exists(starts, lambda i: within(F.substring(other, i, F.length(word))))))


def close_typo(query_words: Column, offer_words: Column) -> Column:
    """Every query word is near some offer word."""
    return F.forall(query_words, lambda word: F.exists(offer_words, lambda other: near_word(word, other)))


def structure(q: str = "qv", o: str = "ov") -> dict[str, Column]:
    """Word-level facts of a (query, offer) pair of normalised texts."""
    qw, ow = words(F.col(q)), F.array_distinct(words(F.col(o)))
    inside = F.filter(qw, lambda w: F.exists(ow, lambda x: F.contains(x, w)))
    return {
        "n_words": F.size(qw),
        "n_found": F.size(inside),
        "exact": F.forall(qw, lambda w: F.array_contains(ow, w)),
        "typo": close_typo(qw, ow),
    }


def _swapped(text: Column) -> Column:
    """The text with one synonym put in for each synonym that occurs in it."""
    table = literal_rows(["a", "b"], [p for x, y in SCORING_SYNONYMS for p in ((x, y), (y, x))])
    return F.transform(F.filter(table, lambda p: F.contains(text, p["a"])), lambda p: F.replace(text, p["a"], p["b"]))


def _other_forms(text: Column) -> Column:
    """The text with one word at a time in another form."""
    tokens = words(text)
    return F.flatten(
        F.transform(
            tokens,
            lambda tok, i: F.transform(
                F.filter(token_forms(tok), lambda f: (F.length(f) >= 3) & (f != tok)),
                lambda f: F.array_join(F.transform(tokens, lambda t, j: F.when(j == i, f).otherwise(t)), " "),
            ),
        )
    )


def _prepared(texts: DataFrame, column: str, forms: bool) -> DataFrame:
    """Per distinct text: lower case, plain vowels, search form, and the other wordings that are scored."""
    text = F.col(column)
    base = texts.select(column).distinct().select(
        column, F.lower(F.trim(text)).alias("low"), base_vowel_text(text).alias("vowel"), normalize_text(text).alias("norm")
    ).where("norm <> ''")
    norm = F.col("norm")
    others = [F.array(expand_abbreviation(norm)), _swapped(norm)] + ([_other_forms(norm)] if forms else [])
    unique = F.filter(F.array_distinct(F.concat(*others)), lambda v: v != norm)
    return base.select(F.struct("low", "vowel", "norm", unique.alias("others")).alias(f"{column}_p"), column)


def ratio_bounds(a: str = "qv", b: str = "ov") -> tuple[Column, Column]:
    """Least and largest value that the mean of the two ratios can have, from word sets and lengths alone.

    Both are exact where the words of one side all occur on the other and one text holds the other.
    """
    x, y = F.col(a), F.col(b)
    wx, wy = F.array_distinct(words(x)), F.array_distinct(words(y))
    shared = F.length(F.array_join(F.array_intersect(wx, wy), " "))
    only_x, only_y = F.length(F.array_join(F.array_except(wx, wy), " ")), F.length(F.array_join(F.array_except(wy, wx), " "))
    gap = F.when(shared > 0, 1).otherwise(0)
    len_x, len_y = shared + gap + only_x, shared + gap + only_y
    common = F.when(shared > 0, F.greatest(1 - (gap + only_x) / (shared + len_x), 1 - (gap + only_y) / (shared + len_y))).otherwise(F.lit(0.0))

    def words_alike(lcs: Column) -> Column:
        return F.greatest(1 - (only_x + only_y - 2 * lcs) / F.greatest(len_x + len_y, F.lit(1)), common)

    inside = (shared > 0) & ((only_x == 0) | (only_y == 0))
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    size = F.greatest(F.length(short), F.lit(1))
    # a word of the shorter text inside the longer one lies in a window as long as the shorter text
    longest = F.array_max(F.transform(F.filter(words(short), lambda w: F.contains(long, w)), lambda w: F.length(w)))
    held = F.contains(long, short)
    set_low, set_high = (F.when(inside, F.lit(1.0)).otherwise(words_alike(n)) for n in (F.lit(0), F.least(only_x, only_y)))
    part_low = F.when(held, F.lit(1.0)).otherwise(F.coalesce(longest, F.lit(0)) / size)
    part_high = F.when(held, F.lit(1.0)).otherwise(2.0 * (size - 1) / (2 * size - 1))
    return 50.0 * (set_low + part_low), 50.0 * (set_high + part_high)


def bound_pairs(pairs: DataFrame, accepted_only: bool = False) -> DataFrame:
    """(q, text, low, high, left): what the best score over all wordings lies between, and the wordings that may be better than ``low``.

    Wordings are made once per phrase and once per text and bounded from their words and lengths.
    One that cannot beat the least score of another is not in ``left``. With ``accepted_only`` the
    pairs that cannot reach the least accepted score are left out.
    """
    both = pairs.join(_prepared(pairs, "q", True), "q").join(_prepared(pairs, "text", False), "text")
    q, t = F.col("q_p"), F.col("text_p")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("qv"), b.alias("ov"))

    wordings = F.concat(
        F.array(pair(q["norm"], t["norm"])),
        F.transform(q["others"], lambda v: pair(v, t["norm"])),
        F.transform(t["others"], lambda v: pair(q["norm"], v)),
    )
    written = F.contains(t["low"], q["low"]) | F.contains(t["vowel"], q["vowel"])
    exploded = both.select("q", "text", written.alias("written"), F.explode(wordings).alias("v")).select("q", "text", "written", "v.*")
    facts = structure()
    known = exploded.withColumn("sub", F.col("written") | F.contains("ov", F.col("qv")))
    known = known.withColumns({n: facts[n] for n in ("n_words", "n_found", "exact")})
    known = known.withColumn("typo", F.when(F.col("sub") | (F.col("n_found") == F.col("n_words")), F.lit(False)).otherwise(facts["typo"]))
    if accepted_only:
        known = known.where(F.col("sub") | (F.col("n_found") == F.col("n_words")) | F.col("typo"))
    least, most = ratio_bounds()
    bounded = known.withColumns({"low": score_column(least), "high": score_column(most)})
    wording = F.struct("high", "qv", "ov", "sub", "n_words", "n_found", "exact", "typo")
    per_pair = bounded.groupBy("q", "text").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.collect_list(wording).alias("left"))
    if accepted_only:
        per_pair = per_pair.where(F.col("high") >= MIN_SCORE_PRICED)
    return per_pair.withColumn("left", F.filter("left", lambda w: w["high"] > F.col("low")))


def settle(bounds: DataFrame) -> DataFrame:
    """(q, text, score) of pairs with bounds: only the wordings that are left go through the ratios."""
    bounds = cut_lineage(bounds)
    left = bounds.select("q", "text", F.explode("left").alias("w")).select("q", "text", "w.*")
    # the ratios are the expensive part: spread them over all tasks
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rated = left.repartition(tasks, "qv", "ov").withColumn("ratio", mean_ratio("qv", "ov")).select("q", "text", score_column(F.col("ratio")).alias("score"))
    return bounds.select("q", "text", F.col("low").alias("score")).unionByName(rated).groupBy("q", "text").agg(F.max("score").alias("score"))


def score_pairs(pairs: DataFrame, accepted_only: bool = False) -> DataFrame:
    """(q, text, score) for distinct (q, text) pairs: the best score over all wordings.

    A wording without common words and without a near typo scores at most 50; with
    ``accepted_only`` it is left out.
    """
    return settle(bound_pairs(pairs, accepted_only))


def score_column(ratio: Column) -> Column:
    """Score from the ratio and the word-level facts of one wording; it never falls when the ratio rises."""
    sub, every = F.col("sub"), F.col("n_found") == F.col("n_words")
    structural = sub | every
    typo = ~structural & F.col("typo")
    missing = (F.col("n_words") - F.col("n_found")) / F.col("n_words")
    score = (
        ratio
        + F.when(sub, 25).when(every, 15).otherwise(0)
        - F.when(structural & ~F.col("exact"), 8).otherwise(0)
        + F.when(typo, 20).otherwise(0)
        - F.when((F.col("n_words") >= 2) & ~structural, missing * 20).otherwise(0.0)
    )
    capped = F.when(~structural & ~typo, F.least(score, F.lit(50.0))).otherwise(score)
    return F.least(capped, F.lit(100.0))
