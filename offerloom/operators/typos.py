"""Approximate substring search that finds every window within an edit limit.

A word with up to k edits still holds one of its k + 1 pieces unchanged. So the first letters of
each piece are looked up in an index of all short substrings of the spans that are searched, and
what stands before and after them is measured, on both sides with an edit distance of short
strings that stops at the limit. Nothing else bounds the search: no number of patterns, no length
of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import normalize_search_text, normalize_text, words
from offerloom.operators.scoring import near_word
from offerloom.session import cut_lineage

#: Letters of a piece that are looked up.
SEED = 4


def edit_limit(word: Column) -> Column:
    """No edit in words of one or two letters, one up to seven, two from eight letters on."""
    return F.when(F.length(word) < 3, 0).when(F.length(word) < 8, 1).otherwise(2)


def _seeds(word: Column, limit: Column) -> Column:
    """(seed, at): the first letters of each of ``limit`` + 1 pieces, and how many letters stand before it."""
    n, pieces = F.length(word), limit + 1

    def cut(j: Column) -> Column:
        start, end = F.floor(j * n / pieces).cast("int"), F.floor((j + 1) * n / pieces).cast("int")
        return F.struct(F.substring(word, start + 1, F.least(end - start, F.lit(SEED))).alias("seed"), start.alias("at"))

    return F.transform(F.sequence(F.lit(0), limit), cut)


def _index(span: Column) -> Column:
    """(seed, pos): every substring of up to ``SEED`` letters and where it starts, counted from one."""
    def of_size(size: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.length(span)), lambda i: i + (size - 1) <= F.length(span))
        return F.transform(starts, lambda i: F.struct(F.substring(span, i, F.lit(size)).alias("seed"), i.alias("pos")))

    return F.concat(*[of_size(size) for size in range(1, SEED + 1)])


def _least_edits(part: Column, windows: Column) -> Column:
    """Fewest edits between a part of a word and one of the windows, three or more counted as three."""
    edits = F.transform(windows, lambda w: F.levenshtein(part, w, 2))
    return F.coalesce(F.array_min(F.filter(edits, lambda e: e >= 0)), F.lit(3))


def _edits_around(form: Column, span: Column, seed: Column, at: Column, pos: Column, limit: Column) -> Column:
    """Edits of the best window of ``span`` that holds the seed of ``form`` at ``pos``."""
    before, after = F.substring(form, F.lit(1), at), F.substring(form, at + 1 + F.length(seed), F.length(form))
    end = pos + F.length(seed)
    left = F.sequence(F.greatest(at - limit, F.lit(0)), F.least(at + limit, pos - 1))
    right = F.sequence(F.greatest(F.length(after) - limit, F.lit(0)), F.least(F.length(after) + limit, F.length(span) - end + 1))
    no_room = F.lit(3)
    on_left = F.when(at == 0, 0).when(pos - 1 < at - limit, no_room).otherwise(_least_edits(before, F.transform(left, lambda n: F.substring(span, pos - n, n))))
    on_right = F.when(F.length(after) == 0, 0).when(F.length(span) - end + 1 < F.length(after) - limit, no_room).otherwise(
        _least_edits(after, F.transform(right, lambda n: F.substring(span, end, n)))
    )
    return on_left + on_right


def close_spans(forms: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct (form, span) where some window of the span is within ``edit_limit`` of the form.

    ``forms`` has the distinct column form, ``spans`` the distinct column span. Seeds that no form
    asks for leave the index before anything is measured.
    """
    limit = edit_limit(F.col("form"))
    asked = forms.where("form <> ''").select("form", limit.alias("limit"), F.explode(_seeds(F.col("form"), limit)).alias("s")).select("form", "limit", "s.seed", "s.at")
    held = spans.where("span <> ''").select("span", F.explode(_index(F.col("span"))).alias("s")).select("span", "s.seed", "s.pos")
    met = held.join(asked, "seed")
    edits = _edits_around(F.col("form"), F.col("span"), F.col("seed"), F.col("at"), F.col("pos"), F.col("limit"))
    return met.where(edits <= F.col("limit")).select("form", "span").distinct()


def word_runs(tokens: Column, longest: int) -> Column:
    """Runs of neighbouring words, joined by spaces: ``longest`` words each, or all words of a shorter text.

    A window within k edits of a word crosses k spaces at most, so runs of k + 1 words hold every window.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (longest - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, longest), " ")))


def all_words_met(found: DataFrame, held: DataFrame, sizes: DataFrame, doc_id: str) -> DataFrame:
    """(q, doc) in which each of a query's words is met: ``found`` (q, token_no, span), ``held`` (span, doc), ``sizes`` (q, n_tokens).

    The word of a query whose spans have the fewest documents gives the candidates; only they are
    joined with what the other words found, so that a word of all documents is not expanded.
    """
    found = found.distinct()
    held = held.distinct()
    frequency = held.groupBy("span").agg(F.count(F.lit(1)).alias("docs"))
    cost = found.join(frequency, "span").groupBy("q", "token_no").agg(F.sum("docs").alias("docs"))
    first = cost.groupBy("q").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("docs", "token_no"))["token_no"].alias("first"))
    first = first.join(sizes, "q").where("met = n_tokens").select("q", "n_tokens", "first")
    candidates = found.join(first, "q").where("token_no = first").select("q", "n_tokens", "first", "span").join(held, "span").select("q", "n_tokens", "first", doc_id).distinct()
    alone = candidates.where("n_tokens = 1").select("q", doc_id)
    others = candidates.where("n_tokens > 1").join(held, doc_id).join(found, ["q", "span"]).where("token_no <> first")
    several = others.groupBy("q", doc_id).agg(F.count_distinct("token_no").alias("met"), F.first("n_tokens").alias("n")).where("met = n - 1").select("q", doc_id)
    return alone.unionByName(several)


def typo_search(forms: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, text): for every word of the query some form is within its edit limit of a window of the normalised text.

    ``forms`` is (q, n_tokens, token_no, form), ``texts`` has the distinct column text.
    """
    tokens = words(normalize_search_text(F.col("text")))
    forms = cut_lineage(forms)
    asked, limit = forms.select("form").distinct(), edit_limit(F.col("form"))
    held, near = [], []
    for longest, kind in ((2, asked.where(limit < 2)), (3, asked.where(limit == 2))):
        held.append(cut_lineage(texts.select("text", F.explode(word_runs(tokens, longest)).alias("span"))))
        near.append(close_spans(kind, held[-1].select("span").distinct()))
    found = forms.join(near[0].unionByName(near[1]), "form").select("q", "token_no", "span")
    return all_words_met(cut_lineage(found), held[0].unionByName(held[1]), forms.select("q", "n_tokens").distinct(), "text")


def typo_test(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(q, text): every query word has five or more letters and is near some word of the text (``scoring.near_word``).

    Words that are near hold a window within the edit limit, so that the same search gives the candidates.
    """
    tokens = words(normalize_text(F.col("q")))
    asked = queries.select("q", F.size(tokens).alias("n_tokens"), F.posexplode(tokens).alias("token_no", "form"))
    held = cut_lineage(texts.select("text", F.explode(F.array_distinct(words(normalize_text(F.col("text"))))).alias("span")))
    pairs = close_spans(asked.where(F.length("form") >= 5).select("form").distinct(), held.select("span").distinct())
    near = pairs.where(near_word(F.col("form"), F.col("span")))
    return all_words_met(cut_lineage(asked.join(near, "form").select("q", "token_no", "span")), held, asked.select("q", "n_tokens").distinct(), "text")
