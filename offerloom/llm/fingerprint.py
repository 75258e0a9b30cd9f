"""Document fingerprints: threshold-scaled sketches of word shingles, from built-in functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and always the
smallest hash, so that no sketch is empty. Its size grows with the document; the sketch of a
union is made from the sketches of its parts. The likeness of two documents is the containment of
their two sketches and nothing else, so sketches say little of documents with few shingles: one of
m shingles has none below the limit with probability (1 - 1 / SCALE) ** m and then is found in a
longer document only if that keeps the same smallest hash.

Defined results: a null text is empty; a text of fewer than five words is one shingle; of the
documents in ascending id, rows with equal ids follow one another by the hash of their text and
rows without id come last; after the last comes the first, so one document alone follows itself;
an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import WORD

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4
#: Most groups of neighbouring ids, and rows looked at for each to find the bounds; the groups' first rows are broadcast.
MAX_GROUPS = 4_096
LOOKED_AT = 16


def _below(hashes: Column, scale: int) -> Column:
    """The retained part of an array of hashes in [0, 2**63), sorted."""
    last = F.lit(2**63 // scale - 1)
    return F.array_sort(F.array_distinct(F.concat(F.array(F.array_min(hashes)), F.filter(hashes, lambda h: h <= last))))


def sketch(text: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Sorted array of the retained shingle hashes of a text."""

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (shingle - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(words, i, shingle)), 1))

    words = F.array(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})")))
    return F.transform(F.transform(words, of), lambda hashes: _below(hashes, scale))[0]


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two documents' shingles."""
    return _below(F.concat(a, b), scale)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other one has, 0 to 1."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def resemblance(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity."""
    union = merged(a, b, scale)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def _bounds(keyed: DataFrame, tie: str, n: int) -> list[tuple]:
    """(key, tie) at which groups of about equal size begin, from a sample of the rows."""
    groups = max(1, min(MAX_GROUPS, n // 2048))
    if groups == 1:
        return []
    looked_at = sorted(tuple(r) for r in keyed.select("__key", tie).sample(min(1.0, LOOKED_AT * groups / n), 7).collect())
    return sorted(set(looked_at[LOOKED_AT::LOOKED_AT]))


def _group(bounds: list[tuple], key: Column, tie: Column) -> Column:
    """How many bounds are at or below (key, tie), by halving."""
    if not bounds:
        return F.lit(0).cast("long")
    keys, ties = (F.array(*map(F.lit, x)) for x in zip(*bounds, strict=True))
    keys = keys.cast("array<decimal(20,0)>")

    def halve(at: Column, step: Column) -> Column:
        i = (at + step - 1).cast("int")
        at_or_below = (F.get(keys, i) < key) | ((F.get(keys, i) == key) & (F.get(ties, i) <= tie))
        return F.when(F.coalesce(at_or_below, F.lit(False)), at + step).otherwise(at)

    steps = F.array(*(F.lit(2**k).cast("long") for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0).cast("long"), halve)


def with_next(rows: DataFrame, id_col: str, tie: str, values: list[str]) -> DataFrame:
    """``rows`` with ``next_<value>`` of the row that follows in ascending id, the first after the last.

    Rows meet in groups of neighbouring ids; the first row of each group also goes to the group
    before it. There are at most ``MAX_GROUPS`` groups, however many rows.
    """
    high, n = rows.agg(F.max(id_col), F.count("*")).first()
    key = F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(Decimal((high if high is not None else 0) + 1)).cast("decimal(20,0)"))
    keyed = rows.withColumn("__key", key)
    placed = keyed.withColumn("__group", _group(_bounds(keyed, tie, n), F.col("__key"), F.col(tie)))
    firsts = placed.groupBy("__group").agg(F.min(F.struct("__key", tie)).alias("__first"))
    order = Window.orderBy("__group")
    before = F.coalesce(F.lag("__group").over(order), F.max("__group").over(Window.partitionBy()))
    firsts = firsts.select(F.col("__first.__key").alias("__key"), F.col(f"__first.{tie}").alias(tie), before.alias("__also"))
    both = placed.join(F.broadcast(firsts), ["__key", tie], "left")
    stops = F.filter(F.array(F.struct(F.col("__group").alias("group"), F.lit(False).alias("lent")), F.struct(F.col("__also").alias("group"), F.lit(True).alias("lent"))), lambda s: s["group"].isNotNull())
    dealt = both.withColumn("__stop", F.explode(stops)).select("*", "__stop.*")
    w = Window.partitionBy("group").orderBy("lent", "__key", tie)
    found = dealt.withColumns({f"next_{v}": F.lead(v).over(w) for v in values}).where("not lent")
    return found.select(*rows.columns, *[f"next_{v}" for v in values])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per document: its sketch, that of its edited text and how alike they and the next document's are."""
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[id_col].alias(id_col), body.alias("text"), F.xxhash64(body).alias("__tie"), sketch(body, scale).alias("sketch"))
    met = with_next(rows, id_col, "__tie", ["text", "sketch"])
    length = F.char_length("text")
    moved = F.floor(length / 4).cast("int")
    edited = met.select(
        id_col, length.cast("long").alias("n_chars"), "sketch", "next_sketch",
        F.concat(F.substring("text", F.lit(1), length - moved), F.substring("next_text", F.lit(1), moved)).alias("edited"),
    )
    known = edited.withColumn("edited_sketch", sketch(F.col("edited"), scale))
    own, new, following = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return known.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(new).alias("edited_fingerprint"),
        containment(own, new).alias("near_edited"), containment(own, following).alias("near_next"),
        resemblance(own, new, scale).alias("jaccard_edited"), resemblance(own, following, scale).alias("jaccard_next"),
    )
