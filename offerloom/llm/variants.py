"""Spelling variant grouping: dense prefix-suffix tiles over padded code points.

Words are counted with built-in functions over whole texts. Two words of six letters or more that
are one edit apart agree in their first three code points or in their last three, so words meet
under these two keys, in blocks of at most ``BLOCK`` words; a key with more words is cut into
blocks that meet pair by pair. A tile compares two blocks densely: words of one length are a
padded matrix of code points, and for all pairs at once the common prefix and the common suffix
are counted position by position. If both together reach the longer length less one, the words
are a single edit apart. A pair that shares both keys counts under the first. A tile returns for
each word the number of its near words and the best of them, never the pairs.

Defined results: a null or empty text has no words; a null id stands in the checksum as nothing;
repeated rows count as often as they occur; of equally frequent near words the smallest in
code-point order is the form; words of any length are compared in strips of bounded size; an
empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ascii_lower, attach_groups, stored
from offerloom.llm.components import forest_roots

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least this many times as frequent as the word.
RATIO = 5
#: One in so many (document, run) loses a code point.
SLIP = 199
BLOCK = 2048
#: Cells of a strip of a matrix, and of a table of pairs.
CELLS = 1 << 22


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, n): lower-cased letter runs of all texts; where ``slip`` divides the checksum of id and run, the run loses a code point."""
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(docs[text]), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.pmod("h", F.lit(slip)) == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# Tiles


def code_points(words: list[str]) -> np.ndarray:
    """Matrix of the code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of rows, how many columns from the first on are equal."""
    alive = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.int32)
    for t in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, t, None] == b[None, :, t]
        if not alive.any():
            break
        length += alive
    return length


def single_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows, of one length or of lengths one apart, differ by exactly one inserted, deleted or replaced code point."""
    longer = max(a.shape[1], b.shape[1])
    # Padded to the longer length with signs that are equal to nothing: after the end for prefixes, before the start for suffixes.
    padded = [[np.pad(x, ((0, 0), (0, longer - x.shape[1]) if end else (longer - x.shape[1], 0)), constant_values=sign) for x, sign in ((a, 0), (b, 1))] for end in (True, False)]
    prefix = common_prefix(*padded[0])
    suffix = common_prefix(*(x[:, ::-1] for x in padded[1]))
    near = prefix + suffix >= longer - 1
    return near & (prefix < longer) if a.shape[1] == b.shape[1] else near


def _strips(members: np.ndarray, width: int) -> Iterator[np.ndarray]:
    rows = int(max(1, min(CELLS // max(1, width), CELLS**0.5)))
    for start in range(0, len(members), rows):
        yield members[start : start + rows]


def tile(words: list[str], counts: list[int], parts: list[int], first_key: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words with near ones in the tile: their places, the number of near ones and the place of the best.

    A tile holds one part, which meets itself, or two, which meet each other.
    """
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    sizes, part = np.array([len(words[i]) for i in order]), np.array([parts[i] for i in order])
    low, high = part.min(), part.max()
    n_near, best = np.zeros(len(order), np.int64), np.full(len(order), len(order))

    def note(mine: np.ndarray, theirs: np.ndarray, near: np.ndarray) -> None:
        """The tile is in the order of preference, so that the first near word is the best."""
        has = near.any(axis=1)
        n_near[mine] += near.sum(axis=1)
        best[mine[has]] = np.minimum(best[mine[has]], theirs[near[has].argmax(axis=1)])

    lengths = np.unique(sizes)
    for x in lengths:
        for y in (x, x + 1) if low == high else (x - 1, x, x + 1):
            same = low == high and x == y
            mine, theirs = np.flatnonzero((sizes == x) & (part == low)), np.flatnonzero((sizes == y) & (part == high))
            for some in _strips(mine, x):
                a = code_points([words[order[i]] for i in some])
                for others in _strips(theirs, y):
                    b = code_points([words[order[i]] for i in others])
                    near = single_edits(a, b)
                    if not first_key:
                        near &= ~(a[:, None, :3] == b[None, :, :3]).all(axis=2)
                    note(some, others, near)
                    if not same:
                        note(others, some, near.T)
    places, has = np.array(order), n_near > 0
    return places[has], n_near[has], places[best[has]]


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near ones."""
    key = F.array(F.struct(F.lit(True).alias("first"), F.substring("word", 1, 3).alias("key")), F.struct(F.lit(False).alias("first"), F.right("word", F.lit(3)).alias("key")))
    posted = stored(vocabulary.select("word", "n", F.explode(key).alias("k")).select("word", "n", "k.first", "k.key"), "variants-posted")
    sizes = stored(posted.groupBy("first", "key").agg(F.count("*").alias("size")).where("size > 1"), "variants-sizes")
    sized = attach_groups(posted, sizes, ["first", "key"], "size", posted.count())
    parts = F.ceil(F.col("size") / block)
    own = sized.withColumn("part", F.pmod(F.xxhash64("word"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = own.select("first", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "word", "n")

    def compare(table: pa.Table) -> pa.Table:
        words, counts, parts = (table[c].to_pylist() for c in ("word", "n", "part"))
        if table["i"][0] != table["j"][0] and len(set(parts)) == 1:
            words = []  # the other block is empty, and this one meets itself elsewhere
        none = np.zeros(0, np.int64)
        places, n_near, best = tile(words, counts, parts, table["first"][0].as_py()) if words else (none, none, none)
        return pa.table({
            "word": pa.array([words[i] for i in places], pa.string()), "n_near": pa.array(n_near, pa.int64()),
            "best": pa.array([words[i] for i in best], pa.string()), "best_n": pa.array([counts[i] for i in best], pa.int64()),
        })

    tiles = dealt.groupBy("first", "key", "i", "j").applyInArrow(compare, "word string, n_near long, best string, best_n long")
    merged = tiles.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return merged.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
    slip: int = SLIP, block: int = BLOCK,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``. ``min_length`` is six at least: below, an edit may touch both keys."""
    if min_length < 6:
        raise ValueError("words of fewer than six code points may share neither key with a near word")
    counted = word_counts(docs, id_col, text, slip)
    vocabulary = stored(counted.where((F.length("word") >= min_length) & (F.col("n") >= min_count)), "variants-words")
    near = near_words(vocabulary, block).withColumnRenamed("word", "w")
    chosen = F.col("best_n") >= F.col("n") * ratio
    formed = stored(
        vocabulary.join(near, F.col("word") == F.col("w"), "left").select(
            "word", F.when(chosen, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best_n")).alias("form_n")
        ),
        "variants-forms",
    )
    roots = forest_roots(formed.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent")))
    named = roots.select(F.col("node").alias("w"), F.col("parent").alias("root"))
    return formed.join(named, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
