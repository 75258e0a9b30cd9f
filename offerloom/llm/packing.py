"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A bin is filled greedily with the longest documents that still fit; then its smallest document
is given up for the two unpacked documents that fill the gap it leaves more tightly, as long as
that helps. Only lengths matter for that, so the plan is made from the histogram of lengths
(at most ``capacity`` counts, whatever the number of documents): equal bins are made as many
times as the counts allow. Pieces are then numbered within their length in two steps, hash
bucket totals first, so that no length has to be ranked in one task, and look their place up.

Defined results: a null text is empty, and an empty document is the end id alone; only
documents over the capacity are cut; repeated rows are packed like any other; an empty table
gives an empty table; further columns are left out. Bound: the plan, which every task holds,
has at most a few places for each length and bin shape.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import stored
from offerloom.llm.encoding import encoder

#: Characters encoded at a time; bounds the memory of a task.
CHARS = 1_000_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: id, piece, start, length, ids_crc32, and ``ids`` if asked for."""
    chosen = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text], F.lit("")).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, end_id)
        for batch in batches:
            # A worker lives as long as its executor: what earlier batches and stages have freed goes back.
            pa.default_memory_pool().release_unused()
            texts, lo = batch.column(1), 0
            while lo < batch.num_rows:
                part, chars, hi = [], 0, lo
                while hi < batch.num_rows and (hi == lo or chars < CHARS):
                    part.append(texts[hi].as_py())
                    chars += len(part[-1])
                    hi += 1
                rows = [
                    (lo + i, k, k * capacity, piece)
                    for i, coded in enumerate(tool.encode(part))
                    for k, piece in enumerate(coded[a : a + capacity] for a in range(0, len(coded), capacity))
                ]
                columns = [
                    batch.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[3].astype("<u4").tobytes()) for r in rows], pa.int64()),
                ]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                lo = hi

    return chosen.mapInArrow(cut, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bin shapes (lengths, longest first) and how many times each is made; uses up all counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    bins = []
    while lengths:
        used: dict[int, int] = {}

        def free(n: int, more: int = 1, used: dict[int, int] = used) -> bool:
            return left[n] - used.get(n, 0) >= more

        def longest(most: int) -> int | None:
            i = bisect_right(lengths, most) - 1
            while i >= 0 and not free(lengths[i]):
                i -= 1
            return lengths[i] if i >= 0 else None

        shape, gap = [], capacity
        while gap and (n := longest(gap)) is not None:
            shape.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        while gap and shape:
            small = shape[-1]
            room, best = gap + small, None
            open_ = np.array([n for n in lengths[: bisect_right(lengths, room)] if free(n)])
            if len(open_) == 0:
                break
            mate = np.searchsorted(open_, np.minimum(room - open_, open_), "right") - 1
            mate[(mate >= 0) & (open_[mate] == open_) & np.array([not free(int(n), 2) for n in open_])] -= 1
            total = np.where(mate >= 0, open_ + open_[mate], 0)
            best = int(np.argmax(total))
            if total[best] <= small:
                break
            shape.pop()
            used[small] -= 1
            for n in (int(open_[best]), int(open_[mate[best]])):
                shape.append(n)
                used[n] = used.get(n, 0) + 1
            shape.sort(reverse=True)
            gap = room - int(total[best])
        used = {n: u for n, u in used.items() if u}
        times = min(left[n] // u for n, u in used.items())
        bins.append((shape, times))
        for n, u in used.items():
            left[n] -= u * times
        if any(left[n] == 0 for n in used):
            lengths = [n for n in lengths if left[n]]
    return bins


def place_table(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (key, first sequence, offset), sorted by key = length * 2**40 + first rank; a rank takes the row at or before it."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for shape, times in bins:
        offset = 0
        for n in shape:
            first = taken.get(n, 0)
            rows.append((n * 2**40 + first, sequence, offset))
            taken[n] = first + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (stored) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = pieces.sparkSession.sparkContext.broadcast(place_table(plan_bins(counts, capacity)))
    buckets = max(1, min(4096, sum(counts.values()) // 1000))
    dealt = pieces.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    by_bucket = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "__b").count().select("length", "__b", F.coalesce(F.sum("count").over(by_bucket), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__b").orderBy(id_col, "piece", "ids_crc32")
    ranked = dealt.join(stored(sizes, "pack-buckets"), ["length", "__b"]).withColumn("__rank", F.col("__before") + F.row_number().over(within) - 1)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = places.value
        key = length.to_numpy() * 2**40 + rank.to_numpy()
        at = np.searchsorted(table[:, 0], key, "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 1] + key - table[at, 0], "offset": table[at, 2]})

    return ranked.withColumn("__p", place("length", "__rank")).select(*pieces.columns, "__p.*")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and its place there."""
    return pack_pieces(stored(token_pieces(docs, tokenizer, capacity, end_id, id_col, text, ids), "pack-pieces"), capacity, id_col)
