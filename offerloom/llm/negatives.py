"""Hard-negative mining: Strassen products of integer tiles, then heaps that merge.

Vectors become integers (the floor of ``scale`` times each component). Anchors are dealt into
blocks, all rows into slices; a block meets every slice once, as a tile whose scores are one
product of two integer matrices by Strassen's recursion with zero padding. Sums of 64-bit integers
are exact modulo 2 ** 64 however large the recursion's intermediate sums get, so a product is exact
if its scores fit 64 bits; a tile where they might not is multiplied with Python's integers.

The first pass keeps the best ``positives`` rows of the anchor's label per anchor and tile, the
second, once the positive scores are known, the best ``negatives`` of each score window. Both
heaps merge by the same order (score down, id up), tile by tile: what is shuffled is bounded by
tiles, not by pairs.

Defined results: a row with a null label or vector, or with a null or non-finite component, takes
no part; vectors of unlike lengths are padded with zeros, an empty one is all zeros; rows that
share an anchor's id are never its positive or negative; a row without id is no anchor and comes
after all others of its score; repeated rows count as often as they occur, and a repeated anchor
gives its results as often; a score beyond 64 bits counts as the nearest long; an empty table
gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import stored

BLOCK = 1024
SLICE = 8192
LEAF = 32
LONGS = np.iinfo(np.int64)


def _padded(matrix: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if matrix.shape == (rows, columns):
        return matrix
    full = np.zeros((rows, columns), matrix.dtype)
    full[: matrix.shape[0], : matrix.shape[1]] = matrix
    return full


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` in seven products of half size a level, until a side has at most ``leaf``."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    m2, k2, n2 = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = _padded(a, 2 * m2, 2 * k2), _padded(b, 2 * k2, 2 * n2)
    a11, a12, a21, a22 = a[:m2, :k2], a[:m2, k2:], a[m2:, :k2], a[m2:, k2:]
    b11, b12, b21, b22 = b[:k2, :n2], b[:k2, n2:], b[k2:, :n2], b[k2:, n2:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m2, 2 * n2), a.dtype)
    out[:m2, :n2] = p1 + p4 - p5 + p7
    out[:m2, n2:] = p3 + p5
    out[m2:, :n2] = p2 + p4
    out[m2:, n2:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _whole(x: float, scale: int) -> int:
    """Floor of ``scale * x`` without leaving the integers."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def _matrix(vectors: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """Floors of ``scale`` times the components, a row a vector: 64-bit integers, or Python's where a component needs them."""
    values = pc.list_flatten(vectors).to_numpy().astype(float)
    sizes = pc.list_value_length(vectors).to_numpy()
    plain = float(np.abs(values).max(initial=0)) * scale < 2.0**53
    out = np.zeros((len(sizes), width), np.int64 if plain else object)
    out[np.arange(width) < sizes[:, None]] = np.floor(values * scale).astype(np.int64) if plain else [_whole(x, scale) for x in values.tolist()]
    return out


def scores(anchors: pa.ChunkedArray, rows: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Inner products of all anchors with all rows of a tile."""
    width = max(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (anchors, rows))
    a, b = (_matrix(x, width, scale) for x in (anchors, rows))
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype == object or b.dtype == object or width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) >= 2.0**62:
        return np.clip(a.astype(object) @ b.astype(object).T, LONGS.min, LONGS.max).astype(np.int64)
    return strassen(a, np.ascontiguousarray(b.T))


Heap = Callable[[dict, np.ndarray, np.ndarray], list[tuple[int, np.ndarray]]]


def _tile_heaps(scale: int, heap: Heap) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a tile adds to the heaps: (anchor, place, id, score), from rows in the order of ids."""

    def tile(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end"))
            known = pc.is_valid(rows["id"]).to_numpy()
            ids, labels = pc.fill_null(rows["id"], 0).to_numpy(), rows["label"].to_numpy()
            table = scores(anchors["vec"], rows["vec"], scale)
            for i, anchor in enumerate(anchors.drop_columns(["vec"]).to_pylist()):
                other = ~known | (ids != anchor["id"])
                for place, picked in heap(anchor, table[i], np.where(other, labels == anchor["label"], False) * 2 + other):
                    n = len(picked)
                    found.append((np.full(n, anchor["row"]), np.full(n, place), ids[picked], known[picked], table[i][picked]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, np.int64)]
        return pa.table({"anchor": parts[0], "place": pa.array(parts[1], pa.int32()), "id": pa.array(parts[2], pa.int64(), mask=~parts[3]), "score": parts[4]})

    return tile


def _first(candidates: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` candidates by score down; equal ones stay in their order. Complements order downwards without overflow."""
    if len(candidates) > n:
        candidates = candidates[line[candidates] >= np.partition(line[candidates], len(candidates) - n)[len(candidates) - n]]
    return candidates[np.argsort(~line[candidates], kind="stable")[:n]]


def _positive_heap(n: int) -> Heap:
    return lambda anchor, line, kind: [(0, _first(np.flatnonzero(kind == 3), line, n))]


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole score between ``low`` and ``high`` per cent of ``score``."""
    return -(-low * score // 100), high * score // 100


def _window_heaps(n: int, low: int, high: int) -> Heap:
    def heaps(anchor: dict, line: np.ndarray, kind: np.ndarray) -> list[tuple[int, np.ndarray]]:
        windows = [window_of(score, low, high) for score in anchor["positive_scores"]]
        inside = (kind == 1) & (line >= min(w[0] for w in windows)) & (line <= max(w[1] for w in windows))
        falling = np.flatnonzero(inside)
        falling = falling[np.argsort(~line[falling], kind="stable")]
        rising = ~line[falling]
        spans = [(np.searchsorted(rising, ~most, "left"), np.searchsorted(rising, ~least, "right")) for least, most in windows]
        return [(place, falling[start : min(end, start + n)]) for place, (start, end) in enumerate(spans, 1) if start < end]

    return heaps


def _tiles(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, scale: int, heap: Heap) -> DataFrame:
    """Every block of anchors with every slice of rows, once."""
    left = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    right = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    apply = _tile_heaps(scale, heap)

    def tile(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        return apply(anchors, rows)

    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(tile, "anchor long, place int, id long, score long")


def _merged(heaps: DataFrame, n: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, label: str | Column = "label", id_col: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = BLOCK, slice_rows: int = SLICE,
) -> DataFrame:
    """One row per anchor, positive and hard negative; ``is_anchor`` is a condition on ``vectors``."""
    group = vectors[label] if isinstance(label, str) else label
    fine = F.forall(vectors[vector], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    chosen = vectors.where(vectors[vector].isNotNull() & group.isNotNull() & fine).select(
        vectors[id_col].cast("long").alias("id"), group.cast("long").alias("label"), vectors[vector].alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("leads")
    )
    rows = stored(chosen.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if("leads").alias("anchors")).first()
    blocks, slices = (max(1, -(-n // most)) for n, most in ((sizes["anchors"], block), (sizes["rows"], slice_rows)))
    anchors = rows.where("leads").select("row", "id", "label", "vec").toDF("row", "id", "label", "vec")
    rows = rows.select("row", "id", "label", "vec")

    nearest = stored(_merged(_tiles(anchors, rows, blocks, slices, scale, _positive_heap(positives)), positives, "anchor"), "negatives-positives")
    listed = nearest.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score")))["score"].alias("positive_scores"))
    ready = anchors.join(listed, anchors["row"] == listed["anchor"]).drop("anchor")
    hard = _merged(_tiles(ready, rows, blocks, slices, scale, _window_heaps(negatives, low, high)), negatives, "anchor", "place")
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    paired = nearest.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(named, "anchor")
    return hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(paired, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
