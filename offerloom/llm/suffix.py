"""Substring deduplication with enhanced suffix arrays over sampled suffixes.

Every string of ``span`` bytes contains an anchor: the position of the smallest hash among its
``GRAM``-byte substrings (winnowing). Equal strings have their anchor at the same place, so each
string of a document belongs to one anchor, and the strings of one anchor are a short context
around it. Suffixes are sampled at the anchors and meet by the hash of their first ``GRAM``
bytes; what occurs once is dropped there. Anchors with equal contexts are repeats as a whole and
are counted with pre-aggregation, so a passage that a third of all documents share is a number.
Only differing contexts of one anchor are compared as text: they are sorted into a suffix array,
a stack scan over its common prefixes gives the interval tree, and the members of each interval
are told apart by how far they also agree to the left. This yields the maximal repeats with all
their occurrences, and for each occurrence how many bytes it covers on either side. Anchors with
more than ``CROWD`` differing contexts are not gathered: their strings are counted by hash.

Defined results: a null text is empty; texts shorter than ``span`` lose nothing; copies, also
repeated rows, lose all their strings; an empty table gives an empty table; further columns are
left out. Matches never cross documents. Texts are read in blocks of bytes, so that long ones
need no more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.bloom import blocks_for, flagged, present_filter
from offerloom.llm.common import attach_groups, stored
from offerloom.llm.shingles import _Powers, mix

SPAN = 200
GRAM = 64
CROWD = 2_000
#: Starts of strings looked at together.
BLOCK = 1 << 20


def _running(data: np.ndarray) -> np.ndarray:
    up, _ = _Powers.of(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])


def _hash_of(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    _, down = _Powers.of(len(running))
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def anchors_of(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(position, lo, hi, anchor hash, context hash): the strings that start ``lo`` to ``hi`` bytes before the position are its own."""
    parts = []
    for first in range(0, len(data) - span + 1, BLOCK):
        piece = data[first : first + BLOCK + span - 1]
        running = _running(piece)
        at = np.arange(len(piece) - gram + 1)
        hashes = _hash_of(running, at, at + gram)
        # Smallest hash, leftmost of equals: hash bits above, position below.
        low = (hashes & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        width, want = 1, span - gram + 1
        while width * 2 <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < want:
            low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
        chosen = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        end = np.concatenate([begin[1:], [len(chosen)]]) - 1
        spot = chosen[begin]
        hi, lo = spot - begin, spot - end
        context = mix(_hash_of(running, begin, end + span) + (hi * 4096 + lo).astype(np.uint64))
        parts.append((spot + first, lo, hi, hashes[spot], context))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))


def _row_key(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    body = F.coalesce(docs[text], F.lit(""))
    return [docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("")), body).alias("h"), body.alias("text")]


def anchor_rows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """One row per anchor of (id, h, text)."""
    kind = dict(docs.dtypes)["id"]

    def packed(batch: pa.RecordBatch, found: list[tuple[int, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
        at, lo, hi, anchor, context = (np.concatenate(x) for x in zip(*(f for _, f in found), strict=True))
        who = pa.array(np.repeat([i for i, _ in found], [len(f[0]) for _, f in found]))
        columns = [at.astype(np.int32), lo.astype(np.int16), hi.astype(np.int16), anchor.view(np.int64), context.view(np.int64)]
        names = ["id", "h", "at", "lo", "hi", "anchor", "context"]
        return pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), *map(pa.array, columns)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for i, text in enumerate(batch.column(2)):
                found = anchors_of(np.frombuffer(text.as_py().encode("utf-8", "replace"), np.uint8), span, gram)
                if len(found[0]):
                    held.append((i, found))
                    rows += len(found[0])
                if rows > 200_000:
                    yield packed(batch, held)
                    held, rows = [], 0
            if held:
                yield packed(batch, held)

    return docs.mapInArrow(scan, f"id {kind}, h long, at int, lo short, hi short, anchor long, context long")


# Interval tree


def common_prefix(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low = 0
    while most - low > 1:
        middle = (low + most) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            most = middle
    return low


def lcp_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of an array's common prefix lengths with at least ``least``; lcp[i] is between i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        here, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > here:
            length, first = stack.pop()
            yield length, first, i - 1
        if here >= least and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def repeat_groups(lefts: list[bytes], rights: list[bytes], span: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats around one anchor: (bytes to the left, bytes to the right, all members), at least ``span`` bytes together.

    ``rights`` are the suffixes at the anchor; ``lefts`` what stands before it, reversed. An
    interval of the suffix array is a set that agrees to the right and no further; it is cut by
    the same scan over the reversed lefts into sets that agree to the left and no further.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    rank = {x: i for i, x in enumerate(order)}
    longest_left = max(map(len, lefts))
    for right, first, last in lcp_intervals(lcp, max(1, span - longest_left)):
        members = sorted(order[first : last + 1], key=lefts.__getitem__)
        agree = [0] + [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        for left, start, stop in lcp_intervals(agree, max(0, span - right)):
            group = members[start : stop + 1]
            ranks = [rank[x] for x in group]
            # A set inside one smaller interval agrees further to the right and is reported there.
            if min(lcp[min(ranks) + 1 : max(ranks) + 1]) == right:
                yield left, right, group


def covered(lefts: list[bytes], rights: list[bytes], span: int) -> list[tuple[int, int]]:
    """For each context, the bytes left and right of the anchor that its repeats cover; (0, 0): none."""
    if len(lefts) == 2:
        left, right = common_prefix(*lefts), common_prefix(*rights)
        return [(left, right) if left + right >= span else (0, 0)] * 2
    found = [(0, 0)] * len(lefts)
    for left, right, group in repeat_groups(lefts, rights, span):
        for x in group:
            found[x] = (max(found[x][0], left), max(found[x][1], right))
    return found


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted documents, joined with ``wanted`` (id, h, ...); other texts are not shuffled."""
    blocks = blocks_for(wanted.count())
    near = flagged(docs, "h", present_filter(wanted, "h", blocks), blocks).where("__maybe").select("id", "h", "text")
    return near.alias("n").join(wanted.alias("w"), (F.col("n.h") == F.col("w.h")) & F.col("n.id").eqNullSafe(F.col("w.id"))).select("w.*", "n.text")


def edge_intervals(docs: DataFrame, classes: DataFrame, span: int) -> DataFrame:
    """(id, h, start, stop) of what the contexts that occur once share with others of the same anchor.

    ``classes``: (anchor, context, n, ref, contexts) with one row per differing context.
    """
    refs = classes.groupBy("ref.id", "ref.h").agg(
        F.collect_list(F.struct("anchor", "context", "n", "ref.at", "ref.lo", "ref.hi", (F.col("contexts") > CROWD).alias("crowd"))).alias("refs")
    )
    kind = dict(docs.dtypes)["id"]
    where = f"id {kind}, h long, at int"

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The context of each class, or for crowds the hash of each of its strings."""
        names = ["id", "h", "at", "anchor", "n", "lo", "hi", "left", "right", "place", "string"]
        types = [None, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.binary(), pa.int16(), pa.int64()]
        for batch in batches:
            types[0] = batch.schema.field("id").type
            out = []
            for i in range(batch.num_rows):
                who, h = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = batch.column(3)[i].as_py().encode("utf-8", "replace")
                for r in batch.column(2)[i].as_py():
                    at, lo, hi = r["at"], r["lo"], r["hi"]
                    piece = data[at - hi : at - lo + span]
                    row = (who, h, at, r["anchor"], r["n"], lo, hi)
                    if r["crowd"]:
                        starts = np.arange(hi - lo + 1)
                        hashes = _hash_of(_running(np.frombuffer(piece, np.uint8)), starts, starts + span).view(np.int64)
                        out.extend((*row, None, None, hi - int(s), int(x)) for s, x in zip(starts, hashes, strict=True))
                    else:
                        out.append((*row, piece[:hi][::-1], piece[hi:], None, None))
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    texts = _texts_of(docs, stored(refs, "suffix-refs")).select("id", "h", "refs", "text")
    found = texts.mapInArrow(contexts, f"{where}, anchor long, n long, lo short, hi short, left binary, right binary, place short, string long")
    found = stored(found, "suffix-contexts")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "at", "before", "after"]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

        out, id_type = [], None
        for _, group in groupby(rows(), key=lambda r: r[3]):
            members = list(group)
            for (who, h, at, _, n, left, right), (before, after) in zip(members, covered([m[5] for m in members], [m[6] for m in members], span), strict=True):
                if n == 1 and after:
                    out.append((who, h, at, before, after))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [pa.int64() if kind == "bigint" else None, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    together = found.where("string is null").select("id", "h", "at", "anchor", "n", "left", "right").repartition("anchor").sortWithinPartitions("anchor")
    by_tree = together.mapInArrow(trees, f"{where}, before int, after int")
    strings = found.where("string is not null")
    twice = stored(strings.groupBy("anchor", "place", "string").count().where("count > 1").drop("count"), "suffix-strings")
    by_hash = (
        strings.where("n = 1").join(twice, ["anchor", "place", "string"]).groupBy("id", "h", "at")
        .agg(F.max("place").cast("int").alias("before"), (F.lit(span) - F.min("place")).cast("int").alias("after"))
    )
    return by_tree.unionByName(by_hash).select("id", "h", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("stop"))


def repeated_intervals(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, h, start, stop): byte ranges of (id, h, text) that together are all bytes of repeated strings."""
    anchors = stored(anchor_rows(docs, span, gram), "suffix-anchors")
    groups = anchors.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("differ")).where("n > 1")
    groups = stored(groups.select("anchor", "differ"), "suffix-repeated")
    blocks = blocks_for(groups.count())
    hashed = groups.select(F.xxhash64("anchor").alias("__a"))
    near = flagged(anchors.withColumn("__a", F.xxhash64("anchor")), "__a", present_filter(hashed, "__a", blocks), blocks).where("__maybe").drop("__a", "__maybe")
    met = stored(near.join(groups, "anchor"), "suffix-met")
    differ = met.where("differ")
    classes = differ.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "at", "lo", "hi")).alias("ref"))
    classes = stored(classes, "suffix-classes")
    crowds = stored(classes.groupBy("anchor").agg(F.count("*").alias("contexts")), "suffix-crowds")
    edges = edge_intervals(docs, classes.join(crowds, "anchor"), span)
    whole = [(F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + span).alias("stop")]
    same = met.where("not differ").select("id", "h", *whole)
    again = classes.where("n > 1").select("anchor", "context", "n")
    copies = attach_groups(differ.drop("differ"), again, ["anchor", "context"], "n", met.count()).select("id", "h", *whole)
    return same.unionByName(copies).unionByName(edges)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept`` (binary) if asked for."""
    keyed = docs.select(*_row_key(docs, id_col, text))
    found = repeated_intervals(keyed, span, gram)
    merged = stored(found.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), "suffix-spans")
    blocks = blocks_for(merged.count())
    probed = flagged(keyed, "h", present_filter(merged, "h", blocks), blocks)
    clean = probed.where("not __maybe")
    cut = probed.where("__maybe").alias("d").join(merged.alias("m"), (F.col("d.h") == F.col("m.h")) & F.col("d.id").eqNullSafe(F.col("m.id")), "left").select("d.id", "d.text", "m.spans")

    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:binary>")
    def remove(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for value, ranges in zip(texts, spans, strict=True):
            data, kept, done, runs = value.encode("utf-8", "replace"), [], 0, 0
            for r in ranges if ranges is not None else ():
                start, stop = (r["start"], r["stop"]) if isinstance(r, dict) else r
                if start > done or runs == 0:
                    kept.append(data[done:start])
                    runs += 1
                done = max(done, stop)
            kept.append(data[done:])
            rest = b"".join(kept)
            rows.append((len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest if with_kept else None))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
    after = cut.withColumn("__r", remove("text", "spans")).select(F.col("id").alias(id_col), *[F.col(f"__r.{c}").alias(c) for c in columns])
    zero = F.lit(0).cast("long")
    whole = {
        "n_bytes": F.octet_length("text").cast("long"), "n_removed": zero, "n_spans": zero, "kept_sha256": F.sha2("text", 256), "kept": F.encode("text", "UTF-8"),
    }
    before = clean.select(F.col("id").alias(id_col), *[whole[c].alias(c) for c in columns])
    return before.unionByName(after)
