"""MinHash near-duplicate detection by an inverted join over signature coordinates.

Texts with equal shingle sets are one class. Two classes above the similarity threshold agree
in at least ``matches`` of the coordinates (up to a miss rate of about 1 in 100,000 at the
threshold, less above it). Coordinates are taken by twos where those that may differ cannot spoil
all twos: of 32 twos, 28 coordinates spoil 28 at most, so partners have four in common for certain.
Classes of unlike texts share a two far less often than a single value. Twos that only one class has cannot match, a class
with too few shared ones has no partner, and of the others only the rarest, one more than may
fail, have to be posted: two partners must meet in one of those. Sizes that rule the similarity
out are skipped.

The posting lists give groups of classes that are alike by their signatures, directly or through
others: each list first tries its members against one pivot, then lists whose members are still in
several groups are compared inside tasks, block against block of at most ``BLOCK`` members, and a
task returns only the pairs that join groups, never all pairs of a list. A class is in one group
at most; there it is sent with its full set, and all members of a group are compared block against
block in the same way. So every pair that is alike by signatures is decided on the full sets,
a set is sent once for each block of its own group, and pairs of a group are not rows.

A pair at exactly 0.8 agrees in fewer than ``MATCHES`` of the 64 coordinates once in 240,000 times
(binomial sum 4.2e-6), and is then missed; above 0.8 less often.

Defined results: a text without words (or null) has size 0, is its own component and links with
nothing; a text of fewer words than a shingle is one shingle; very long texts are read whole, in
strips; repeated rows and copies share a class; a null id is kept, and a component of null ids
alone has a null ``component_id``; ``kept`` is true for exactly one row of a component; an empty
table gives an empty table; further columns are left out of ``near_duplicates``, whatever their
names, and carried along by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.llm.bloom import blocks_for, flagged, present_filter
from offerloom.llm.common import attach_groups, stored
from offerloom.llm.components import components
from offerloom.llm.shingles import Signer, mix, set_key, shingle_set

COORDINATES = 64
#: Coordinates in which two sets at the threshold of 0.8 agree at least: mean 51.2, deviation 3.2, so 4.75 deviations below.
MATCHES = 36
BLOCK = 512


def _row_hash(docs: DataFrame, id_col: str, text: str):
    return F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.coalesce(docs[text], F.lit("")))


def signatures(docs: DataFrame, shingle: int, id_col: str = "doc_id", text: str = "text", coordinates: int = COORDINATES) -> DataFrame:
    """(id, h, n_shingles, key, sig) of every document."""
    kind = dict(docs.dtypes)[id_col]
    chosen = docs.select(docs[id_col].alias("id"), _row_hash(docs, id_col, text).alias("h"), F.coalesce(docs[text], F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(coordinates)
        for batch in batches:
            n, keys, sigs = [], [], []
            for value in batch.column(2):
                found = shingle_set(value.as_py(), shingle)
                n.append(len(found))
                keys.append(set_key(found))
                sigs.append(signer.sign(found).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["id", "h", "n_shingles", "key", "sig"],
            )

    return chosen.mapInArrow(sign, f"id {kind}, h long, n_shingles long, key binary, sig binary")


def post_coordinates(classes: DataFrame, matches: int, coordinates: int = COORDINATES) -> DataFrame:
    """(token, cid): each class under the rarest of the values, or twos of values, that it shares with others."""
    spoilt = coordinates - matches
    width = 2 if coordinates // 2 > spoilt else 1
    needed = coordinates // width - spoilt

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), "<u4").reshape(part.num_rows, -1).astype(np.uint64)
                places = values.shape[1] // width
                tokens = np.broadcast_to(np.arange(1, places + 1, dtype=np.uint64), (part.num_rows, places))
                for i in range(width):
                    tokens = mix(tokens + (values[:, i : places * width : width] << np.uint64(16)))
                owners = np.repeat(part.column(0).to_numpy(), places)
                yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(tokens.ravel().view(np.int64))], ["cid", "token"])

    tokens = classes.select("cid", "sig").mapInArrow(spread, "cid long, token long")
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = tokens.join(stored(shared, "near-shared"), "token")
    gathered = met.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("values")).where(F.size("values") >= needed)
    prefix = F.slice("values", F.lit(1), F.size("values") - (needed - 1))
    return gathered.select("cid", F.explode(prefix).alias("v")).select(F.col("v.token").alias("token"), "cid")


@F.pandas_udf(T.IntegerType())
def agreements(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many coordinates two signatures agree."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1).astype(np.int32))


def class_sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text: str) -> DataFrame:
    """(cid, shingles) of the wanted classes (h, cid), from a second look at the one document that stands for each."""
    blocks = blocks_for(wanted.count())
    rows = docs.select(_row_hash(docs, id_col, text).alias("h"), F.coalesce(docs[text], F.lit("")).alias("text"))
    near = flagged(rows, "h", present_filter(wanted, "h", blocks), blocks).where("__maybe").select("h", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_set(x.as_py(), shingle).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["h", "shingles"])

    return near.join(wanted, "h").select("h", "cid", "text").dropDuplicates(["h", "cid"]).select(F.col("cid").alias("h"), "text").mapInArrow(sets, "h long, shingles array<long>").withColumnRenamed("h", "cid")


def close_pairs(pairs: DataFrame, classes: DataFrame, percent: int, matches: int) -> DataFrame:
    """Of the pairs (a, b) of classes (cid, n_shingles, sig), those that sizes and signatures allow."""
    one, two = (classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(one, "a").join(two, "b").where(sized).where(agreements("sig_a", "sig_b") >= matches).select("a", "b")


def _between_components(lists: DataFrame) -> DataFrame:
    """The posting lists (token, cid, n_shingles, root, ...) that members of several components are on."""
    mixed = lists.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    return lists.join(stored(mixed, "near-mixed"), "token")


def _tiles(lists: DataFrame, payload: DataFrame, keep: list[str], block: int) -> DataFrame:
    """Rows (token, i, j, part, cid, ``keep``, payload): in tiles (token, i, j), every two blocks of a list's members once."""
    sizes = stored(lists.groupBy("token").agg(F.count("*").alias("size")), "near-left-sizes")
    sized = attach_groups(lists, sizes, "token", "size", lists.count())
    parts = F.ceil(F.col("size") / block)
    own = sized.withColumn("part", F.pmod(F.xxhash64("cid"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = own.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid", *keep)
    return dealt.join(payload, "cid")


def _members(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a tile's first part with those it meets: a tile holds one part, which meets itself, or two."""
    first, second = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    for i in first:
        yield int(i), second[second > i] if part.min() == part.max() else second


def _sized(n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of the others whose sizes allow the similarity."""
    return others[np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * percent]


def tile_links(cid: np.ndarray, root: np.ndarray, sets: list[np.ndarray], part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (smaller, larger cid) that join the components of a tile's members, from their full sets."""
    n = np.array([len(x) for x in sets])
    _, names, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    held = np.zeros((len(sets), int((count > 1).sum()) // 64 + 1), np.uint64)
    for row, x in zip(held, np.split(names, np.cumsum(n)[:-1]), strict=True):
        at = place[x[count[x] > 1]]
        np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    label, links = root.copy(), []
    for i, others in _members(part):
        others = _sized(n, i, others[label[others] != label[i]], percent)
        for start in range(0, len(others), 64):
            some = others[start : start + 64]
            some = some[label[some] != label[i]]
            common = np.bitwise_count(held[some] & held[i]).sum(axis=1, dtype=np.int64)
            for o in some[common * 100 >= (n[some] + n[i] - common) * percent]:
                if label[o] != label[i]:
                    links.append((min(cid[i], cid[o]), max(cid[i], cid[o])))
                    label[label == label[o]] = label[i]
    return links


def leader_links(leading: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components among the classes (cid, root, leaders) that have a leader in common; ``sets`` (cid, shingles)."""
    led = stored(leading.select(F.explode(F.array_distinct("leaders")).alias("token"), "cid", "root"), "near-leading")
    # A set is sent only where a member of another component has the same leader.
    lists = stored(_between_components(led), "near-led")

    def compare(table: pa.Table) -> pa.Table:
        cid, root, part = (table[c].to_numpy() for c in ("cid", "root", "part"))
        links = tile_links(cid, root, [x.values.to_numpy() for x in table["shingles"]], part, percent)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return _tiles(lists, sets, ["root"], block).groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def pairs_in_blocks(lists: DataFrame, leading: DataFrame, percent: int, matches: int, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b) of the posting lists (token, cid, n_shingles, root) between components that agree in enough coordinates and have
    no leader in common; ``leading`` (cid, sig, leaders). All of them: what ``alike_links`` thins out."""

    def compare(table: pa.Table) -> pa.Table:
        cid, root, n, part = (table[c].to_numpy() for c in ("cid", "root", "n_shingles", "part"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(len(cid), -1)
        leaders = np.array(table["leaders"].to_pylist(), np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, others in _members(part):
            others = _sized(n, i, others[root[others] != root[i]], percent)
            others = others[(sig[others] == sig[i]).sum(axis=1) >= matches]
            others = others[~(leaders[others][:, :, None] == leaders[i]).any(axis=(1, 2))]
            a.append(np.minimum(cid[others], cid[i]))
            b.append(np.maximum(cid[others], cid[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return _tiles(stored(lists, "near-left"), leading.select("cid", "sig", "leaders"), ["n_shingles", "root"], block).groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _alike(cid: np.ndarray, root: np.ndarray, n: np.ndarray, sig: np.ndarray, part: np.ndarray, percent: int, matches: int) -> Iterator[tuple[int, int]]:
    """Links (smaller, larger cid) that join the groups of a tile's members, from their signatures."""
    label = root.copy()
    for i, others in _members(part):
        others = _sized(n, i, others[label[others] != label[i]], percent)
        if not len(others):
            continue
        for o in others[(sig[others] == sig[i]).sum(axis=1) >= matches]:
            if label[o] != label[i]:
                yield min(cid[i], cid[o]), max(cid[i], cid[o])
                label[label == label[o]] = label[i]


def alike_links(lists: DataFrame, classes: DataFrame, percent: int, matches: int, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b) that join the groups ``root`` of the posting lists (token, cid, root) wherever two members agree in enough
    coordinates; ``classes`` (cid, n_shingles, sig). A tile gives fewer links than it has members."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        # A tile is at most two blocks; the last of a batch waits for the next batch.
        for batch in chain(batches, [None]):
            rows = [x for x in (rest, None if batch is None else pa.Table.from_batches([batch])) if x is not None and x.num_rows]
            if not rows:
                continue
            table = pa.concat_tables(rows)
            keys = np.stack([table[c].to_numpy() for c in ("token", "i", "j")])
            bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)]
            if batch is None:
                bounds.append(table.num_rows)
            rest = table.slice(bounds[-1])
            cid, root, n, part = (table[c].to_numpy() for c in ("cid", "root", "n_shingles", "part"))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(len(cid), -1)
            links = [x for lo, hi in pairwise(bounds) for x in _alike(cid[lo:hi], root[lo:hi], n[lo:hi], sig[lo:hi], part[lo:hi], percent, matches)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = _tiles(lists, classes.select("cid", "n_shingles", "sig"), ["root"], block)
    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def alike_groups(classes: DataFrame, percent: int, matches: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the groups of classes that are alike by signatures, directly or through others; and (cid, h) of a few more classes."""
    # A smaller set cannot be similar to a set that is not equal.
    smallest = -(-percent // (100 - percent))
    posted = stored(post_coordinates(classes.where(F.col("n_shingles") >= smallest), matches), "near-posted")
    busy = posted.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    lists = stored(posted.join(stored(busy, "near-busy"), "token"), "near-lists")
    wanted = stored(lists.select("cid").distinct().join(classes.select("cid", "h", "n_shingles", "sig"), "cid"), "near-wanted")
    order = F.struct(F.xxhash64("cid").alias("x"), "cid")
    pivots = stored(lists.groupBy("token").agg(F.min(order)["cid"].alias("pivot")), "near-pivots")
    met = lists.join(pivots, "token").where("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    close = stored(close_pairs(stored(met, "near-pairs"), wanted, percent, matches), "near-close")
    known = lists.join(components(close).withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = stored(_between_components(stored(known, "near-known")), "near-mixed-lists")
    found = stored(alike_links(mixed, wanted, percent, matches), "near-alike")
    return components(close.unionByName(found)), wanted.select("cid", "h")


def class_components(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, matches: int, id_col: str, text: str) -> DataFrame:
    """(node, root) of the classes that are linked with others. ``classes``: (cid, h, n_shingles, sig), stored."""
    groups, wanted = alike_groups(classes, percent, matches)
    leading = stored(groups.select(F.col("node").alias("cid"), F.col("node").alias("root"), F.array("root").alias("leaders")), "near-leaders")
    sets = class_sets(docs, stored(wanted.join(leading.select("cid"), "cid").select("h", "cid"), "near-members"), shingle, id_col, text)
    return components(stored(leader_links(leading, sets, percent), "near-edges"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, matches: int = MATCHES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id of its component), ``kept``, ``group_size``, ``h``."""
    signed = stored(signatures(docs, shingle, id_col, text).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "h"))
    with_words = signed.where("n_shingles > 0")
    grouped = with_words.groupBy("key").agg(least.alias("first"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("cid"), "key", "first", "members", "n_shingles", "sig", F.col("first.h").alias("h")), "near-classes")
    labels = class_components(docs, classes, shingle, percent, matches, id_col, text)
    rooted = stored(classes.join(labels, classes["cid"] == labels["node"], "left").select("key", "first", "members", F.coalesce("root", "cid").alias("root")), "near-rooted")
    heads = stored(rooted.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("size"), F.sum("members").alias("group_size")), "near-heads")
    total = signed.count()
    named = stored(attach_groups(rooted, heads, "root", "size", total).select("key", "members", "head", "group_size"), "near-named")
    wide = attach_groups(with_words.select("id", "row", "h", "key", "n_shingles"), named, "key", "members", total)
    linked = wide.select(F.col("id").alias(id_col), "n_shingles", F.col("head.id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("kept"), "group_size", "h")
    empty = signed.where("n_shingles = 0").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("group_size"), "h")
    return linked.unionByName(empty)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, matches: int = MATCHES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component; rows without a partner are not shuffled."""
    found = near_duplicates(docs, shingle, percent, matches, id_col, text).where("group_size > 1")
    touched = stored(found.groupBy(F.col(id_col).alias("same"), F.col("h").alias("g")).agg(F.max("kept").alias("stays")), "near-touched")
    blocks = blocks_for(touched.count())
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("id"), _row_hash(docs, id_col, text).alias("h"))
    probed = flagged(rows, "h", present_filter(touched, "g", blocks), blocks)
    maybe = probed.where("__maybe").join(touched, (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("same")), "left")
    one = maybe.where("stays").dropDuplicates(["same", "g"])
    return probed.where("not __maybe").select("doc.*").unionByName(maybe.where("stays is null").select("doc.*")).unionByName(one.select("doc.*"))
