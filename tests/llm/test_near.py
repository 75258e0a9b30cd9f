import random
import re
from collections import defaultdict

from offerloom.llm import near
from offerloom.llm.components import components


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, size, percent=80):
    """Component of each row number, and set sizes."""
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups, [len(s) for s in sets]


def test_components_match_brute_force(odd_docs, odd_rows, size=2):
    groups, sizes = brute(odd_rows, size)
    want = []
    for members in groups.values():
        head = min((odd_rows[i][0] for i in members if odd_rows[i][0] is not None), default=None)
        want += [(odd_rows[i][0], sizes[i], head) for i in members]
    got = near.near_duplicates(odd_docs, size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.component_id for r in got if r.kept)


def test_one_row_of_each_component_stays(odd_docs, odd_rows):
    groups, _ = brute(odd_rows, 5)
    left = near.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    want = [min((odd_rows[i][0] for i in m if odd_rows[i][0] is not None), default=None) for m in groups.values()]
    rows = left.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted(want, key=repr) and {r.key for r in rows} == {"clash"}


def test_chains_of_near_copies_and_unlike_texts_with_common_parts(spark):
    """A drifting text links far ends through its middle; a large group of near copies needs several pivots."""
    draw = random.Random(3)
    words = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        for _ in range(3):
            words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    common = " ".join(f"c{i}" for i in range(40))
    rows += [(100 + i, common + " " + " ".join(f"u{i}x{j}" for j in range(25))) for i in range(60)]
    body = [f"b{i}" for i in range(120)]
    for i in range(80):
        other = body[:]
        for _ in range(4):
            other[draw.randrange(len(other))] = f"z{draw.randrange(10**6)}"
        rows.append((200 + i, " ".join(other)))
    groups, _ = brute(rows, 2)
    want = {rows[i][0]: min(rows[j][0] for j in m) for m in groups.values() for i in m}
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_blocks_of_leaders_join_what_full_sets_join(spark):
    """Groups at about 0.7 and 0.8 of each other, cut into small blocks, with members that already belong together."""
    draw = random.Random(6)

    def alike(base, kept):
        return sorted(draw.sample(base, kept) + [draw.getrandbits(62) for _ in range(len(base) - kept)])

    base, other = ([draw.getrandbits(62) for _ in range(200)] for _ in range(2))
    sets = [(i, alike(base, 190)) for i in range(40)] + [(100 + i, alike(other, 187)) for i in range(40)]
    roots = {c: c - c % 3 for c, _ in sets}
    leaders = {c: [c // 100, 7 + c % 2] for c, _ in sets}
    leading = spark.createDataFrame([(c, roots[c], leaders[c]) for c, _ in sets], "cid long, root long, leaders array<long>")
    got = {tuple(r) for r in near.leader_links(leading, spark.createDataFrame(sets, "cid long, shingles array<long>"), 80, block=9).collect()}
    held = {c: set(x) for c, x in sets}
    linked = {(a, b) for a, x in held.items() for b, y in held.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    assert got <= linked and len(linked) > 200

    def joined(pairs):
        parent = dict(roots)
        for _ in range(len(parent)):
            for a, b in pairs:
                low, high = sorted((parent[a], parent[b]))
                parent = {c: low if p == high else p for c, p in parent.items()}
        return parent

    assert joined(got) == joined({p for p in linked if roots[p[0]] != roots[p[1]]})


def test_pairs_without_common_leader_meet_by_their_signatures(spark):
    draw = random.Random(2)
    base = [draw.getrandbits(32) for _ in range(64)]
    sigs = {}
    for c in range(60):
        sigs[c] = [v if draw.random() < 0.85 else draw.getrandbits(32) for v in base]
    rows = [(c, near.np.array(sigs[c], "<u4").tobytes(), [c % 7, 10 + c % 5]) for c in sigs]
    leading = spark.createDataFrame(rows, "cid long, sig binary, leaders array<long>")
    lists = leading.selectExpr("explode(array(1L, 2L)) AS token", "cid", "100 + cid AS n_shingles", "cid - cid % 2 AS root")
    got = {tuple(r) for r in near.pairs_in_blocks(lists, leading, 80, 45, block=7).collect()}
    want = {
        (a, b) for a in sigs for b in sigs
        if a < b and a - a % 2 != b - b % 2 and a % 7 != b % 7 and a % 5 != b % 5 and 100 * (100 + a) >= 80 * (100 + b) and sum(x == y for x, y in zip(sigs[a], sigs[b], strict=True)) >= 45
    }
    assert got == want and len(want) > 100


def test_no_rows_and_rows_without_words(spark, no_docs):
    assert near.near_duplicates(no_docs).count() == 0 and near.drop_near_duplicates(no_docs).count() == 0
    silent = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in near.near_duplicates(silent).collect()} == {(i, i, 0, True) for i in (1, 2, 3)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {8: 8, 9: 8}


def test_links_by_signatures_join_the_groups_that_all_pairs_join(spark):
    """A list of many classes alike, in small blocks: the same groups as from all of its pairs, with no more rows than members of tiles."""
    draw = random.Random(8)
    bases = [[draw.getrandbits(32) for _ in range(64)] for _ in range(3)]
    sigs = {c: [v if draw.random() < 0.85 else draw.getrandbits(32) for v in bases[c % 3]] for c in range(90)}
    rows = [(c, 100 + c, near.np.array(sigs[c], "<u4").tobytes(), [-c - 1]) for c in sigs]
    classes = spark.createDataFrame(rows, "cid long, n_shingles long, sig binary, leaders array<long>")
    lists = classes.selectExpr("explode(array(1L, 2L)) AS token", "cid", "n_shingles", "cid - cid % 2 AS root")
    pairs = [tuple(r) for r in near.pairs_in_blocks(lists, classes, 80, 45, block=7).collect()]
    links = [tuple(r) for r in near.alike_links(lists.drop("n_shingles"), classes, 80, 45, block=45).collect()]

    def joined(found):
        parent = {c: c - c % 2 for c in sigs}
        for _ in parent:
            for a, b in found:
                low, high = sorted((parent[a], parent[b]))
                parent = {c: low if p == high else p for c, p in parent.items()}
        return parent

    assert set(links) <= set(pairs) and joined(links) == joined(pairs)
    # Two blocks are three tiles: either block, and both.
    assert len(links) < 2 * 90 < len(pairs) / 2


def test_partners_meet_in_a_posted_two_of_coordinates(spark):
    """Any 28 of 64 coordinates may differ, in the worst places too, and a value alone makes no list."""
    draw = random.Random(4)
    rows = []
    for i in range(20):
        sig = [draw.getrandbits(32) for _ in range(64)]
        spoilt = range(0, 56, 2) if i < 10 else draw.sample(range(64), 28)
        other = [draw.getrandbits(32) if k in spoilt else v for k, v in enumerate(sig)]
        rows += [(2 * i, sig), (2 * i + 1, other)]
    one = [draw.getrandbits(32) for _ in range(64)]
    rows += [(100 + i, [v if k % 2 else draw.getrandbits(32) for k, v in enumerate(one)]) for i in range(30)]
    table = spark.createDataFrame([(c, near.np.array(s, "<u4").tobytes()) for c, s in rows], "cid long, sig binary")
    lists = defaultdict(set)
    for r in near.post_coordinates(table, near.MATCHES).collect():
        lists[r.token].add(r.cid)
    met = {tuple(sorted(x)) for x in lists.values() if len(x) > 1}
    assert met == {(2 * i, 2 * i + 1) for i in range(20)}


def test_a_group_alike_by_signatures_only_is_decided_on_full_sets(spark):
    """Texts at about 0.7 of each other, none at 0.8, more than one block of them, and one pair that is linked."""
    draw = random.Random(5)
    body = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        other = body[:]
        for at in draw.sample(range(150), 16):
            other[at] = f"z{draw.randrange(10**9)}"
        rows.append((i, " ".join(other)))
    rows.append((500, rows[7][1] + " tail of it"))
    groups, _ = brute(rows, 2)
    want = {rows[i][0]: min(rows[j][0] for j in m) for m in groups.values() for i in m}
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert want[500] == 7 and len(set(want.values())) > 40
