"""Siblings around a place, cut out of one row per group, against plain lists; also where an id stands at several places of the tree."""

import random

import pytest

from offerloom.operators.taxonomy import local_siblings


@pytest.mark.parametrize("twice", [False, True])
def test_siblings_equal_plain_lists(spark, twice):
    draw = random.Random(2)
    tree = [("r", "", 1, None), ("g0", "", 2, "r"), ("g1", "", 2, "r")] + [(f"g{i % 2}/l{i}", "", 3, f"g{i % 2}") for i in range(14)]
    if twice:
        tree += [("g0", "", 3, "g1"), ("g1/l3", "", 3, "g0")]
    counts = [(c, 0 if c == "g1" else 5) for c, *_ in tree[:17]]
    local = [(h, c, draw.randrange(4)) for h in range(5) for c, *_ in tree[:17] if draw.random() < 0.8]
    asked = [(i, i % 5, c) for i in range(12) for c in [*draw.sample([c for c, *_ in tree], 6), "g1/l3"]]
    asked = sorted(set(asked)) + [asked[0]]
    total, want = dict(counts), []
    for i, h, cat in asked:
        at, found = {c: n for h2, c, n in local if h2 == h and n > 0}, []
        for _, _, level, up in (x for x in tree if x[0] == cat and x[2] > 1):
            found += [(-at[c], c) for c, _, l2, u2 in tree if l2 == level and u2 == up and c != cat and c in at]
            found += [(-at[up], up)] if level == 3 and total[up] > 0 and up in at else []
        want += [(i, h, cat, c, -n) for n, c in sorted(found)[:3]]
    frame = spark.createDataFrame
    found = local_siblings(
        frame(asked, "location_id int, leader int, category_id string"), frame(tree, "category_id string, name string, level int, parent_id string"),
        frame(counts, "category_id string, n long"), frame(local, "leader int, category_id string, n long"), 3,
    )
    cols = ["location_id", "leader", "category_id", "sibling_id", "n"]
    assert sorted(map(tuple, found.select(*cols).collect())) == sorted(want) and len(want) > 100
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
