import hashlib
import random

import pytest

from offerloom.llm import fingerprint


def test_edited_texts_and_neighbours(odd_docs, odd_rows):
    got = fingerprint.fingerprints(odd_docs).collect()
    assert len(got) == len(odd_rows)
    # Rows of equal id follow one another by a hash of their text, so only ids that occur once have a certain neighbour.
    ids = [k for k, _, _ in odd_rows]
    order = sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0))
    by_id = {r.doc_id: r for r in got}
    checked = 0
    for (k, t, _), (following, nxt, _) in zip(order, order[1:] + order[:1], strict=True):
        if ids.count(k) == 1 and (ids.count(following) == 1 or following == 95):
            text, moved = t or "", len(t or "") // 4
            edited = text[: len(text) - moved] + (nxt or "")[:moved]
            assert by_id[k].n_chars == len(text) and by_id[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            checked += 1
    assert checked > 50
    prints = {}
    for k, t, _ in odd_rows:
        if ids.count(k) == 1:
            prints.setdefault(t or "", set()).add(by_id[k].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.jaccard_edited, r.jaccard_next))


def test_one_document_follows_itself_and_no_rows(spark, no_docs):
    one = fingerprint.fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 15
    assert fingerprint.fingerprints(no_docs).count() == 0


def test_groups_of_neighbours_wrap_around(spark):
    rows = [(i * 1000 if i < 5000 else 2**62 + i, f"w{i}") for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    found = {r.id: r.next_text for r in fingerprint.with_next(df, "id", "text", ["text"]).collect()}
    assert found == {k: rows[(i + 1) % len(rows)][1] for i, (k, _) in enumerate(rows)}


def test_sketches_merge_and_estimate(spark):
    a = " ".join(f"a{i}" for i in range(4000))
    b = " ".join(f"a{i}" for i in range(1000)) + " " + " ".join(f"b{i}" for i in range(200))
    row = spark.createDataFrame([(a, b, a + " | " + b)], "a string, b string, u string")
    s = row.select(*[fingerprint.sketch(row[c]).alias(c) for c in "abu"])
    out = s.select(
        fingerprint.containment(s["a"], s["b"]).alias("c"), fingerprint.resemblance(s["a"], s["b"]).alias("j"), fingerprint.merged(s["a"], s["b"]).alias("m"), "a", "b", "u"
    ).first()
    assert out.c == pytest.approx(996 / 1196, abs=0.1) and out.j == pytest.approx(996 / 4196, abs=0.06)
    assert set(out.m) <= set(out.u) and len(set(out.u) - set(out.m)) <= 6


def test_likeness_comes_from_the_returned_fingerprints(odd_docs, odd_rows):
    """near_edited and near_next again, from the strings alone."""
    rows = fingerprint.fingerprints(odd_docs).collect()
    ids = [k for k, _, _ in odd_rows]

    def alike(a, b):
        a, b = set(a.split(",")), set(b.split(","))
        return len(a & b) / min(len(a), len(b))

    assert all(r.near_edited == alike(r.fingerprint, r.edited_fingerprint) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    order = sorted({k for k in ids if k is not None})
    sure = [(a, b) for a, b in zip(order, order[1:], strict=False) if ids.count(a) == 1 and ids.count(b) == 1]
    assert len(sure) > 40 and all(by_id[a].near_next == alike(by_id[a].fingerprint, by_id[b].fingerprint) for a, b in sure)


def test_error_of_the_likeness_by_number_of_shingles(spark):
    """Edited documents against the exact containment of all their shingles."""
    draw = random.Random(1)
    bounds = {20: 0.3, 80: 0.12, 400: 0.05, 2000: 0.025}
    rows = [(1000 * j + i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(m + 4))) for j, m in enumerate(bounds) for i in range(60)]

    def shingles(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for j, most in enumerate(bounds.values()):
        errors = []
        for (k, text), (_, nxt) in zip(rows, rows[1:], strict=False):
            if k // 1000 == j:
                moved = len(text) // 4
                a, b = shingles(text), shingles(text[: len(text) - moved] + nxt[:moved])
                errors.append(got[k].near_edited - len(a & b) / min(len(a), len(b)))
        assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < most


def test_an_outlying_id_or_null_ids_do_not_fill_one_group(spark):
    rows = [(i, f"w{i}") for i in range(20_000)] + [(2**62, "far"), (-(2**62), "low")] + [(None, f"n{i}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    n = len(rows)
    keyed = df.withColumn("__key", fingerprint.F.coalesce(df["id"].cast("decimal(20,0)"), fingerprint.F.lit(2**62 + 1).cast("decimal(20,0)")))
    bounds = fingerprint._bounds(keyed, "text", n)
    sizes = keyed.groupBy(fingerprint._group(bounds, keyed["__key"], keyed["text"])).count().collect()
    assert max(r["count"] for r in sizes) < n / 5
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found = {r.text: r.next_text for r in fingerprint.with_next(df, "id", "text", ["text"]).collect()}
    assert found == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
