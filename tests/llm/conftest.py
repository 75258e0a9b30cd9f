"""Tables with everything that real ones get wrong."""

import random

import pytest
from pyspark.sql import types as T

#: Names that the operators use for themselves.
CLASHING = ["h", "n", "size", "row", "key", "token", "group", "group_size", "doc", "id", "cid", "taken", "copies", "score", "host", "rule", "__maybe", "__h", "__block"]

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def prose(draw, words):
    return " ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(draw.randrange(60)) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source) with nulls, empty and long texts, ties, copies, near copies and repeated rows."""
    draw = random.Random(7)
    base = [prose(draw, n) for n in (3, 30, 60, 120, 120, 4000)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10 + i, base[3], "s0") for i in range(25)]
    for i in range(20):
        words = base[4].split()
        words[(i * 5) % len(words)] = f"changed{i}"
        rows.append((50 + i, " ".join(words), "s1"))
    rows += [(90, None, "s2"), (91, "", "s2"), (92, " \t\n", None), (None, base[1], None), (None, None, None), (93, "one", "s9"), (94, "ONE", "s9")]
    rows += [(95, base[2], "s1")] * 3 + [(96, "a" * 700, "s0"), (97, "ünïcödé ß 🙂 " * 40, "s0"), (-5, base[0] + " more", "s1"), (2**62, "x " * 300, "s1")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    full = [(k, t, "xx", s, None if t is None else len(t), *("clash" for _ in CLASHING)) for k, t, s in odd_rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
