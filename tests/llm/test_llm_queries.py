import os

import duckdb
import pytest

from offerloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    """Against its SQL, or else as many rows as its table has at least."""
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLES:
        assert len(rows) >= spark.read.parquet(f"{FOLDER}/documents.parquet").count()
        return
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cur = db.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in sorted(columns)) for r in rows), key=repr)
    assert got == sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in cur.fetchall()), key=repr)
