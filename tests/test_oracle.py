"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from ledgerloom.plans import cascade_sql as sql
from ledgerloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings claims relations document_store deletion_log entity_register mix_targets".split()


@pytest.fixture(scope="module")
def con(small):
    made = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return made


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_same_rows(spark, small, con, name):
    df = queries.QUERIES[name](spark, small)
    got = Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(sql.ORACLE[name])
    cols = [d[0] for d in cur.description]
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(sql.ORACLE) <= set(queries.QUERIES)
