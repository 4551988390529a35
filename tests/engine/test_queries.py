"""Every query against its SQL, run by another engine on the same files."""

import duckdb
import pytest

from nidifold.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cells(rows):
    out = []
    for row in rows:
        out.append(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    found = got.select(*columns).collect()
    want = oracle.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert columns == sorted(d[0] for d in oracle.execute(ORACLE_SQL[name]).description)
    assert cells(found) == cells(want)
    assert found, "a query without rows shows nothing"
