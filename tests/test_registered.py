"""Every registered query runs at the smallest scale and equals its SQL twin where it has one."""

import duckdb
import pytest

from catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


def canon(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, tables, duck):
    df = QUERIES[name](tables)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        want = canon([d[0] for d in cur.description], cur.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        for a, b in zip(got[1], want[1]):
            assert a == b
