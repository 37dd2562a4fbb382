import pytest

from aperture.queries import ORACLE_SQL, QUERIES
from tests.oracle import canon, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_queries_without_sql():
    """These are held against brute force elsewhere."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"paired_probe"} and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = cur.fetchall()
    assert len(got) == len(want)
    assert canon(df.columns, got) == canon(names, want)
