"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from quarrylight import queries
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return f"{x:.6g}" if x == x else "nan"
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return f"{x:.6g}" if abs(x) < 1e5 else str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return str(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted([plain(r[k]) for k in order] for r in found)


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in TABLES:
        at = f"/root/testdata/sf0.001/{t}.parquet"
        if os.path.exists(at):
            own.execute(f"create view {t} as select * from '{at}'")
    return own


@pytest.fixture(scope="module")
def found(spark):
    """The rows of every query to come, four queries at a time."""
    if not os.path.isdir(SMALL):
        pytest.skip("the driver's tables aren't here")

    def run(name):
        df = queries.QUERIES[name](spark, SMALL)
        return rows(df.columns, [tuple(r) for r in df.collect()])

    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in sorted(queries.QUERIES)}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(db, found, name):
    got = found[name].result()
    if name in queries.ORACLE:
        want = db.execute(queries.ORACLE[name])
        assert got == rows([c[0] for c in want.description], want.fetchall())
    else:
        assert got[0]


def test_the_entry_point(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
