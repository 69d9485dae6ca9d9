"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from noticeflow import plans
from noticeflow.plans.tables import TABLES


def rows(df):
    df = df[sorted(df.columns)]
    shown = [[None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r] for r in df.itertuples(index=False)]
    return sorted(shown, key=str)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, db):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = db.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
