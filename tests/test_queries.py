"""Every registered library query against its SQL twin on the smallest tables."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from lectern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Compared with plain Python in test_golden.
ALONE = {"G03_pagerank", "G05_label_propagation", "G19_top_ranked", "G22_reading_order_ranked", "E05_label_communities", "E06_graph_metadata", "E07_full_run", "V11_pagerank_blend_ranked"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v).tz_localize(None))
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in ALONE])
def test_query(name, spark, sf, con):
    found = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(found) > 0
        return
    wanted = con.execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
