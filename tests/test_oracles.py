"""Every engine query against its SQL twin in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lacuna.plans.queries import ORACLES, QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, ROOT)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) > 0
    assert a == b


def test_a_tract_without_components_keeps_its_row(spark, tmp_path):
    """A customer far from all roads, buildings and places, with no establishments."""
    c = duckdb.connect()
    for p in glob.glob(f"{ROOT}/*.parquet"):
        name = os.path.basename(p)
        if name != "customer.parquet":
            (tmp_path / name).symlink_to(p)
    far = f"SELECT * REPLACE (10000050::BIGINT AS c_custkey, -1e0 AS c_acctbal) FROM '{ROOT}/customer.parquet' LIMIT 1"
    c.execute(f"COPY (SELECT * FROM '{ROOT}/customer.parquet' UNION ALL ({far})) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    for p in glob.glob(f"{tmp_path}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES["composite_score"](spark, str(tmp_path)), c.sql(ORACLES["composite_score"])
    a = rows(got.columns, got.collect())
    assert a == rows(want.columns, want.fetchall())
    assert [r.coverage_gap_score for r in got.where("k = 0").collect()] == [None]
