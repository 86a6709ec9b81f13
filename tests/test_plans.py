"""Every query against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import SF

from brindle import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_oracle(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    want = db.sql(plans.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(flat(r[c]) for c in cols) for r in got.collect()), key=key)
    names = want.columns
    b = sorted((tuple(flat(float(v)) if type(v).__name__ == "Decimal" else flat(v) for v in (r[names.index(c)] for c in cols)) for r in want.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_others_run_twice_alike(spark, name):
    one, two = (sorted(map(str, plans.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert one == two and one


def test_no_nested_loops(spark):
    for name in ("join_or_exists", "join_form_or_sku", "join_asof_prior"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_recall_of_the_index(spark):
    """The inverted file finds at least nine tenths of the exact neighbours and repeats none."""
    sf = SF.replace("0.001", "0.01")
    exact = {(r.q, r.v) for r in plans.QUERIES["knn_exact"](spark, sf).collect()}
    found = [(r.q, r.v) for r in plans.QUERIES["knn_approx"](spark, sf).collect()]
    assert exact and len(set(found)) == len(found) and len(exact & set(found)) >= 0.9 * len(exact)


def test_streams_read_tables_of_several_files(spark, tmp_path):
    """A table that is a folder of files streams as the one that is a file."""
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_tumbling", "stream_session", "stream_change_log"):
        one, two = (sorted(map(str, plans.QUERIES[name](spark, d).collect())) for d in (SF, str(tmp_path)))
        assert one == two and one, name
