"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from skysift import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["det_eq_ci", "det_cidr", "det_n_of", "det_array_block", "corr_event_count", "corr_temporal_ordered", "corr_session_cap", "corr_chain", "pipe_one_to_many", "schema_classify", "parse_syslog", "parse_cef", "risk_incidents", "inhibit", "stix_followedby", "emit_rule", "emit_sliding", "emit_tumbling", "emit_temporal"]
NAMES = sorted(catalog.QUERIES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    clean = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    got = sorted((clean(r[c] for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((clean(r[i] for i in at) for r in rel.fetchall()), key=str)
