"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from quillcheck.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries over the same verdicts as ``verdicts``, or the same findings as ``scan_findings``, take long and are left to the driver's comparison.
SLOW = ("markdown_report", "json_summary", "fail_summary", "checks", "cascade", "suggested_fixes", "status_pivot", "source_coverage", "phantom_ids", "scan_summary", "scan_report", "resolve_refs")
QUICK = [n for n in ORACLES if n not in SLOW]


def same(frame, relation):
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    ours = sorted(repr(tuple(clean(r[c]) for c in columns)) for r in frame.collect())
    names = relation.columns
    theirs = sorted(repr(tuple(clean(r[names.index(c)]) for c in columns)) for r in relation.fetchall())
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(E.queries()[name](spark, SF), con.sql(E.oracle_sql()[name]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert E.entry(spark).columns == ["key_a", "key_b", "similarity", "n_a", "n_b"]
