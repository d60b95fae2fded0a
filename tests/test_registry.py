"""Registered queries against their SQL at the smallest scale.

By default a spread of queries runs; set TWINSCOPE_ALL=1 to run all of them.
"""

import math
import os
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "null_counts", "table_profile", "correlation_matrix", "transform_impute", "duplicate_rows", "ks_statistic", "jsd_numeric",
    "fidelity_summary", "bias_report", "column_diagnosis", "privacy_report", "constraint_summary", "auc_one_vs_rest",
    "candidate_ranking", "marginals", "benchmark_status", "root_causes", "stream_window_drift", "catalogue_lineage", "catalogue_stopped_save",
]
CHOSEN = sorted(oracle_sql()) if os.environ.get("TWINSCOPE_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6))
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cursor = duck.execute(oracle_sql()[name])
    want = cursor.fetchall()
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(want, [c[0] for c in cursor.description])


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 6


def test_entry_imports_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
