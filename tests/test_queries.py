"""Registered queries against their oracle SQL on the smallest tables.

The learners and the stream queries take minutes together: of them those run here
that between them use every learner; `check_queries.py` runs all.
"""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, normal
from driftloom.plans import learning, streams

SLOW = {name for name, fn in queries().items() if fn.__module__ in (learning.__name__, streams.__name__)}
SAMPLE_OF_SLOW = {
    "nmf_batch", "onmf_update_dict", "onmf_train", "ocpd_step", "ocpd_train_patches", "stream_topk_per_day",
    "stream_onmf", "stream_term_counts", "nmf_report_labels", "method_comparison", "cp_mu", "ocpd_train",
    "cp_als_sketched", "learner_trials_band", "stream_new_files",
}
NAMES = [n for n in oracle_sql() if n not in SLOW or n in SAMPLE_OF_SLOW]


@pytest.fixture(scope="session")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, folder, name):
    df = queries()[name](spark, folder)
    result = db.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = normal([tuple(r) for r in df.collect()], df.columns, order)
    assert got == normal(result.fetchall(), columns, order)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0
