"""Every registered query against its SQL on the small test tables; no plan has a
cross join or Python code."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from bibliolake.plans.registry import CHECKS, QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
#: Archives are opened by Python.
READS_ARCHIVES = {"src_01_archive"}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def test_names():
    assert entry_point.queries().keys() >= QUERIES.keys()
    assert CHECKS.keys() <= QUERIES.keys()


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equal_to_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    allowed = ("MapInPandas",) if name in READS_ARCHIVES else ()
    assert not [bad for bad in FORBIDDEN if bad in plan and bad not in allowed]
    columns = sorted(result.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in result.collect()]
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in cursor.fetchall()]
    assert ordered(got) == ordered(want)


#: The same fits as those of another query without SQL, or a long search whose parts are
#: compared with separate fits in tests/test_text_models.py.
FITTED_ELSEWHERE = set(
    "agg_32_cluster_coverage clu_01_kmeans_with_restarts clu_02_best_k mod_02_grid_search mod_03_default_grid "
    "mod_05_journal_classifier mod_06_classifier_per_topic top_16_features".split()
)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - CHECKS.keys() - FITTED_ELSEWHERE))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
