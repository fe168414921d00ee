import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import boundary, exchange, releases, timelines  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES
from tests.compare import connect, rows
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["shrunk_scores", "greedy_windows", "geo_mean_rank", "exact_dedup"])
def test_partition_count_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(rows(QUERIES[name](spark, SF).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    duckdb.connect()


def test_entry_without_a_module_of_the_optional_part():
    code = "import sys; sys.modules['public_tokenizers'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)), timeout=120)
