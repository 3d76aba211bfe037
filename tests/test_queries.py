"""Every query of the core runs and agrees with its SQL in DuckDB."""

import os

import pytest

from marlstone.plans import registry
from tests.compare import differs

FOLDER = os.environ.get("MARLSTONE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, name):
    assert differs(spark, FOLDER, registry.QUERIES[name], registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_comparison_sees_differences(spark):
    assert differs(spark, FOLDER, registry.QUERIES["top_k"], registry.SQL["top_k"].replace("LIMIT 20", "LIMIT 19"))
    assert differs(spark, FOLDER, registry.QUERIES["temporal_bins"], registry.SQL["temporal_bins"].replace("count(*) AS n", "count(*) + 1 AS n"))


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_kpi_block_has_the_last_year(spark):
    last = spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr("max(year(o_orderdate)) AS y").first()["y"]
    assert all(f" {last}: " in r["block"] for r in registry.QUERIES["kpi_block"](spark, FOLDER).collect())


def test_context_assembly_has_the_starts_of_sections(spark):
    n = {r["query_id"]: r["n_sentences"] for r in registry.QUERIES["context_assembly"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/v_sample_1m_core.parquet").where("docID is not null and sentenceID rlike '_[0-9]+$'").select("docID").distinct()
    assert {r["docID"] for r in rows.collect()} <= set(n)
