import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from check_oracle import TABLES, rows
from tallyfield.plans.catalog import QUERIES
from tallyfield.plans.catalog_research import EVALUATION_TABLES
from tallyfield.session import ROWS_PER_TASK

# Queries whose values have no practical SQL form; each is tested against a brute force elsewhere.
ROWS_ONLY = {
    "digest_table",
    "payload_hash",
    "evaluate_learned",
    "evaluate_rolling",
    *EVALUATION_TABLES,
}


def test_every_query_has_a_twin_or_a_reason():
    # Queries of the optional subpackage are tested in its own folder.
    assert set(QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


SPLIT = ["rank_offers", "movement_summary", "stake_allocation", "max_drawdown", "duplicate_batch", "league_mean_before", "versioned_log"]


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups_give_the_same_results(spark, db, name):
    spark.conf.set(ROWS_PER_TASK, "100")
    try:
        df = entry.queries()[name](spark, SF)
        got = rows([tuple(r) for r in df.collect()], df.columns)
    finally:
        spark.conf.unset(ROWS_PER_TASK)
    cursor = db.execute(entry.oracle_sql()[name])
    assert got == rows(cursor.fetchall(), [d[0] for d in cursor.description])


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
