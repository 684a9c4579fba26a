"""Every registered query against its SQL, on the smallest data."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from nudgeframe.catalog import registry
from nudgeframe.operators import policy
from tests.compare import compare
from tests.conftest import SMALL_DIR

QUERIES = registry.queries()
SQL = registry.oracle_sql()


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck):
    df = QUERIES[name](spark, SMALL_DIR)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare(df, duck, SQL[name]) is None


@pytest.mark.parametrize("name", ["trial_duplicates", "plateau_class", "wave_evidence", "tuning_candidates"])
def test_trial_windows_are_limited_before_the_shuffle(name, spark):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, SMALL_DIR))


def test_pinned_history_is_pushed_to_a_pruned_scan(spark):
    plan = plan_of(QUERIES["rfm_features_pinned_reference"](spark, SMALL_DIR))
    assert "LessThanOrEqual(o_orderdate,1998-06-30T00:00)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


@pytest.mark.parametrize("name", ["purchase_summary", "ingest_mode_features"])
def test_distinct_counts_do_not_widen_rows(name, spark):
    assert "Expand" not in plan_of(QUERIES[name](spark, SMALL_DIR))


def test_large_rankings_use_bucketed_windows(spark, split_small_inputs):
    plan = plan_of(QUERIES["qini_auc"](spark, SMALL_DIR))
    assert "hashpartitioning(__bucket" in plan and "SinglePartition" in plan  # offsets only


@pytest.mark.parametrize("name", sorted(SQL))
def test_large_input_path_matches_sql(name, spark, duck, split_small_inputs):
    assert compare(QUERIES[name](spark, SMALL_DIR), duck, SQL[name]) is None


def test_entry_returns_ten_bins(spark):
    rows = registered.entry(spark).collect()
    assert sorted(row["bin"] for row in rows) == list(range(1, 11))


@pytest.mark.parametrize("name", ["score_segments", "uplift_decile_table", "segment_means"])
def test_scores_on_half_a_digit_match_sql(name, spark, tmp_path):
    """Balances whose score ends on half a hundredth fall to the same side in both engines."""
    con = duckdb.connect()
    customers = "select i as c_custkey, i % 110 * 100 - 950.0::double as c_acctbal from range(5500) t(i)"
    con.execute(f"copy ({customers}) to '{tmp_path}/customer.parquet' (format parquet)")
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) is None


@pytest.mark.parametrize("first", [1000, 1001, 1015, 1016])
def test_shares_on_half_a_digit_match_sql(first, spark, duck):
    """A share that ends on half a thousandth: SQL rounds 0.5005 to 0.5."""
    scores = spark.range(2000).select(F.lit("r").alias("run_id"), (F.col("id") < first).cast("double").alias("uplift"))
    sql = f"select round({first} / 2000::double, 3), round({2000 - first} / 2000::double, 3)"
    got = policy.segment_summary(scores, by=["run_id"]).select("persuadable_pct", "sleeping_dog_pct")
    assert [tuple(r) for r in got.collect()] == duck.execute(sql).fetchall()
