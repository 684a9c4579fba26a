"""Skewed joins, prefix sums and quantiles on hostile shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nudgeframe.operators.features import product_aggregates
from nudgeframe.plans.distinct import distinct_counts
from nudgeframe.plans.prefix import average_ranks, exact_quantiles, running
from nudgeframe.plans.rank_correlation import spearman
from nudgeframe.plans.sizing import tasks_for
from nudgeframe.plans.skew import find_heavy_keys, skew_join


@pytest.fixture
def hot(spark):
    """One key holds half of the rows."""
    return spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("v")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, hot, how, split_small_inputs):
    dim = spark.range(-1, 50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got, want = skew_join(hot, dim, ["k"], how), hot.join(dim, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_heavy_key_is_found_and_spread(spark, hot, split_small_inputs):
    heavy = find_heavy_keys(hot, ["k"])
    expected = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long"))).first()[0]
    salts = {row["__h"]: row["__salts"] for row in heavy.table.collect()}
    assert salts[expected] > 10


@pytest.mark.parametrize("split", [False, True])
def test_running_sums_and_prior_max(spark, request, split):
    if split:
        request.getfixturevalue("split_small_inputs")
    rng = np.random.default_rng(1)
    rows = [(f"g{int(g)}", float(s), f"e{i:04d}") for i, (g, s) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 4, 500)))]
    df = spark.createDataFrame(rows, "g string, s double, e string")
    out = running(df, ["g"], [("s", True), ("e", False)], {"pos": F.lit(1).cast("long"), "total": F.col("s")},
                  prior_max={"best": F.col("e")}, totals=True)
    got = {(r["g"], r["e"]): r for r in out.collect()}
    assert len(got) == 500
    for group in ("g0", "g1", "g2"):
        ordered = sorted([r for r in rows if r[0] == group], key=lambda r: (-r[1], r[2]))
        total, best = 0.0, None
        for i, (_, s, e) in enumerate(ordered, start=1):
            total += s
            row = got[group, e]
            assert (row["pos"], row["total"], row["best"]) == (i, total, best)
            assert row["total_pos"] == len(ordered)
            best = e if best is None else max(best, e)


def test_both_paths_agree_on_nulls_nan_and_signed_zeros(spark, split_small_inputs):
    """Null and NaN sort keys, both zeros and a null group fall alike with one window and with buckets."""
    scores = [None, float("nan"), 0.0, -0.0, 1.5, -2.0, float("inf"), float("-inf")]
    rows = [(g, scores[i % 8] if i % 5 else float(i), f"e{i:04d}") for g in ("a", None) for i in range(160)]
    df = spark.createDataFrame(rows, "g string, s double, e string")
    for by in (["g"], []):
        for down in (True, False):
            def placed():
                out = running(df, by, [("s", down), ("g", False), ("e", False)], {"pos": F.lit(1).cast("long")},
                              prior_max={"best": F.col("e")}, totals=True)
                return sorted(map(repr, out.collect()))

            buckets = placed()
            spark.conf.set("spark.nudgeframe.smallBytes", str(2**40))
            try:
                assert buckets == placed()
            finally:
                spark.conf.set("spark.nudgeframe.smallBytes", "0")


@pytest.mark.parametrize("split", [False, True])
def test_quantiles_and_ranks_match_numpy(spark, request, split):
    if split:
        request.getfixturevalue("split_small_inputs")
    rng = np.random.default_rng(2)
    a = np.round(rng.normal(size=300), 2)
    df = spark.createDataFrame([(float(v),) for v in a] + [(None,)], "v double")
    row = exact_quantiles(df, [], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}).first()
    assert [row["q10"], row["q50"], row["q95"]] == pytest.approx(list(np.quantile(a, [0.1, 0.5, 0.95])))
    ranks = {r["v"]: r["avg_rank"] for r in average_ranks(df.filter("v is not null"), [], "v").collect()}
    for value, rank in ranks.items():
        assert rank == (a < value).sum() + ((a == value).sum() + 1) / 2


def test_spearman_with_ties_and_constants(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 5, 200), rng.integers(0, 7, 200)

    def ranks(v):
        return np.array([(v < i).sum() + ((v == i).sum() + 1) / 2 for i in v])

    rows = [("a", float(i), float(j)) for i, j in zip(x, y)] + [("flat", 1.0, float(j)) for j in y]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in spearman(df, ["k"], "x", "y").collect()}
    assert got["a"]["correlation"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert got["a"]["n"] == 200 and got["flat"]["correlation"] is None


@pytest.mark.parametrize("keyed", [True, False])
def test_spearman_of_values_that_span_buckets(spark, keyed, split_small_inputs):
    """One value of each side is shared by most cells; groups may be null, values NaN or negative zero."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(600) < 0.6, 3.0, rng.integers(0, 400, 600).astype(float))
    y = np.where(rng.random(600) < 0.4, -1.0, rng.integers(0, 300, 600).astype(float))
    x[:3], y[3:5], x[5], x[6] = np.nan, np.nan, -0.0, 0.0
    groups = np.array([None if i % 3 == 0 else "a" if i % 3 == 1 else "b" for i in range(600)]) if keyed else np.full(600, "all")
    rows = [(g, float(i), float(j)) for g, i, j in zip(groups, x, y)] + [("a" if keyed else "all", None, 1.0), ("a" if keyed else "all", 2.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    keys = ["k"] if keyed else []
    got = {r["k"] if keyed else "all": r for r in spearman(df, keys, "x", "y").collect()}

    def ranks(v):
        v = np.where(np.isnan(v), 1e9, v)
        return np.array([(v < i).sum() + ((v == i).sum() + 1) / 2 for i in v])

    assert set(got) == set(groups)
    for group, row in got.items():
        at = np.array([g == group for g in groups])
        assert row["n"] == at.sum()
        assert row["correlation"] == pytest.approx(np.corrcoef(ranks(x[at]), ranks(y[at]))[0, 1])


def test_distinct_counts_with_nulls_and_totals(spark):
    rows = [("a", 1, "x", 2.0), ("a", 1, None, 3.0), ("a", None, "y", None), (None, 2, "x", 1.0), ("b", None, None, None)]
    df = spark.createDataFrame(rows, "g string, i int, s string, v double")
    kinds, totals = {"ints": F.col("i"), "texts": F.col("s")}, {"low": ("min", F.col("v")), "sums": ("sum", F.col("v")), "known": ("count", F.col("v"))}
    got = {r[0]: tuple(r)[1:] for r in distinct_counts(df, ["g"], kinds, totals).collect()}
    assert got == {"a": (1, 2, 2.0, 5.0, 2), None: (1, 1, 1.0, 1.0, 1), "b": (0, 0, None, None, 0)}
    assert [tuple(r) for r in distinct_counts(df.limit(0), [], kinds, totals).collect()] == [(0, 0, None, None, None)]


def test_widening_steps_state_their_tasks(spark, split_small_inputs):
    """Product steps over much input keep a number of tasks that grows with it; the rows stay the same."""
    lines = spark.range(4000).select(
        (F.col("id") % 37).cast("string").alias("client_id"), (F.col("id") % 101).cast("string").alias("product_id"),
        (F.col("id") % 5).cast("double").alias("product_quantity"),
    )
    products = spark.range(90).select(
        F.col("id").cast("string").alias("product_id"), (F.col("id") % 7).alias("level_1"), (F.col("id") % 11).alias("segment_id"),
        (F.col("id") % 13).alias("brand_id"), (F.col("id") % 2).alias("is_own_trademark"), (F.col("id") % 3).alias("is_alcohol"),
    )
    plain = product_aggregates(lines, products, diversity=True)
    want = sorted(map(tuple, plain.collect()))
    spark.conf.set("spark.nudgeframe.taskBytes", "1000")
    try:
        dealt = product_aggregates(lines, products, diversity=True)
        assert tasks_for(lines) == 32
        plan = dealt._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") >= 3 and "], 32" in plan
        assert sorted(map(tuple, dealt.collect())) == want
    finally:
        spark.conf.unset("spark.nudgeframe.taskBytes")
