"""Splits, folds, policies, robustness and trial-table rules."""

import math

import pytest
from pyspark.sql import functions as F

from nudgeframe.config import SplitPolicy
from nudgeframe.operators import policy, robustness, split, trials

LABELS = "client_id string, treatment_flg int, target int"


def labels(spark, cells):
    rows, i = [], 0
    for (t, y), n in cells.items():
        for _ in range(n):
            rows.append((f"c{i:04d}", t, y))
            i += 1
    return spark.createDataFrame(rows, LABELS)


@pytest.mark.parametrize(
    "cells, expected",
    [
        ({(0, 0): 6, (0, 1): 6, (1, 0): 6, (1, 1): 6}, "joint_treatment_outcome"),
        ({(0, 0): 5, (0, 1): 2, (1, 0): 6, (1, 1): 6}, "treatment_only"),
        ({(0, 0): 1, (1, 1): 1}, "random"),
        ({(0, 0): 8, (1, 1): 8}, "joint_treatment_outcome"),  # empty strata do not count
    ],
)
def test_stratification_choice(spark, cells, expected):
    assert split.stratification_decision(labels(spark, cells)).first()["strategy"] == expected


@pytest.mark.parametrize(
    "shares, sizes",
    [
        ((0.7, 0.15, 0.15), {"train": 70, "validation": 15, "test": 15}),
        ((0.5, 0.5, 0.0), {"train": 50, "validation": 50}),
        ((0.8, 0.0, 0.2), {"train": 80, "test": 20}),
        ((1.0, 0.0, 0.0), {"train": 100}),
    ],
)
def test_split_sizes_and_id_conservation(spark, shares, sizes):
    df = labels(spark, {(0, 0): 31, (0, 1): 23, (1, 0): 27, (1, 1): 19})
    out = split.stratified_split(df, SplitPolicy(*shares, seed=7))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == sizes
    assert out.select("client_id").distinct().count() == out.count() == 100
    again = split.stratified_split(df, SplitPolicy(*shares, seed=7))
    assert sorted(out.collect()) == sorted(again.collect())


def test_tiny_stratum_falls_back_to_random(spark):
    out = split.stratified_split(labels(spark, {(0, 0): 1, (1, 1): 9}), SplitPolicy(0.5, 0.5, 0.0))
    assert out.count() == 10 and out.filter("split = 'train'").count() == 5


def test_quotas_share_remainders():
    assert split.quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert sum(split.quotas({"a": 7, "b": 5, "c": 11}, 13).values()) == 13


def test_folds_balance_strata(spark):
    out = split.kfold(labels(spark, {(0, 0): 20, (0, 1): 20, (1, 0): 20, (1, 1): 20}), 4)
    sizes = out.groupBy("fold", "treatment_flg", "target").count().collect()
    assert len(sizes) == 16 and all(r["count"] == 5 for r in sizes)
    assert split.fold_strategy(labels(spark, {(0, 0): 2, (0, 1): 9, (1, 1): 9}), 5) == "treatment_only"
    assert split.fold_strategy(labels(spark, {(0, 0): 2, (1, 1): 9}), 5) == "random"
    with pytest.raises(ValueError):
        split.kfold(out, 1)


def test_diagnostics_name_weak_partitions(spark):
    df = labels(spark, {(0, 0): 60, (1, 1): 60}).withColumn(
        "split", F.when(F.col("treatment_flg") == 1, "train").otherwise("validation")
    )
    row = split.split_diagnostics(df).filter("split = 'validation'").first()
    assert row["too_few_rows"] and row["treatment_rate_drift"] and row["missing_cell"] and not row["reliable"]


SCORES = "client_id string, target int, treatment_flg int, uplift double"


def scores(spark, uplift):
    return spark.createDataFrame([(f"c{i:03d}", i % 2, (i // 2) % 2, float(u)) for i, u in enumerate(uplift)], SCORES)


def test_budget_without_positive_scores(spark):
    row = policy.budget_targeting(scores(spark, [-1.0] * 8), 100.0).first()
    assert row["n_targeted"] == 0 and row["total_cost"] == 0 and row["pct_of_base"] == 0
    assert row["roi"] is None and row["incremental_conversions"] is None


def test_budget_caps_positive_customers(spark):
    row = policy.budget_targeting(scores(spark, range(-4, 12)), 10.0, coupon_cost=2.0).first()
    assert (row["max_coupons_affordable"], row["n_targeted"]) == (5, 5)
    free = policy.budget_targeting(scores(spark, range(-4, 12)), 10.0, coupon_cost=0.0).first()
    assert free["n_targeted"] == 11 and free["roi"] is None


def elbow(spark, rois):
    rows = [(5 * (i + 1), r) for i, r in enumerate(rois)]
    return policy.elbow_threshold(spark.createDataFrame(rows, "threshold_pct int, roi double")).first()[0]


def test_elbow(spark):
    assert elbow(spark, [3.0, 2.9, 1.0, 0.9]) == 10
    assert elbow(spark, [None, None, None]) == 5
    assert elbow(spark, [2.0]) == 5
    assert elbow(spark, []) == 10


def test_policy_bundle(spark):
    df = scores(spark, range(-10, 30))
    tables = policy.policy_summary(df, budget=5.0)
    assert set(tables) == {"targeting_results", "elbow_threshold", "segment_summary", "decile_table", "budget_result"}
    assert tables["targeting_results"].count() == 4 and tables["budget_result"].first()["n_targeted"] == 5
    assert "budget_result" not in policy.policy_summary(df)


def test_overlapping_quantile_groups(spark):
    row = policy.segment_summary(scores(spark, [0.5] * 10)).first()
    assert row["persuadables"] == row["sleeping_dogs"] == 10
    assert row["middle_ground"] == -10 and row["middle_disjoint"] == 0


def test_rank_test_p_value(spark):
    rows = [(f"c{i:03d}", "Persuadable" if i < 20 else "Uncertain") for i in range(60)]
    segmented = spark.createDataFrame(rows, "client_id string, segment string")
    table = segmented.select("client_id", F.substring("client_id", 2, 3).cast("double").alias("x"), F.lit(1.0).alias("flat"))
    found = {r["feature"]: r for r in policy.segment_rank_test(segmented, table, ["x", "flat"]).collect()}
    assert found["x"]["u_statistic"] == 0 and found["x"]["p_value"] < 1e-4 and found["x"]["significant"]
    assert found["flat"]["p_value"] is None or found["flat"]["p_value"] == 1.0


def test_rank_test_of_one_value_over_many_rows(spark):
    """At these counts the tie term in doubles leaves a variance just below or above zero."""
    key = F.col("id")
    rows = spark.range(435_000)
    segmented = rows.select(key.cast("string").alias("client_id"), F.when(key % 3 == 0, "Persuadable").otherwise("Uncertain").alias("segment"))
    table = rows.select(key.cast("string").alias("client_id"), F.lit(0.0).alias("all"), F.when(key >= 10_000, 0.0).alias("some"))
    found = policy.segment_rank_test(segmented, table, ["all", "some"]).collect()
    assert len(found) == 2
    assert all(r[c] is None for r in found for c in ("z", "p_value", "significant"))


def test_two_sided_p_follows_erfc(spark):
    zs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.96, 2.5758, 4.0, 8.0, 30.0, -1.5, None]
    found = spark.createDataFrame([(z,) for z in zs], "z double").select("z", policy.two_sided_p(F.col("z")).alias("p")).collect()
    for row in found:
        want = None if row["z"] is None else math.erfc(abs(row["z"]) / math.sqrt(2))
        assert row["p"] == (None if want is None else pytest.approx(want, rel=2e-7, abs=1e-300))


RUNS = "run_id string, client_id string, uplift double"


def predictions(spark):
    base = {"a": 0.9, "b": 0.7, "c": 0.2, "d": 0.1}
    similar = {"a": 0.8, "b": 0.75, "c": 0.3, "d": 0.0, "z": 0.9}
    reverse = {k: -v for k, v in base.items()}
    rows = [(n, k, v) for n, d in (("base", base), ("near", similar), ("rev", reverse)) for k, v in d.items()]
    return spark.createDataFrame(rows, RUNS)


def test_pairwise_agreement_uses_shared_entities(spark):
    df = predictions(spark)
    pairs = robustness.run_pairs(df)
    got = {(r["run_a"], r["run_b"]): r for r in robustness.rank_correlation(df, pairs).collect()}
    assert set(got) == {("base", "near"), ("base", "rev")}  # each run with the reference run
    assert got["base", "near"]["rank_correlation"] == 1.0 and got["base", "near"]["shared_entities"] == 4
    assert got["base", "rev"]["rank_correlation"] == -1.0
    top = {(r["run_a"], r["run_b"]): r["top_k_overlap"] for r in robustness.top_k_overlap(df, pairs, 2).collect()}
    assert top["base", "near"] == 1.0 and top["base", "rev"] == 0.0
    stable = robustness.ranking_stability(df, pairs, 0.5).first()
    assert stable["pair_count"] == 2 and not stable["stable"] and stable["min_rank_correlation"] == -1.0


def test_run_without_shared_entities_is_a_limitation(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", 1.0)], RUNS)
    row = robustness.ranking_stability(df, robustness.run_pairs(df)).first()
    assert row["pair_count"] == 1 and row["limitations"] == 2 and not row["stable"]


def test_policy_stability_needs_every_run(spark):
    schema = "experiment_id string, run_id string, policy_gain map<string,double>"
    rows = [
        ("e", "r1", {"top_10pct_low": 1.0, "top_20pct_low": 1.0, "top_10pct_high": 2.0, "note": 9.0}),
        ("e", "r2", {"top_10pct_low": 5.0, "top_20pct_low": 4.0, "top_10pct_high": None}),
    ]
    got = {r["scenario"]: r for r in robustness.policy_stability(spark.createDataFrame(rows, schema), "experiment_id").collect()}
    assert got["low"]["stable_cutoff"] == "top_10pct" and got["low"]["stable"]
    assert not got["high"]["complete"] and got["high"]["stable_cutoff"] is None


TRIAL = (
    "experiment_id string, seq long, run_id string, hypothesis_id string, status string, template_name string, "
    "uplift_learner_family string, base_estimator string, feature_recipe_id string, params_hash string, split_seed int, "
    "qini_auc double, normalized_qini_auc double, uplift_auc double, held_out_normalized_qini_auc double, "
    "policy_gain map<string,double>"
)


def trial(seq, qini, hyp="h1", status="success", family="two_model", estimator="xgboost", **more):
    row = {
        "experiment_id": "e", "seq": seq, "run_id": f"r{seq}", "hypothesis_id": hyp, "status": status,
        "template_name": f"{family}_{estimator}", "uplift_learner_family": family, "base_estimator": estimator,
        "feature_recipe_id": "f", "params_hash": f"p{seq}", "split_seed": seq, "qini_auc": qini,
        "normalized_qini_auc": None, "uplift_auc": 0.1, "held_out_normalized_qini_auc": None,
        "policy_gain": {"top_10pct_zero": 1.0},
    } | more
    return tuple(row.values())


def test_tuning_candidates_skip_manual_and_failed(spark):
    df = spark.createDataFrame(
        [
            trial(1, 500.0, hyp="manual_baseline"),
            trial(2, 420.0, estimator="lightgbm"),
            trial(3, 341.0, family="class_transformation"),
            trial(4, 333.0, estimator="lightgbm"),
            trial(5, 999.0, status="failed"),
            trial(6, 999.0, hyp="h1__tune_p1_s42"),
        ],
        TRIAL,
    )
    got = [(r["rank"], r["template_name"], r["run_id"]) for r in trials.tuning_candidates(df).orderBy("rank").collect()]
    assert got == [(1, "two_model_lightgbm", "r2"), (2, "class_transformation_xgboost", "r3")]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, 0.1), (2, 0.2)], "continue"),
        ([(1, 0.1), (2, 0.101), (3, 0.102)], "plateau"),
        ([(i, 0.1 * i) for i in range(1, 6)], "budget_reached"),
    ],
)
def test_plateau_classes(spark, rows, expected):
    df = spark.createDataFrame([trial(s, q) for s, q in rows], TRIAL)
    assert trials.plateau_class(df).first()["decision"] == expected


def test_duplicate_outranks_plateau(spark):
    df = spark.createDataFrame([trial(s, 0.1, params_hash="same") for s in (1, 2, 3)], TRIAL)
    row = trials.plateau_class(df).first()
    assert row["decision"] == "duplicate_config" and row["duplicate_run_id"] == "r2"


def test_verdicts_follow_earlier_champion(spark):
    df = spark.createDataFrame(
        [trial(1, 0.2), trial(2, 0.2), trial(3, 0.3), trial(4, 0.4, uplift_auc=0.05), trial(5, -0.02), trial(6, 9.0, status="failed"), trial(7, 0.01)],
        TRIAL,
    ).withColumn("llm", F.lit("supported"))
    got = [r["ceiling"] for r in trials.verdict_ceiling(df, "llm").orderBy("seq").collect()]
    assert got == ["supported", "inconclusive", "supported", "inconclusive", "contradicted", "inconclusive", "inconclusive"]


WAVE = (
    "experiment_id string, wave_id string, status string, blocked_reason string, compute_exhausted boolean, "
    "valid_next_actions array<string>, champion_stability_runs int, policy_threshold_stable boolean, robustness_stable boolean"
)


@pytest.mark.parametrize(
    "changes, qinis, reason, status, action",
    [
        ({"status": "blocked"}, (0.3, 0.1), "validity_blocked", "inconclusive", "fix_validity_blocker"),
        ({"blocked_reason": "leak", "compute_exhausted": True}, (0.3, 0.1), "validity_blocked", "inconclusive", "fix_validity_blocker"),
        ({"compute_exhausted": True}, (0.3, 0.1), "compute_exhausted", "inconclusive", "stop"),
        ({"valid_next_actions": []}, (0.3, 0.1), "no_valid_next_action", "supported", "stop"),
        ({}, (0.3, 0.299), "low_information_gain", "inconclusive", "go"),
        ({"robustness_stable": False}, (0.3, 0.1), "low_information_gain", "inconclusive", "go"),
        ({"champion_stability_runs": 2}, (0.3, 0.1), "champion_stable", "supported", "stop"),
        ({"policy_threshold_stable": True}, (0.02, 0.001), "policy_threshold_stable", "supported", "stop"),
        ({}, (0.3, 0.1), "business_decision_supportable", "supported", "stop"),
        ({}, (0.03, 0.001), "low_information_gain", "inconclusive", "go"),
    ],
)
def test_stop_precedence(spark, changes, qinis, reason, status, action):
    wave = {
        "experiment_id": "e", "wave_id": "w", "status": "completed", "blocked_reason": None, "compute_exhausted": False,
        "valid_next_actions": ["go"], "champion_stability_runs": 0, "policy_threshold_stable": False, "robustness_stable": None,
    } | changes
    waves = spark.createDataFrame([tuple(wave.values())], WAVE)
    ledger = spark.createDataFrame([trial(i, q) for i, q in enumerate(qinis, start=1)], TRIAL)
    row = trials.wave_outcomes(trials.wave_evidence(waves, ledger)).first()
    assert (row["stop_reason"], row["hypothesis_status"], row["next_action"]) == (reason, status, action)


def test_negative_champion_contradicts(spark):
    waves = spark.createDataFrame([("e", "w", "completed", None, False, ["go"], 0, False, None)], WAVE)
    ledger = spark.createDataFrame([trial(1, -0.05, policy_gain={"top_10pct_zero": -1.0})], TRIAL)
    row = trials.wave_outcomes(trials.wave_evidence(waves, ledger)).first()
    assert row["hypothesis_status"] == "contradicted" and row["should_stop"] and row["next_action"] == "stop"


def test_wave_covers_its_own_trials_and_champion(spark):
    """The best trial of the experiment (4) is foreign to wave a; wave b lists none; c and d name no champion of theirs."""
    schema = WAVE + ", trial_ids array<string>, champion_run_id string"
    runs = [trial(i, q, policy_gain={"k": float(i)}) for i, q in enumerate([0.1, 0.3, None, 0.9], start=1)]
    ledger = spark.createDataFrame(runs, TRIAL)
    ids = {r["seq"]: r["run_id"] for r in ledger.collect()}
    common = ("completed", None, False, ["go"], 0, False, None)
    waves = spark.createDataFrame(
        [
            ("e", "a", *common, [ids[1], ids[2], ids[3], ids[2], "unknown"], ids[1]),
            ("e", "b", *common, [], ids[2]),
            ("e", "c", *common, [ids[1]], None),
            ("e", "d", *common, [ids[1], ids[2]], ids[4]),
            ("other", "x", *common, [ids[1]], ids[1]),
            ("e", "n", *common, None, ids[3]),
        ],
        schema,
    )
    got = {r["wave_id"]: r for r in trials.wave_evidence(waves, ledger).collect()}
    assert {w: (r["champion_metric"], r["runner_up_metric"], r["metric_delta"]) for w, r in got.items()} == {
        "a": (0.1, 0.1, 0.0), "b": (0.3, 0.3, 0.0), "c": (None, None, None), "d": (None, 0.1, None), "x": (None, None, None),
        "n": (None, 0.3, None),
    }
    assert got["a"]["best_policy_gain"] == 1.0 and got["b"]["best_policy_gain"] == 2.0 and got["d"]["best_policy_gain"] is None
