"""Queries over a table of trial records holding many experiments.

``seq`` is the append order. An experiment may hold a large share of all trials:
per-experiment answers are built from mergeable aggregates and from row numbers
cut at a small constant, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nudgeframe.functions import clean
from nudgeframe.operators.robustness import gain_rows
from nudgeframe.plans.prefix import running
from nudgeframe.plans.skew import skew_join

EXPERIMENT = "experiment_id"
CONFIG = ("params_hash", "uplift_learner_family", "base_estimator", "feature_recipe_id")
# Fixed value: estimators with known tuning grids.
TUNABLE_ESTIMATORS = ("logistic_regression", "gradient_boosting", "random_forest", "xgboost", "lightgbm", "catboost")


def success() -> Column:
    return F.col("status") == "success"


def is_manual() -> Column:
    return F.coalesce(F.col("hypothesis_id") == "manual_baseline", F.lit(False))


def is_tuning_run() -> Column:
    return F.coalesce(F.col("hypothesis_id").contains("__tune_"), F.lit(False))


def tunable() -> Column:
    """Successful, automatic, not itself a tuning run, and of a known learner."""
    planned = F.coalesce(F.col("hypothesis_id").startswith("agentic_tune__"), F.lit(False))
    return (
        success()
        & ~is_manual()
        & ~is_tuning_run()
        & ~planned
        & F.col("base_estimator").isin(*TUNABLE_ESTIMATORS)
        & (F.col("uplift_learner_family") != "random")
    )


def validation_score() -> Column:
    """Normalised validation Qini, else the raw one."""
    return F.coalesce("normalized_qini_auc", "qini_auc")


def _best(metric: Column, first: Column) -> Column:
    """Ordering struct: higher metric, then earlier record; null metric last."""
    return F.struct(F.coalesce(metric, F.lit(float("-inf"))), -first)


def config_hashes(trials: DataFrame) -> DataFrame:
    """Short stable hash of every trial's configuration (keys in sorted order)."""
    config = F.to_json(
        F.struct(
            "base_estimator", "feature_recipe_id", F.col("uplift_learner_family").alias("learner_family"), "split_seed"
        )
    )
    return trials.select("run_id", clean.short_hash(config).alias("config_hash"))


def champions(trials: DataFrame, by=(EXPERIMENT,), metric: str = "normalized_qini_auc") -> DataFrame:
    """Best successful trial per group; the first wins ties."""
    chosen = F.max_by(F.struct("seq", "run_id", "uplift_learner_family", metric), _best(F.col(metric), F.col("seq")))
    return trials.filter(success()).groupBy(*by).agg(chosen.alias("c")).select(
        *by, F.col("c.run_id").alias("champion_run_id"), F.col("c.uplift_learner_family").alias("champion_family"),
        F.col(f"c.{metric}").alias("champion_metric"),
    )


def latest_hypotheses(snapshots: DataFrame) -> DataFrame:
    """Last snapshot of every hypothesis id."""
    fields = [c for c in snapshots.columns if c != "hypothesis_id"]
    return (
        snapshots.groupBy("hypothesis_id")
        .agg(F.max_by(F.struct(*fields), F.col("seq")).alias("s"))
        .select("hypothesis_id", *[F.col(f"s.{name}").alias(name) for name in fields])
    )


def hypotheses_where(
    snapshots: DataFrame, status: str | None = None, action_type: str | None = None, trial_id: str | None = None
) -> DataFrame:
    """Latest snapshots filtered by state, action or linked trial."""
    latest = latest_hypotheses(snapshots)
    if status is not None:
        latest = latest.filter(F.col("status") == status)
    if action_type is not None:
        latest = latest.filter(F.col("action_type") == action_type)
    if trial_id is not None:
        latest = latest.filter(F.array_contains("trial_ids", trial_id))
    return latest


def first_seen(df: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """First row of every key in append order."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("s"))
        .select(*key, *[F.col(f"s.{name}").alias(name) for name in rest])
        .select(*df.columns)
    )


def duplicate_configs(trials: DataFrame, by=(EXPERIMENT,)) -> DataFrame:
    """Earliest trial per group that repeats an already-run configuration."""
    order = Window.partitionBy(*by, *CONFIG).orderBy("seq")
    second = trials.withColumn("i", F.row_number().over(order)).filter("i <= 2").filter("i = 2")
    return second.groupBy(*by).agg(F.min_by(F.struct("seq", "run_id", "params_hash"), "seq").alias("d")).select(
        *by, F.col("d.seq").alias("duplicate_seq"), F.col("d.run_id").alias("duplicate_run_id"),
        F.col("d.params_hash").alias("duplicate_params_hash"),
    )


def plateau_class(
    trials: DataFrame, max_trials: int = 5, flat_window: int = 3, flat_qini: float = 0.005, already_run: int = 0
) -> DataFrame:
    """Retry decision per experiment: budget, then duplicate, then plateau."""
    counted = trials.filter(~is_manual() & ~is_tuning_run())
    good = counted.filter(success())
    sizes = counted.groupBy(EXPERIMENT).agg(F.count_if(success()).alias("successful"))
    recent_order = Window.partitionBy(EXPERIMENT).orderBy(F.col("seq").desc())
    recent = (
        good.select(EXPERIMENT, "seq", "qini_auc")
        .withColumn("i", F.row_number().over(recent_order))
        .filter(F.col("i") <= flat_window)
        .groupBy(EXPERIMENT)
        .agg(F.count("qini_auc").alias("known"), (F.max("qini_auc") - F.min("qini_auc")).alias("spread"))
    )
    joined = sizes.join(duplicate_configs(good), EXPERIMENT, "left").join(recent, EXPERIMENT, "left")
    flat = (F.col("known") == flat_window) & (F.col("spread") <= flat_qini)
    decision = (
        F.when(F.col("successful") - already_run >= max_trials, "budget_reached")
        .when(F.col("duplicate_run_id").isNotNull(), "duplicate_config")
        .when(flat, "plateau")
        .otherwise("continue")
    )
    action = (
        F.when(decision == "continue", "plan_next_trial")
        .when(decision == "duplicate_config", "change_strategy")
        .otherwise("generate_report")
    )
    return joined.select(
        EXPERIMENT,
        "successful",
        "duplicate_run_id",
        decision.alias("decision"),
        (decision == "continue").alias("should_continue"),
        action.alias("next_action"),
    )


def seed_stability(trials: DataFrame, by=(EXPERIMENT,)) -> DataFrame:
    """Spread of repeated-seed runs of one configuration, with a verdict."""
    kept = trials.filter(success() & ~is_manual())
    val, held = F.col("normalized_qini_auc"), F.col("held_out_normalized_qini_auc")
    spread = F.when(F.count(held) >= 2, F.round(F.max(held) - F.min(held), 6))
    groups = kept.groupBy(*by, *CONFIG).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_distinct("split_seed").alias("distinct_seeds"),
        F.round(F.avg(val), 6).alias("mean_validation"),
        F.round(F.avg(held), 6).alias("mean_held_out"),
        F.round(F.min(held), 6).alias("min_held_out"),
        spread.alias("held_out_range"),
    )
    usable = groups.filter(
        (F.col("runs") >= 2) & (F.col("mean_validation").isNotNull() | F.col("mean_held_out").isNotNull())
    )
    low, wide = F.col("min_held_out"), F.col("held_out_range")
    verdict = (
        F.when(low.isNull() | wide.isNull(), "needs more seeds")
        .when((low >= 0.20) & (wide <= 0.05), "stable")
        .when((low >= 0.15) & (wide <= 0.10), "watch")
        .otherwise("unstable")
    )
    return usable.withColumn("verdict", verdict)


def trial_table(trials: DataFrame) -> DataFrame:
    """Report columns of every trial that is not a tuning run."""
    return trials.filter(~is_tuning_run()).select(
        EXPERIMENT,
        "run_id",
        F.when(is_manual(), "manual").otherwise("agent").alias("role"),
        "uplift_learner_family",
        "base_estimator",
        "feature_recipe_id",
        "normalized_qini_auc",
        "uplift_auc",
        "held_out_normalized_qini_auc",
    )


def best_per_recipe(trials: DataFrame, by=(EXPERIMENT,)) -> DataFrame:
    """Best automatic trial of every feature recipe."""
    kept = trials.filter(success() & ~is_manual())
    best = F.max_by(F.struct("run_id", "normalized_qini_auc"), _best(validation_score(), F.col("seq")))
    return kept.groupBy(*by, "feature_recipe_id").agg(F.count(F.lit(1)).alias("trials"), best.alias("b")).select(
        *by, "feature_recipe_id", "trials", F.col("b.run_id").alias("best_run_id"),
        F.col("b.normalized_qini_auc").alias("best_normalized_qini_auc"),
    )


def benchmark_delta(trials: DataFrame) -> DataFrame:
    """Best automatic trial against the latest manual benchmark, per experiment."""
    score = validation_score()
    held = "held_out_normalized_qini_auc"
    good = trials.filter(success())
    pick = F.struct("run_id", score.alias("score"), held)
    sides = good.groupBy(EXPERIMENT).agg(
        F.max_by(pick, F.when(~is_manual(), _best(score, F.col("seq")))).alias("c"),
        F.max_by(pick, F.when(is_manual(), F.col("seq"))).alias("b"),
    )
    delta = F.col("c.score") - F.col("b.score")
    return sides.filter(F.col("c").isNotNull()).select(
        EXPERIMENT,
        F.col("c.run_id").alias("champion_run_id"),
        F.col("b.run_id").alias("benchmark_run_id"),
        F.round(delta, 6).alias("delta"),
        F.when(delta.isNull(), "champion_only")
        .when(delta >= 0, "use_champion")
        .otherwise("keep_benchmark")
        .alias("decision"),
        F.coalesce(F.col(f"b.{held}") > F.col(f"c.{held}"), F.lit(False)).alias("held_out_caution"),
    )


def tuning_candidates(trials: DataFrame, top_k: int = 2, by=(EXPERIMENT,)) -> DataFrame:
    """Best tunable trial per (template, recipe), then the top few per group."""
    score = validation_score()
    fields = ("run_id", "base_estimator", "split_seed", "params_hash")
    best = F.max_by(F.struct(*fields, score.alias("score")), _best(score, F.col("seq")))
    per = (
        trials.filter(tunable() & score.isNotNull())
        .groupBy(*by, "template_name", "feature_recipe_id")
        .agg(best.alias("b"))
        .select(*by, "template_name", "feature_recipe_id", *[F.col(f"b.{f}").alias(f) for f in (*fields, "score")])
    )
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("template_name").desc(), F.col("run_id").desc())
    return per.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, top_k))


def validation_leaders(trials: DataFrame, top_k: int = 3, by=()) -> DataFrame:
    """First-seen runs ranked by normalised, then raw, validation Qini."""
    unique = first_seen(trials, [*by, "run_id"])
    kept = unique.filter(success() & F.col("normalized_qini_auc").isNotNull() & F.col("qini_auc").isNotNull())
    ordering = [F.col("normalized_qini_auc").desc(), F.col("qini_auc").desc(), F.col("seq").asc()]
    chosen = kept.select(*by, "seq", "run_id", "template_name", "normalized_qini_auc", "qini_auc")
    if by:
        ranked = chosen.withColumn("validation_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*ordering)))
        return ranked.filter(F.col("validation_rank") <= top_k).drop("seq")
    # The limit runs as a top-k inside each task; only its rows are numbered.
    top = chosen.orderBy(*ordering).limit(top_k)
    return top.withColumn("validation_rank", F.row_number().over(Window.orderBy(*ordering))).drop("seq")


def tuning_summary(trials: DataFrame) -> DataFrame:
    return trials.select(
        "run_id",
        "hypothesis_id",
        "status",
        F.col("uplift_learner_family").alias("learner_family"),
        "base_estimator",
        "split_seed",
        "params_hash",
        F.col("normalized_qini_auc").alias("val_normalized_qini"),
        validation_score().alias("selection_score"),
        F.lit("validation_only").alias("selection_score_source"),
    )


def trial_summary(trials: DataFrame, metric: str = "normalized_qini_auc") -> DataFrame:
    """Totals and the best successful trial per experiment (null metric = 0)."""
    value = F.coalesce(F.col(metric), F.lit(0.0))
    best = F.max_by(F.struct("run_id", metric), F.when(success(), F.struct(value, -F.col("seq"))))
    return trials.groupBy(EXPERIMENT).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(success()).alias("successful"), best.alias("b")
    ).select(
        EXPERIMENT, "total", "successful", F.col("b.run_id").alias("best_run_id"), F.col(f"b.{metric}").alias("best_metric")
    )


def family_means(trials: DataFrame, by=()) -> DataFrame:
    return (
        trials.filter(F.col("qini_auc").isNotNull())
        .groupBy(*by, "uplift_learner_family")
        .agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("qini_auc"), 6).alias("mean_qini_auc"))
    )


def wave_trials(waves: DataFrame, trials: DataFrame) -> DataFrame:
    """The ledger rows of each wave: (experiment, wave_id, seq, run_id, qini_auc, policy_gain).

    A wave that lists ``trial_ids`` covers those of its experiment's trials, one that
    lists none the whole experiment. Lists become rows, so membership is an equi-join.
    """
    ledger = trials.select(EXPERIMENT, "seq", "run_id", "qini_auc", "policy_gain")
    listed = F.coalesce(F.size("trial_ids"), F.lit(0)) > 0
    chosen = waves.filter(listed).select(EXPERIMENT, "wave_id", F.explode(F.array_distinct("trial_ids")).alias("run_id"))
    whole = waves.filter(~listed).select(EXPERIMENT, "wave_id")
    return chosen.join(ledger, [EXPERIMENT, "run_id"]).unionByName(whole.join(ledger, EXPERIMENT))


def wave_evidence(waves: DataFrame, trials: DataFrame) -> DataFrame:
    """Champion, runner-up and best policy gain of every wave, from its own trials.

    Waves with ``trial_ids`` and ``champion_run_id`` are judged by the champion they name
    (null where they name none, or one outside their trials) against the second best
    finite score of their trials. Waves without these columns are judged by the two best
    successful trials of their experiment. Row numbers are limited to 2, so no wave's
    trials meet in one task.
    """
    wave = [EXPERIMENT, "wave_id"]
    scoped = {"trial_ids", "champion_run_id"} <= set(waves.columns)
    if scoped:
        pool = wave_trials(waves, trials)
        named = waves.select(*wave, F.col("champion_run_id").alias("run_id"))
        champion = (
            pool.join(named, [*wave, "run_id"])
            .groupBy(*wave)
            .agg(F.min_by(F.struct("qini_auc", "policy_gain"), "seq").alias("c"))
            .select(*wave, F.col("c.qini_auc").alias("champion_metric"), F.col("c.policy_gain").alias("policy_gain"))
        )
    else:
        pool = waves.select(*wave).join(trials.filter(success()), EXPERIMENT)
    finite = F.col("qini_auc").isNotNull() & ~F.isnan("qini_auc") & (F.abs("qini_auc") < float("inf"))
    order = Window.partitionBy(*wave).orderBy(F.col("qini_auc").desc(), "seq")
    top = (
        pool.filter(finite)
        .select(*wave, "seq", "run_id", "qini_auc", "policy_gain")
        .withColumn("i", F.row_number().over(order))
        .filter("i <= 2")
    )
    second = top.filter("i = 2").select(*wave, F.col("qini_auc").alias("runner_up_metric"))
    if not scoped:
        champion = top.filter("i = 1").select(
            *wave, F.col("run_id").alias("champion_run_id"), F.col("qini_auc").alias("champion_metric"), "policy_gain"
        )
    gain = F.max_by(F.struct("key", "gain"), F.struct("gain", -F.col("position")))
    best_gain = (
        gain_rows(champion, wave)
        .filter(F.col("gain").isNotNull() & ~F.isnan("gain") & (F.abs("gain") < float("inf")))
        .groupBy(*wave)
        .agg(gain.alias("g"))
        .select(*wave, F.col("g.key").alias("best_policy_gain_key"), F.col("g.gain").alias("best_policy_gain"))
    )
    return (
        waves.join(champion.drop("policy_gain"), wave, "left")
        .join(second, wave, "left")
        .join(best_gain, wave, "left")
        .withColumn("metric_delta", F.round(F.col("champion_metric") - F.col("runner_up_metric"), 6))
    )


def wave_outcomes(
    evidence: DataFrame,
    min_delta: float = 0.01,
    business_metric: float = 0.05,
    contradiction_metric: float = -0.01,
    policy_gain: float = 0.0,
    stable_runs: int = 2,
) -> DataFrame:
    """Stop reason, hypothesis status and next action of every wave.

    Rules apply in order of precedence, first match wins.
    """
    metric, gain, delta = F.col("champion_metric"), F.col("best_policy_gain"), F.col("metric_delta")
    actions = F.coalesce(F.col("valid_next_actions"), F.array().cast("array<string>"))
    known = metric.isNotNull()
    supportable = F.coalesce(known & (metric >= business_metric) & (gain >= policy_gain), F.lit(False))
    against = F.coalesce(
        known & (metric <= contradiction_metric) & (gain.isNull() | (gain <= policy_gain)), F.lit(False)
    )
    weak = F.when(against, "contradicted").otherwise("inconclusive")
    by_evidence = F.when(supportable, "supported").otherwise(weak)
    unstable = F.coalesce(~F.col("robustness_stable"), F.lit(False))
    calm_policy = F.coalesce(F.col("policy_threshold_stable") & (gain >= policy_gain), F.lit(False))
    first_action = F.get(actions, F.lit(0))
    check = "ranking_stability_check"

    rules = [
        (F.col("status").isin("blocked", "failed") | (F.coalesce("blocked_reason", F.lit("")) != ""),
         "validity_blocked", F.lit("inconclusive"), F.lit(True), F.lit("fix_validity_blocker")),
        (F.col("compute_exhausted"), "compute_exhausted", F.lit("inconclusive"), F.lit(True), F.lit("stop")),
        (F.size(actions) == 0, "no_valid_next_action", by_evidence, F.lit(True), F.lit("stop")),
        (~known | F.coalesce(delta < min_delta, F.lit(False)), "low_information_gain", weak, against,
         F.when(against, "stop").otherwise(first_action)),
        (unstable, "low_information_gain", F.lit("inconclusive"), F.lit(False),
         F.when(F.array_contains(actions, check), check).otherwise(first_action)),
        (F.col("champion_stability_runs") >= stable_runs, "champion_stable", F.lit("supported"), F.lit(True), F.lit("stop")),
        (calm_policy, "policy_threshold_stable", F.lit("supported"), F.lit(True), F.lit("stop")),
        (supportable, "business_decision_supportable", F.lit("supported"), F.lit(True), F.lit("stop")),
        (F.lit(True), "low_information_gain", weak, against, F.when(against, "stop").otherwise(first_action)),
    ]

    outcome = None
    for condition, reason, status, stop, action in rules:
        row = F.struct(
            F.lit(reason).alias("stop_reason"),
            status.alias("hypothesis_status"),
            stop.alias("should_stop"),
            action.alias("next_action"),
        )
        outcome = F.when(condition, row) if outcome is None else outcome.when(condition, row)
    return evidence.withColumn("o", outcome).select(
        EXPERIMENT, "wave_id", "champion_run_id", "champion_metric", "metric_delta", "best_policy_gain_key",
        "best_policy_gain", "o.*",
    )


# Fixed value: verdicts from least to most optimistic.
VERDICTS = ("contradicted", "inconclusive", "supported")


def verdict_ceiling(trials: DataFrame, proposed: str | None = None) -> DataFrame:
    """Most optimistic verdict each trial's own evidence allows.

    A positive trial must also beat the best earlier success of its experiment on
    raw Qini and not trail it on uplift AUC. With ``proposed`` naming a verdict
    column, that verdict is clamped to the ceiling.
    """
    judged = validation_score()
    candidate = F.when(
        success() & F.col("qini_auc").isNotNull(),
        F.struct(F.col("qini_auc"), (-F.col("seq")).alias("first"), F.col("uplift_auc")),
    )
    walked = running(
        trials, [EXPERIMENT], [("seq", False)], {"position": F.lit(1).cast("long")}, prior_max={"prior": candidate}
    )
    worse_qini = F.coalesce(F.col("qini_auc") <= F.col("prior.qini_auc"), F.lit(False))
    worse_auc = F.coalesce(F.col("uplift_auc") < F.col("prior.uplift_auc") - 0.001, F.lit(False))
    ceiling = (
        F.when(~success() | judged.isNull(), VERDICTS[1])
        .when(judged <= -0.01, VERDICTS[0])
        .when((judged >= 0.05) & ~worse_qini & ~worse_auc, VERDICTS[2])
        .otherwise(VERDICTS[1])
    )
    columns = [EXPERIMENT, "seq", "run_id", "status", F.col("prior.qini_auc").alias("prior_qini_auc"), ceiling.alias("ceiling")]
    if proposed is not None:
        rank = F.create_map(*[part for i, v in enumerate(VERDICTS) for part in (F.lit(v), F.lit(i))])
        wanted = rank[F.col(proposed)]
        bounded = F.when(~success(), VERDICTS[1]).when(wanted <= rank[ceiling], F.col(proposed)).otherwise(ceiling)
        columns.append(bounded.alias("verdict"))
    return walked.select(*columns)


def fold_summary(fold_metrics: DataFrame, metrics: list[str], by=()) -> DataFrame:
    """Mean, sample deviation and range of every fold metric."""
    long = fold_metrics.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(by), metrics, "metric", "value"
    )
    return long.groupBy(*by, "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.round(F.min("value"), 6).alias("min"),
        F.round(F.max("value"), 6).alias("max"),
    )


def cv_test_gap(cv: DataFrame, test: DataFrame, key: str = "run_id", metric: str = "normalized_qini_auc") -> DataFrame:
    """Cross-validated mean beside the test value and their difference."""
    joined = skew_join(
        cv.select(key, F.col(metric).alias(f"{metric}_cv")), test.select(key, F.col(metric).alias(f"{metric}_test")), [key]
    )
    return joined.withColumn("gap", F.round(F.col(f"{metric}_cv") - F.col(f"{metric}_test"), 5))
