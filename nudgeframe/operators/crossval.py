"""Cross-validation audits: all folds are scored into one frame, judged once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.config import Columns, EvalPolicy, SplitPolicy, stable_hash
from nudgeframe.functions import clean
from nudgeframe.operators import metrics
from nudgeframe.operators.features import feature_columns
from nudgeframe.operators.learners import TrialSpec, fit_linear, fit_uplift, run_trials, scored, trial_results, tuning_specs
from nudgeframe.operators.quality import union
from nudgeframe.operators.split import kfold, stratified_split
from nudgeframe.operators.trials import fold_summary
from nudgeframe.plans.selection import medians
from nudgeframe.session import cut_lineage
from nudgeframe.sources.stages import StageRecord


def fold_models(folds: DataFrame, specs: list[TrialSpec], n_folds: int, seed: int, columns: Columns = Columns()) -> dict:
    """{run_id: {fold: model fitted on the other folds}}.

    Logistic learners of all specs and folds are fitted together, in as many passes over
    the rows as one of them takes; other estimators are fitted one by one.
    """
    linear = [s for s in specs if s.family != "random" and s.estimator == "logistic_regression"]
    parts = {fold: [f for f in range(1, n_folds + 1) if f != fold] for fold in range(1, n_folds + 1)}
    found = {}
    if linear:
        names = feature_columns(folds, columns, ("split", "fold"))
        rows = folds.withColumn("__fold", F.col("fold"))
        fitted = fit_linear(rows, [(s.family, s.params) for s in linear], parts, seed, columns, names)
        found = {s.run_id: models for s, models in zip(linear, fitted)}
    for spec in specs:
        if spec.run_id not in found:
            found[spec.run_id] = {
                fold: fit_uplift(folds.filter(F.col("fold") != fold), spec.family, spec.estimator, spec.params, seed, columns)
                for fold in parts
            }
    return found


def fold_scores(
    labelled: DataFrame, specs: TrialSpec | list[TrialSpec], n_folds: int = 5, seed: int = 20260501, columns: Columns = Columns()
) -> DataFrame:
    """Out-of-fold scores of fixed configurations, keyed by run and fold."""
    specs = [specs] if isinstance(specs, TrialSpec) else specs
    return score_folds(cut_lineage(kfold(labelled, n_folds, seed, columns)), specs, n_folds, seed, columns)


def score_folds(folds: DataFrame, specs: list[TrialSpec], n_folds: int, seed: int, columns: Columns = Columns()) -> DataFrame:
    """``fold_scores`` of rows already dealt and written.

    Linear runs score every row by its own fold's coefficients in one pass for all runs.
    """
    models = fold_models(folds, specs, n_folds, seed, columns)
    kept = [columns.entity, columns.target, columns.treatment]
    linear = [s for s in specs if s.family != "random" and s.estimator == "logistic_regression"]
    parts = []
    if linear:
        names = models[linear[0].run_id][1].feature_columns
        cleaned = folds.withColumns({c: clean.number_or_null(F.col(c)) for c in names})
        score = lambda run: reduce(lambda c, f: c.when(F.col("fold") == f, run[f].linear_score()), sorted(run), F)
        runs = F.array(*[F.struct(F.lit(s.run_id).alias("run_id"), score(models[s.run_id]).alias("score")) for s in linear])
        rows = cleaned.select(*kept, "fold", F.explode(runs).alias("r"))
        parts.append(rows.select("r.run_id", "fold", *kept, F.col("r.score").alias(columns.score)))
    for spec in specs:
        if spec not in linear:
            for fold, model in models[spec.run_id].items():
                out = scored(model, folds.filter(F.col("fold") == fold), columns)
                parts.append(out.select(F.lit(spec.run_id).alias("run_id"), F.lit(fold).alias("fold"), "*"))
    return cut_lineage(union(parts))


def fold_medians(labelled: DataFrame, names: list[str], n_folds: int = 5, seed: int = 20260501, columns: Columns = Columns()) -> DataFrame:
    """(arms, left_out, feature, n_known, median) of every training set of a cross-validated learner.

    ``arms`` is all, treated or control; ``left_out`` is a fold, or 0 where none is. All training
    sets come from one set of histograms kept by arm and fold.
    """
    folds = kfold(labelled, n_folds, seed, columns)
    arm = F.col(columns.treatment).cast("int")
    values = [clean.number_or_null(F.col(c)).alias(c) for c in names]
    rows = cut_lineage(folds.filter(arm.isin(0, 1)).select((arm * (n_folds + 1) + F.col("fold")).alias("cell"), *values))
    counts = {r["cell"]: r for r in rows.groupBy("cell").agg(*[F.count(c).alias(c) for c in names]).collect()}
    groups, places = {}, {}
    for arms, taken in (("all", (0, 1)), ("control", (0,)), ("treated", (1,))):
        for left_out in range(n_folds + 1):
            name = f"{arms}:{left_out}"
            places[name] = (arms, left_out)
            groups[name] = [a * (n_folds + 1) + f for a in taken for f in range(1, n_folds + 1) if f != left_out]
    known = {(g, c): sum(counts[k][c] for k in cells if k in counts) for g, cells in groups.items() for c in names}
    found = medians(rows, names, groups, known)
    table = [(*places[g], c, known[g, c], value) for (g, c), value in found.items()]
    return labelled.sparkSession.createDataFrame(table, "arms string, left_out int, feature string, n_known long, median double")


def fold_metrics(scores: DataFrame, policy: EvalPolicy = EvalPolicy()) -> DataFrame:
    keys = ["run_id", "fold"]
    sizes = scores.groupBy(*keys).agg(
        F.round(F.avg("treatment_flg"), 6).alias("treatment_rate_eval"), F.round(F.avg("target"), 6).alias("target_rate_eval")
    )
    return metrics.metric_bundle(scores, keys, policy.cutoffs).join(sizes, keys)


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean, sample deviation and range of every metric per run."""
    skip = {"run_id", "fold", "n", "treatment_rate_eval", "target_rate_eval"}
    return fold_summary(per_fold, [c for c in per_fold.columns if c not in skip], ["run_id"])


def rerank_by_cv(
    labelled: DataFrame,
    candidates: list[TrialSpec],
    validation: DataFrame,
    policy: SplitPolicy = SplitPolicy(),
    n_folds: int = 5,
    seed: int = 20260501,
    columns: Columns = Columns(),
) -> DataFrame:
    """Leaderboard of validation-chosen candidates by cross-validated mean.

    Folds use the train and validation parts only; the test part stays sealed.
    ``validation`` holds (run_id, normalized_qini_auc) of the first selection.
    """
    pool = cut_lineage(stratified_split(labelled, policy, columns).filter("split != 'test'").drop("split"))
    scores = fold_scores(pool, candidates, n_folds, seed, columns)
    summary = cv_summary(fold_metrics(scores))
    wide = summary.filter(F.col("metric").isin("normalized_qini_auc", "qini_auc", "uplift_auc")).groupBy("run_id").agg(
        *[
            F.max(F.when(F.col("metric") == name, F.col(stat))).alias(f"cv_{stat}_{name}")
            for name in ("normalized_qini_auc", "qini_auc", "uplift_auc")
            for stat in ("mean", "std")
        ]
    )
    first = validation.select("run_id", F.col("normalized_qini_auc").alias("validation_normalized_qini_auc"))
    return wide.join(first, "run_id", "left").orderBy(
        F.col("cv_mean_normalized_qini_auc").desc_nulls_last(),
        F.col("validation_normalized_qini_auc").desc_nulls_last(),
        "run_id",
    )


def select_and_open_test(
    labelled: DataFrame,
    specs: list[TrialSpec],
    top_k: int = 3,
    n_folds: int = 5,
    policy: SplitPolicy = SplitPolicy(),
    columns: Columns = Columns(),
) -> dict[str, DataFrame]:
    """Screen on validation, re-rank the best non-random runs by folds, refit the
    winner on train and validation, and open the test part once."""
    spark = labelled.sparkSession
    results = cut_lineage(trial_results(run_trials(labelled, specs, policy, columns=columns), spark))
    by_id = {spec.run_id: spec for spec in specs}
    leaders = (
        results.filter("status = 'success' and uplift_learner_family != 'random'")
        .orderBy(F.col("normalized_qini_auc").desc_nulls_last(), "run_id")
        .limit(top_k)
        .collect()
    )
    board = cut_lineage(rerank_by_cv(labelled, [by_id[r["run_id"]] for r in leaders], results, policy, n_folds, columns=columns))
    best = board.orderBy(
        F.col("cv_mean_normalized_qini_auc").desc_nulls_last(),
        F.col("validation_normalized_qini_auc").desc_nulls_last(),
        "run_id",
    ).first()
    winner = by_id[best["run_id"]]
    parts = cut_lineage(stratified_split(labelled, policy, columns))
    pool = parts.filter("split != 'test'").drop("split")
    model = fit_uplift(pool, winner.family, winner.estimator, winner.params, winner.split_seed, columns)
    test = scored(model, parts.filter("split = 'test'"), columns).select(F.lit(winner.run_id).alias("run_id"), "*")
    return {"validation": results, "leaderboard": board, "test_scores": test, "test": metrics.metric_bundle(test, ["run_id"])}


SELECTION_STAGES = ("screen", "folds", "tuned", "champion", "test")
_CHOSEN = "normalized_qini_auc"


def selection_settings(
    specs: list[TrialSpec], data: str, top_k: int = 3, n_folds: int = 5, policy: SplitPolicy = SplitPolicy(), fold_seed: int = 20260501
) -> str:
    """A hash of all that a staged selection depends on; ``data`` names the labelled rows."""
    return stable_hash([[asdict(s) for s in specs], data, top_k, n_folds, asdict(policy), fold_seed])


def _stage_rows(specs: list[TrialSpec], judged: DataFrame) -> DataFrame:
    """The runs of a stage with settings, state and result; ``judged`` has one row a run."""
    rows = [(s.run_id, s.family, s.estimator, json.dumps(s.params, sort_keys=True), s.split_seed) for s in specs]
    schema = "run_id string, uplift_learner_family string, base_estimator string, params string, split_seed int"
    found = judged.select("run_id", "status", "error", "n", _CHOSEN, "deviation")
    return judged.sparkSession.createDataFrame(rows, schema).join(found, "run_id")


def _fold_stage(spark: SparkSession, folds: Callable[[], DataFrame], specs: list[TrialSpec], n_folds: int, seed: int, columns: Columns) -> DataFrame:
    """Every spec's mean over folds; one that fails leaves the others alone.

    ``folds`` gives the dealt rows, written once for all stages. Logistic learners share their passes; other estimators are fitted one by one.
    """
    linear = [s for s in specs if s.family != "random" and s.estimator == "logistic_regression"]
    failed, scores = {}, []
    for group in ([linear] if linear else []) + [[s] for s in specs if s not in linear]:
        try:
            scores.append(score_folds(folds(), group, n_folds, seed, columns))
        except Exception as error:  # one broken configuration must not end the stage
            failed |= {s.run_id: str(error) for s in group}
    state = spark.createDataFrame([(s.run_id, failed.get(s.run_id)) for s in specs], "run_id string, error string")
    if not scores:
        empty = {"n": F.lit(None).cast("long"), _CHOSEN: F.lit(None).cast("double"), "deviation": F.lit(None).cast("double")}
        return _stage_rows(specs, state.withColumns(empty | {"status": F.lit("failed")}))
    each = metrics.metric_bundle_with_problems(union(scores), ["run_id", "fold"])
    found = each.groupBy("run_id").agg(
        F.sum("n").alias("n"), F.min("problem").alias("problem"),
        F.round(F.avg(_CHOSEN), 6).alias(_CHOSEN), F.round(F.stddev_samp(_CHOSEN), 6).alias("deviation"),
    )
    judged = state.join(found, "run_id", "left").withColumn("error", F.coalesce("error", "problem"))
    return _stage_rows(specs, judged.withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed")))


def _best(table: DataFrame, k: int) -> list:
    """The k best judged runs; the test part is not among what they are judged by."""
    usable = table.filter((F.col("status") == "success") & (F.col("uplift_learner_family") != "random"))
    rows = usable.orderBy(F.col(_CHOSEN).desc_nulls_last(), "run_id").limit(k).collect()
    if not rows:
        raise ValueError("no successful run to choose from")
    return rows


def _as_spec(row) -> TrialSpec:
    return TrialSpec(row["run_id"], row["uplift_learner_family"], row["base_estimator"], json.loads(row["params"]), row["split_seed"])


def staged_selection(
    labelled: DataFrame,
    specs: list[TrialSpec],
    folder: str,
    data: str,
    top_k: int = 3,
    n_folds: int = 5,
    policy: SplitPolicy = SplitPolicy(),
    fold_seed: int = 20260501,
    columns: Columns = Columns(),
) -> DataFrame:
    """Screen, fold averages, tuning, champion and one look at the test part, as one table.

    Every spec is judged on the validation part (screen); the ``top_k`` best that are not
    random by folds of the train and validation parts (folds); the best of these of each
    estimator with all parameter sets of its grid (tuned). The champion has the highest mean
    of both; refitted on train and validation it is scored on the test part. Each stage is
    written once to ``folder``: a rerun resumes behind the last one recorded, and once the
    test part was opened, no earlier stage can be built again.
    """
    if any(s.split_seed != policy.seed for s in specs):
        raise ValueError("all runs must share the split of the policy: another split would show them the test part")
    settings = selection_settings(specs, data, top_k, n_folds, policy, fold_seed)
    record = StageRecord(labelled.sparkSession, folder, settings, SELECTION_STAGES)
    spark = labelled.sparkSession

    # The split and the folds are written once, by the first stage of a run that needs them.
    @cache
    def split() -> DataFrame:
        return cut_lineage(stratified_split(labelled, policy, columns))

    def part(wanted: str) -> DataFrame:
        return split().filter(wanted).drop("split")

    @cache
    def dealt() -> DataFrame:
        return cut_lineage(kfold(part("split <> 'test'"), n_folds, fold_seed, columns))

    def screen():
        results = trial_results(run_trials(labelled, specs, policy, columns=columns, splits={policy.seed: split()}), spark)
        return _stage_rows(specs, results.withColumn("deviation", F.lit(None).cast("double")))

    def tuned():
        leaders = {}
        for row in _best(record.table("folds"), top_k):
            leaders.setdefault(row["base_estimator"], _as_spec(row))
        grid = [s for leader in leaders.values() for s in tuning_specs(leader, (leader.split_seed,))]
        return _fold_stage(spark, dealt, grid, n_folds, fold_seed, columns)

    def champion():
        both = record.table("folds").unionByName(record.table("tuned"))
        return both.filter(F.col("run_id") == _best(both, 1)[0]["run_id"])

    def test():
        spec = _as_spec(record.table("champion").first())
        model = fit_uplift(part("split <> 'test'"), spec.family, spec.estimator, spec.params, spec.split_seed, columns)
        scores = scored(model, part("split = 'test'"), columns).select(F.lit(spec.run_id).alias("run_id"), "*")
        state = {"status": F.lit("success"), "error": F.lit(None).cast("string"), "deviation": F.lit(None).cast("double")}
        return _stage_rows([spec], metrics.metric_bundle(scores, ["run_id"]).withColumns(state))

    def folds():
        finalists = [_as_spec(row) for row in _best(record.table("screen"), top_k)]
        return _fold_stage(spark, dealt, finalists, n_folds, fold_seed, columns)

    builders = {"screen": screen, "folds": folds, "tuned": tuned, "champion": champion, "test": test}
    return union([record.run(stage, builders[stage]).select(F.lit(stage).alias("stage"), "*") for stage in SELECTION_STAGES])
