"""Learners, cross-validation and explanations on planted uplift."""

import pytest
from pyspark.sql import functions as F

from nudgeframe.catalog import registry
from nudgeframe.functions import clean
from nudgeframe.operators import crossval, explain, learners, logistic, metrics
from nudgeframe.operators.learners import TrialSpec
from nudgeframe.session import cut_lineage
from nudgeframe.sources import artifacts
from tests.conftest import SMALL_DIR

FAST = {"max_iter": 10}


@pytest.fixture(scope="module")
def planted(spark):
    """Contact helps customers with x > 0.5 only; z is noise, hole mostly null."""
    key = F.concat(F.lit("c"), F.col("id").cast("string"))
    x, z, n = (clean.hash_uniform(key, s) for s in ("x", "z", "n"))
    t = (clean.hash_uniform(key, "t") < 0.5).cast("int")
    df = spark.range(1200).select(
        key.alias("client_id"), x.alias("x"), z.alias("z"), t.alias("treatment_flg"),
        F.when(F.col("id") % 50 == 0, z).alias("hole"), n.alias("n"),
    )
    chance = 0.2 + 0.6 * F.col("treatment_flg") * (F.col("x") > 0.5).cast("int")
    return cut_lineage(df.withColumn("target", (F.col("n") < chance).cast("int")).drop("n"))


def spearman_with_x(model, df):
    return model.score(df).agg(F.corr("uplift", "x")).first()[0]


@pytest.mark.parametrize("family", ["two_model", "class_transformation"])
def test_learners_find_planted_uplift(planted, family):
    model = learners.fit_uplift(planted, family, "logistic_regression", FAST)
    assert set(model.feature_columns) == {"x", "z", "hole"}
    assert spearman_with_x(model, planted) > 0.7
    low, high = model.score(planted.drop("target", "treatment_flg")).agg(F.min("uplift"), F.max("uplift")).first()
    assert -1 <= low < high <= 1
    assert metrics.normalized_qini(learners.scored(model, planted)).first()[0] > 0.1


def test_tree_learners_score_without_labels(planted):
    features = planted.drop("target", "treatment_flg")
    for family, estimator, params in (
        ("solo_model", "random_forest", {"n_estimators": 5, "min_samples_leaf": 10}),
        ("two_model", "lightgbm", {"n_estimators": 3}),
        ("response_model", "gradient_boosting", {"n_estimators": 3}),
    ):
        scored = learners.fit_uplift(planted, family, estimator, params).score(features)
        assert scored.filter("uplift is null").count() == 0 and scored.count() == 1200


def test_one_class_slice_gives_constant(planted):
    only = planted.filter("treatment_flg = 1 or target = 0")
    model = learners.fit_uplift(only, "two_model", "logistic_regression", FAST)
    assert model.control.pipeline is None and model.control.constant == 0.0
    assert model.score(only).filter("uplift < 0").count() == 0


def test_all_null_feature_is_left_out(planted):
    model = learners.fit_uplift(planted.withColumn("void", F.lit(None).cast("double")), "response_model", params=FAST)
    assert "void" not in model.model.inputs


def test_random_scores_are_repeatable(planted):
    model = learners.fit_uplift(planted, "random", seed=5)
    a = model.score(planted).select("client_id", "uplift")
    b = model.score(planted.repartition(5)).select("client_id", "uplift")
    assert sorted(a.collect()) == sorted(b.collect())
    low, high, mean = a.agg(F.min("uplift"), F.max("uplift"), F.avg("uplift")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.05


def test_unknown_names_are_rejected(planted):
    with pytest.raises(ValueError):
        learners.fit_uplift(planted, "magic")
    with pytest.raises(ValueError):
        learners.make_classifier("svm", {}, 1, 10)


def test_batch_records_failures_and_hides_test_part(spark, planted):
    specs = [TrialSpec("bad", "two_model", "svm"), TrialSpec("good", "two_model", params=FAST)]
    batch = learners.run_trials(planted, specs)
    results = {r["run_id"]: r for r in learners.trial_results(batch, spark).collect()}
    assert results["bad"]["status"] == "failed" and "svm" in results["bad"]["error"]
    assert results["good"]["normalized_qini_auc"] is not None
    assert batch.held_out is None and not any(c.startswith("held_out") for c in results["good"].asDict())
    best = learners.champion_spec(learners.trial_results(batch, spark), specs)
    assert best.run_id == "good"
    submission = learners.refit_and_score(planted, planted.drop("target", "treatment_flg"), best)
    assert submission.columns == ["client_id", "uplift"] and submission.count() == 1200


def test_tuning_grid_order():
    specs = learners.tuning_specs(TrialSpec("t", "two_model", "xgboost", split_seed=5), seeds=(42, 7, 42))
    assert [s.run_id for s in specs] == [f"t__tune_p{p}_s{s}" for p in (1, 2) for s in (5, 42, 7)]
    assert len({s.params_hash for s in specs}) == 2


def test_cross_validation_covers_every_row_once(planted):
    scores = crossval.fold_scores(planted, TrialSpec("r", "class_transformation", params=FAST), 3)
    assert scores.count() == scores.select("client_id").distinct().count() == 1200
    summary = {r["metric"]: r for r in crossval.cv_summary(crossval.fold_metrics(scores)).collect()}
    assert summary["normalized_qini_auc"]["min"] <= summary["normalized_qini_auc"]["mean"] <= summary["normalized_qini_auc"]["max"]


def test_permutation_sensitivity_puts_driver_first(planted):
    model = learners.fit_uplift(planted, "two_model", params=FAST)
    rows = explain.permutation_sensitivity(model, planted).collect()
    assert rows[0]["feature"] == "x" and rows[0]["direction"] == "higher_feature_higher_uplift"
    drops = explain.permutation_importance(model, planted).collect()
    assert drops[0]["feature"] == "x" and drops[0]["normalized_qini_drop"] > 0
    assert max(model.native_importance().items(), key=lambda item: item[1])[0] == "x"


def test_permuted_copies_keep_each_feature_multiset(planted):
    sample = explain.sample_rows(planted.select("client_id", "x", "z"), 40)
    moved = explain.permuted_copies(sample, ["x", "z"])
    assert moved.count() == 80
    xs = sorted(r["x"] for r in sample.collect())
    assert sorted(r["x"] for r in moved.filter("feature = 'x'").collect()) == xs
    assert sorted(moved.filter("feature = 'z'").select("client_id", "x").collect()) == sorted(sample.select("client_id", "x").collect())


@pytest.mark.parametrize("family", ["two_model", "solo_model", "class_transformation", "response_model"])
def test_moved_scores_of_linear_learners_equal_whole_copies(planted, family, monkeypatch):
    model = learners.fit_uplift(planted, family, params=FAST)
    columns = ["x", "z", "hole"]
    narrow = explain.moved_scores(model, planted, columns, ["target"])
    assert narrow.columns == ["feature", "client_id", "target", "base", "uplift"]
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["feature"], r["client_id"]): (r["base"], r["uplift"]) for r in narrow.collect()}
    monkeypatch.setattr(explain, "_linear_parts", lambda model: None)
    whole = explain.moved_scores(model, planted, columns, ["target"])
    assert len(got) == 3600 and "__swap" not in plan
    for r in whole.collect():
        assert got[r["feature"], r["client_id"]] == pytest.approx((r["base"], r["uplift"]), abs=1e-12)


def test_driver_flags(spark):
    rows = [("a", "age_clean", 9.0), ("a", "days_to_first_redeem", 5.0), ("b", "purchase_sum", 9.0), ("b", "age_clean", 1.0)]
    df = spark.createDataFrame(rows, "run_id string, feature string, importance double")
    flags = {r["run_id"]: r for r in explain.driver_semantics(df).collect()}
    assert flags["a"]["age_dominance_warning"] and not flags["a"]["behavioral_top5_present"]
    assert flags["b"]["behavioral_top5_present"] and not flags["b"]["age_dominance_warning"]
    assert {r["run_id"]: r["leakage_suspected"] for r in explain.leakage_flags(df).collect()} == {"a": True, "b": False}
    row = explain.driver_stability(df).first()
    assert row["consistent_top3"] == ["age_clean"] and not row["stable"]
    assert explain.driver_stability(df.filter("run_id = 'a'")).first()["stable"]


def test_a_bad_run_fails_alone(planted, monkeypatch):
    """A run whose scores cannot be judged is marked failed; the others keep their metrics."""
    real = learners.scored

    def broken(model, frame, columns=learners.Columns()):
        out = real(model, frame, columns)
        return out.withColumn("uplift", F.lit(None).cast("double")) if model.family == "response_model" else out

    monkeypatch.setattr(learners, "scored", broken)
    specs = [TrialSpec("a", "random"), TrialSpec("b", "response_model", params=FAST), TrialSpec("c", "no_such_family")]
    rows = {r["run_id"]: r for r in learners.trial_results(learners.run_trials(planted, specs), planted.sparkSession).collect()}
    assert rows["a"]["status"] == "success" and rows["a"]["qini_auc"] is not None
    assert rows["b"]["status"] == "failed" and rows["b"]["error"] == "uplift contains missing values" and rows["b"]["qini_auc"] is None
    assert rows["c"]["status"] == "failed" and "no_such_family" in rows["c"]["error"]


def test_an_empty_validation_part_is_replaced_by_the_test_part(planted):
    policy = learners.SplitPolicy(train=0.5, validation=0.0, test=0.5, min_rows_per_partition=1)
    batch = learners.run_trials(planted, [TrialSpec("a", "random")], policy)
    assert 550 <= batch.scores.count() <= 650


def test_staged_selection_resumes_and_opens_the_test_part_once(planted, tmp_path, monkeypatch):
    specs = [TrialSpec("r", "random"), TrialSpec("a", "two_model", params=FAST), TrialSpec("b", "class_transformation", params=FAST),
             TrialSpec("bad", "two_model", "svm")]
    monkeypatch.setitem(learners.TUNING_GRIDS, "logistic_regression", ({"C": 0.3, "max_iter": 10}, {"C": 3.0, "max_iter": 10}))
    folder, real, opened = str(tmp_path), crossval.scored, []

    def interrupted(*args):
        opened.append(1)
        if len(opened) == 1:
            raise RuntimeError("lost")
        return real(*args)

    select = lambda: crossval.staged_selection(planted, specs, folder, "planted", top_k=2, n_folds=3)
    monkeypatch.setattr(crossval, "scored", interrupted)
    with pytest.raises(RuntimeError, match="lost"):
        select()
    monkeypatch.setattr(crossval, "run_trials", None)  # the screen is not built again
    rows = select().collect()
    by_stage = {stage: [r for r in rows if r["stage"] == stage] for stage in crossval.SELECTION_STAGES}
    assert {stage: len(found) for stage, found in by_stage.items()} == {"screen": 4, "folds": 2, "tuned": 2, "champion": 1, "test": 1}
    assert {r["run_id"]: r["status"] for r in by_stage["screen"]} == {"r": "success", "a": "success", "b": "success", "bad": "failed"}
    assert {r["n"] for r in by_stage["folds"] + by_stage["tuned"]} == {1020} and by_stage["test"][0]["n"] == 180
    best = max(by_stage["folds"] + by_stage["tuned"], key=lambda r: r["normalized_qini_auc"])
    assert by_stage["champion"][0]["normalized_qini_auc"] == best["normalized_qini_auc"]
    assert by_stage["test"][0]["run_id"] == by_stage["champion"][0]["run_id"]
    assert sorted(select().collect()) == sorted(rows) and len(opened) == 2
    with pytest.raises(ValueError, match="other settings"):
        crossval.staged_selection(planted, specs, folder, "planted", top_k=1, n_folds=3)
    with pytest.raises(ValueError, match="share the split"):
        crossval.staged_selection(planted, [TrialSpec("a", "two_model", split_seed=7)], folder, "planted")


def test_fits_use_every_core(spark, planted, monkeypatch):
    """A split is laid out by its few strata; the rows of a fit are dealt over the cores all the same."""
    found = []

    def note(rows, *_):
        found.append(rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        raise InterruptedError

    monkeypatch.setattr(learners, "_fit_pipeline", note)
    monkeypatch.setattr(logistic, "_moments", note)
    for estimator in ("gradient_boosting", "logistic_regression"):
        with pytest.raises(InterruptedError):
            learners.fit_uplift(planted.coalesce(1), "solo_model", estimator)
    cores = spark.sparkContext.defaultParallelism
    assert [len(rows) for rows in found] == [cores, cores]
    assert all(max(r["n"] for r in rows) <= 2 * 1200 / cores for rows in found)


def test_logistic_trials_of_a_batch_are_fitted_together(planted, monkeypatch):
    calls, real = [], learners.fit_jobs
    monkeypatch.setattr(learners, "fit_jobs", lambda *a: calls.append(len(a[2])) or real(*a))
    specs = [TrialSpec(f, f, params=FAST) for f in ("response_model", "two_model", "class_transformation")]
    batch = learners.run_trials(planted, specs)
    assert calls == [4]
    single = learners.run_trials(planted, specs[1:2])
    assert batch.models["two_model"].treated.linear.weights == pytest.approx(single.models["two_model"].treated.linear.weights, abs=1e-9)
    bad = TrialSpec("bad", "solo_model", params={"C": "none"})
    states = {r["run_id"]: r["status"] for r in learners.run_trials(planted, [bad, *specs[:2]]).records}
    assert states == {"bad": "failed", "response_model": "success", "two_model": "success"}


def test_a_selection_splits_and_deals_its_rows_once(planted, tmp_path, monkeypatch):
    calls = {"stratified_split": 0, "kfold": 0}
    for module in (crossval, learners):
        for name in calls:
            if hasattr(module, name):
                real = getattr(module, name)
                monkeypatch.setattr(module, name, lambda *a, real=real, name=name: calls.update({name: calls[name] + 1}) or real(*a))
    monkeypatch.setitem(learners.TUNING_GRIDS, "logistic_regression", ({"C": 0.3, "max_iter": 10},))
    specs = [TrialSpec("r", "random"), TrialSpec("c", "class_transformation", params=FAST)]
    rows = crossval.staged_selection(planted, specs, f"{tmp_path}/selection", "planted", top_k=1, n_folds=3).collect()
    assert {r["stage"] for r in rows} == set(crossval.SELECTION_STAGES)
    assert calls == {"stratified_split": 1, "kfold": 1}


def test_learner_queries_do_not_digest_the_facts(spark, monkeypatch):
    def digest(tables):
        raise AssertionError(f"digest of {sorted(tables)}")

    monkeypatch.setattr(artifacts, "content_fingerprint", digest)
    scores = registry.queries()["learner_scores_response_model_logistic_regression"](spark, SMALL_DIR)
    assert scores.count() > 0
