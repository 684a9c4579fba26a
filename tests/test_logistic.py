"""Exact medians and batched logistic fits against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nudgeframe.operators import crossval, learners, logistic
from nudgeframe.operators.learners import TrialSpec
from nudgeframe.plans import selection
from nudgeframe.session import cut_lineage


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    n = 900
    x = np.column_stack([rng.normal(50, 9, n), rng.integers(0, 4, n), rng.exponential(1e5, n), -rng.integers(0, 2, n) * 1e-300, np.full(n, 7.0)])
    x[rng.random(x.shape) < 0.1] = np.nan
    arm, fold = rng.integers(0, 2, n), rng.integers(1, 4, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(np.nan_to_num(x[:, 0], nan=50) - 50) / 9 * (arm + 0.3)))).astype(float)
    return x, arm, fold, y


COLUMNS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark, table):
    x, arm, fold, y = table
    data = [(int(t), int(f), float(v), float(v == t), *[None if np.isnan(k) else float(k) for k in r]) for r, t, f, v in zip(x, arm, fold, y)]
    schema = "arm int, fold int, target double, transformed double, " + ", ".join(f"{c} double" for c in COLUMNS)
    return cut_lineage(spark.createDataFrame(data, schema).repartition(5))


def test_medians_of_groups_of_cells(rows, table):
    x, arm, fold, _ = table
    cells = rows.withColumn("cell", F.col("arm") * 4 + F.col("fold"))
    groups = {"all": list(range(8)), "treated but fold 2": [5, 7], "one": [1]}
    mine = {g: np.isin(arm * 4 + fold, c) for g, c in groups.items()}
    known = {(g, c): int((~np.isnan(x[m][:, i])).sum()) for g, m in mine.items() for i, c in enumerate(COLUMNS)}
    got = selection.medians(cells, COLUMNS, groups, known)
    for g, m in mine.items():
        assert [got[g, c] for c in COLUMNS] == np.nanmedian(x[m], axis=0).tolist()
    empty = selection.medians(cells.limit(0), COLUMNS, {"all": [0]}, {("all", c): 0 for c in COLUMNS})
    assert set(empty.values()) == {None}


def test_order_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-320, 0.0, 1e-320, 3.0, 1e300, np.inf])
    keys = selection.order_keys(x)
    assert (np.diff(keys.astype(object)) > 0).all() and [selection.value_of(int(k)) for k in keys] == x.tolist()
    assert selection.order_keys(np.array([-0.0])) == selection.order_keys(np.array([0.0]))


def plain_fit(x, y, C):
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    deviation = x.std(axis=0, ddof=1)
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0)
    z = np.column_stack([(x - x.mean(axis=0)) * scale, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1 / C), 0)
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (p - y) + ridge * beta)
    return beta


def test_batched_fits_equal_single_fits(rows, table, monkeypatch):
    x, arm, fold, y = table
    jobs, masks = [], []
    for out in (0, 1, 2, 3):
        for arms in ((0, 1), (1,), (0,)):
            for C in (1.0, 0.01):
                jobs.append(logistic.Job("target", frozenset((t, f) for t in arms for f in (1, 2, 3) if f != out), C=C))
                masks.append(np.isin(arm, arms) & (fold != out))
    passes = []
    real = logistic._pass
    monkeypatch.setattr(logistic, "_pass", lambda *a: passes.append(1) or real(*a))
    models = logistic.fit_jobs(rows, COLUMNS, jobs)
    # All 24 models take as many passes as the slowest of them.
    assert len(passes) == max(m.passes for m in models) < 15
    for job, mask, model in zip(jobs, masks, models):
        want = plain_fit(x[mask], y[mask], job.C)
        assert np.abs(np.array(model.scaled) - want[:-1]).max() < 1e-6
        middle = np.where(np.isnan(x[mask]), model.medians, x[mask])
        margin = model.intercept + middle @ np.array(model.weights)
        p = 1 / (1 + np.exp(-margin))
        # Score equation of the free intercept: mean probability is the mean label.
        assert abs(p.mean() - y[mask].mean()) < 1e-9
    single = logistic.fit_jobs(rows, COLUMNS, [jobs[3]])[0]
    assert np.abs(np.array(single.scaled) - np.array(models[3].scaled)).max() < 1e-6


def test_arm_as_input_and_one_class(rows, table):
    x, arm, _, y = table
    cells = frozenset((t, f) for t in (0, 1) for f in (1, 2, 3))
    solo, other = logistic.fit_jobs(rows, COLUMNS, [logistic.Job("target", cells, True), logistic.Job("transformed", cells)])
    want = plain_fit(np.column_stack([x, arm]), y, 1.0)
    assert solo.inputs[-1] == logistic.ARM and np.abs(np.array(solo.scaled) - want[:-1]).max() < 1e-6
    assert np.abs(np.array(other.scaled) - plain_fit(x, (y == arm).astype(float), 1.0)[:-1]).max() < 1e-6
    one = logistic.fit_jobs(rows.withColumn("target", F.lit(1.0)), COLUMNS, [logistic.Job("target", cells)])[0]
    assert one.constant == 1.0


def test_fold_scores_equal_models_fitted_one_by_one(spark, rows):
    labelled = rows.select(F.monotonically_increasing_id().cast("string").alias("client_id"), F.col("arm").alias("treatment_flg"), F.col("target").cast("int").alias("target"), *COLUMNS)
    labelled = cut_lineage(labelled)
    specs = [TrialSpec(f, f) for f in ("two_model", "solo_model", "class_transformation", "response_model", "random")]
    got = {(r["run_id"], r["client_id"]): r["uplift"] for r in crossval.fold_scores(labelled, specs, 3).collect()}
    folds = crossval.kfold(labelled, 3, 20260501)
    assert len(got) == 5 * 900
    for spec in specs:
        for fold in (1, 3):
            model = learners.fit_uplift(folds.filter(F.col("fold") != fold), spec.family, spec.estimator, seed=20260501)
            for r in learners.scored(model, folds.filter(F.col("fold") == fold)).collect():
                assert abs(got[spec.run_id, r["client_id"]] - r["uplift"]) < 1e-6
