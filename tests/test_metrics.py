"""Metrics against direct formulas, and the contract's edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nudgeframe.config import EvalPolicy
from nudgeframe.operators import metrics

# Twelve customers; the best three are all treated.
Y = [0, 1, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0]
T = [1, 1, 1, 0, 1, 0, 0, 0, 1, 0, 1, 0]
U = [1.2, 1.1, 1.0, 0.8, 0.6, 0.5, 0.4, 0.2, 0.0, -0.4, -0.6, -0.9]
SCHEMA = "client_id string, target int, treatment_flg int, uplift double"


def frame(spark, y=Y, t=T, u=U):
    rows = [(f"c{i:05d}", int(a), int(b), None if c is None else float(c)) for i, (a, b, c) in enumerate(zip(y, t, u))]
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    return df.first()[0]


def area(y, x):
    return float(np.sum((y[1:] + y[:-1]) / 2 * np.diff(x)))


def brute(y, t, u):
    """Raw Qini, uplift area and normalised Qini by direct loops."""
    order = sorted(range(len(u)), key=lambda i: (-u[i], i))
    nt = nc = yt = yc = 0
    qini, rate, steps = [], [], {}
    for n, i in enumerate(order, start=1):
        nt, nc = nt + t[i], nc + 1 - t[i]
        yt, yc = yt + t[i] * y[i], yc + (1 - t[i]) * y[i]
        qini.append(yt - (nt / nc * yc if nc else 0.0))
        rate.append(yt / nt - yc / nc if nt and nc else 0.0)
        steps[u[i]] = (n, qini[-1])
    n = len(u)
    x = np.arange(1, n + 1) / n
    xs = np.array([0.0] + [steps[s][0] for s in sorted(steps, reverse=True)])
    ys = np.array([0.0] + [steps[s][1] for s in sorted(steps, reverse=True)])
    gain = yt - nt * yc / nc
    base = n * gain / 2
    gap = gain * gain / 2 + gain * (n - gain) - base
    return area(np.array(qini), x), area(np.array(rate), x), (area(ys, xs) - base) / gap if gap else 0.0


@pytest.mark.parametrize("digits, split", [(1, False), (6, False), (1, True), (6, True)])
def test_areas_match_direct_formula(spark, request, digits, split):
    if split:
        request.getfixturevalue("split_small_inputs")
    rng = np.random.default_rng(3)
    n = 400
    t = rng.integers(0, 2, n)
    u = np.round(rng.normal(size=n), digits)
    y = (rng.random(n) < 0.3 + 0.2 * t * (u > 0)).astype(int)
    row = metrics.metric_bundle(frame(spark, y, t, u)).first()
    raw, rate, normal = brute(y.tolist(), t.tolist(), u.tolist())
    assert row["qini_auc"] == pytest.approx(raw, abs=2e-6)
    assert row["uplift_auc"] == pytest.approx(rate, abs=2e-6)
    assert row["normalized_qini_auc"] == pytest.approx(normal, abs=2e-6)
    assert row["n"] == n


def test_one_tied_score_for_most_rows_still_splits(spark, split_small_inputs):
    n = 600
    rng = np.random.default_rng(5)
    t, y = rng.integers(0, 2, n), rng.integers(0, 2, n)
    u = np.where(np.arange(n) % 3 == 0, rng.random(n), 0.5)
    df = frame(spark, y, t, u)
    from nudgeframe.plans.prefix import _bucketed

    placed = _bucketed(metrics.guarded(df), [], [("uplift", True), ("client_id", False)])
    assert placed.filter("uplift = 0.5").select("__bucket").distinct().count() > 3  # the tie itself is cut
    assert metrics.qini_auc(df).first()[0] == pytest.approx(brute(y.tolist(), t.tolist(), u.tolist())[0], abs=2e-6)


def test_better_ranking_beats_reversed(spark):
    good = metrics.metric_bundle(frame(spark)).first()
    bad = metrics.metric_bundle(frame(spark, u=[-v for v in U])).first()
    for name in ("qini_auc", "uplift_auc", "normalized_qini_auc"):
        assert good[name] > bad[name]
    assert -1 <= good["normalized_qini_auc"] <= 1
    assert abs(good["qini_auc"]) > 1


def test_one_armed_top_slice_is_undefined(spark):
    rates = {r["cutoff_pct"]: r["uplift_at_k"] for r in metrics.uplift_at_k(frame(spark), (0.25, 1.0)).collect()}
    assert rates[25] is None and rates[100] is not None
    gains = metrics.policy_gain(frame(spark), EvalPolicy(cutoffs=(0.25,))).collect()
    assert len(gains) == 3 and all(row["gain"] is None for row in gains)
    assert {row["key"] for row in gains} == {f"top_25pct_{s}" for s in ("zero_cost", "low_cost", "medium_cost")}


def test_cutoff_count_uses_double_arithmetic(spark):
    n = 100
    df = frame(spark, [i % 2 for i in range(n)], [(i // 2) % 2 for i in range(n)], [float(-i) for i in range(n)])
    row = metrics.policy_gain(df, EvalPolicy(cutoffs=(0.07,))).first()
    assert row["n_contacted"] == 8


@pytest.mark.parametrize(
    "y, t, u",
    [
        ([0, 2], [0, 1], [0.1, 0.2]),
        ([0, 1], [1, 1], [0.1, 0.2]),
        ([0, 1], [0, 0], [0.1, 0.2]),
        ([0, 1], [0, 1], [0.1, None]),
        ([0, 1], [0, 1], [0.1, float("nan")]),
    ],
)
def test_bad_scores_fail(spark, y, t, u):
    df = frame(spark, y, t, u)
    with pytest.raises(Exception, match="uplift metrics require|must be binary"):
        metrics.qini_auc(df).collect()
    with pytest.raises(Exception, match="uplift metrics require|must be binary"):
        metrics.normalized_qini(df).collect()
    assert metrics.score_problems(df).first()["problem"] is not None


def test_filtered_out_bad_rows_do_not_fail(spark):
    df = frame(spark, Y + [1], T + [1], U + [None]).filter(F.col("uplift").isNotNull())
    assert one(metrics.qini_auc(df)) == one(metrics.qini_auc(frame(spark)))


def test_invalid_arguments(spark):
    with pytest.raises(ValueError):
        metrics.uplift_at_k(frame(spark), (0.0,))
    with pytest.raises(ValueError):
        metrics.decile_table(frame(spark), 0)
    with pytest.raises(ValueError):
        EvalPolicy(cutoffs=())


def test_more_bins_than_rows(spark):
    assert metrics.decile_table(frame(spark), 20).count() == len(Y)
    sizes = [r["n"] for r in metrics.decile_table(frame(spark), 5).orderBy("bin").collect()]
    assert sizes == [3, 3, 2, 2, 2]


def test_perfect_tie_gives_zero_normalised_area(spark):
    assert one(metrics.normalized_qini(frame(spark, u=[0.5] * 8))) == pytest.approx(0.0, abs=1e-9)


def test_downsample_keeps_last_point(spark):
    n = 50
    df = frame(spark, [i % 2 for i in range(n)], [(i // 2) % 2 for i in range(n)], [float(-i) for i in range(n)])
    ranks = sorted(r["rank"] for r in metrics.downsampled(metrics.qini_curve(df), 12).collect())
    assert ranks == [1, 5, 9, 13, 17, 21, 25, 29, 33, 37, 41, 45, 49, 50]
