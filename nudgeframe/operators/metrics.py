"""Uplift curves and metrics over (entity, target, treatment_flg, uplift) rows.

``by`` adds partition keys (model, run, fold), so any number of rankings is
evaluated in the same jobs. Ties rank by entity id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgeframe.config import EvalPolicy
from nudgeframe.plans.prefix import running

ENTITY, TREATMENT, TARGET, SCORE = "client_id", "treatment_flg", "target", "uplift"


def _is_bad() -> Column:
    target, treatment, score = F.col(TARGET), F.col(TREATMENT), F.col(SCORE).cast("double")
    fine = target.isin(0, 1) & treatment.isin(0, 1) & score.isNotNull() & ~F.isnan(score)
    return (~F.coalesce(fine, F.lit(False))).cast("long")


def guarded(scores: DataFrame, by=()) -> DataFrame:
    """Pruned input with rows that break the contract marked as bad.

    The mark is summed with the other totals and fails the job in ``_checked``,
    after the ordering, where the optimiser cannot move it past a caller's filter.
    """
    return scores.select(
        *by,
        ENTITY,
        F.col(TREATMENT).cast("long").alias(TREATMENT),
        F.col(TARGET).cast("long").alias(TARGET),
        F.col(SCORE).cast("double").alias(SCORE),
        _is_bad().alias("bad"),
    )


def _checked(n: Column, bad: Column, treated: Column) -> Column:
    """The group's row count, or an error when its scores cannot be evaluated."""

    def fail(message):
        return F.raise_error(F.lit(message)).cast("long")

    return (
        F.when(bad > 0, fail("labels must be binary 0/1 and uplift must not be missing"))
        .when((treated == 0) | (treated == n), fail("uplift metrics require both treatment and control rows"))
        .otherwise(n)
    )


def score_problems(scores: DataFrame, by=()) -> DataFrame:
    """One row per group naming the first rule its scores break, if any."""
    treatment, target, score = F.col(TREATMENT), F.col(TARGET), F.col(SCORE).cast("double")
    counts = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.coalesce(target.isin(0, 1), F.lit(False))).alias("bad_target"),
        F.count_if(~F.coalesce(treatment.isin(0, 1), F.lit(False))).alias("bad_treatment"),
        F.count_if(treatment == 1).alias("treated"),
        F.count_if(treatment == 0).alias("control"),
        F.count_if(score.isNull() | F.isnan(score)).alias("bad_score"),
    )
    problem = (
        F.when(F.col("n_rows") == 0, "no rows")
        .when(F.col("bad_target") > 0, "target must be binary 0/1")
        .when(F.col("bad_treatment") > 0, "treatment must be binary 0/1")
        .when((F.col("treated") == 0) | (F.col("control") == 0), "both arms are required")
        .when(F.col("bad_score") > 0, "uplift contains missing values")
    )
    return counts.withColumn("problem", problem)


def ranked(scores: DataFrame, by=()) -> DataFrame:
    """Scores with rank and running arm counts, best first, plus group totals."""
    t, y = F.col(TREATMENT), F.col(TARGET)
    out = running(
        guarded(scores, by),
        list(by),
        [(SCORE, True), (ENTITY, False)],
        {"rank": F.lit(1).cast("long"), "cum_t": t, "cum_yt": t * y, "cum_yc": (1 - t) * y, "cum_bad": F.col("bad")},
        totals=True,
    )
    n = _checked(F.col("total_rank"), F.col("total_cum_bad"), F.col("total_cum_t"))
    return out.select(
        *by,
        ENTITY,
        TREATMENT,
        TARGET,
        SCORE,
        "rank",
        n.alias("n"),
        "cum_t",
        (F.col("rank") - F.col("cum_t")).alias("cum_c"),
        "cum_yt",
        "cum_yc",
    )


def _qini(cum_t, cum_c, cum_yt, cum_yc) -> Column:
    scale = F.coalesce(cum_t / F.nullif(cum_c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return cum_yt - scale * cum_yc


def _rate(successes: Column, rows: Column) -> Column:
    return successes / F.nullif(rows.cast("double"), F.lit(0.0))


_CUM = ("cum_t", "cum_c", "cum_yt", "cum_yc")


def _point_columns():
    t, c, yt, yc = (F.col(name) for name in _CUM)
    return {
        "fraction": F.col("rank") / F.col("n").cast("double"),
        "qini": _qini(t, c, yt, yc),
        "uplift_rate": F.coalesce(_rate(yt, t) - _rate(yc, c), F.lit(0.0)),
    }


def qini_curve(scores: DataFrame, by=()) -> DataFrame:
    points = _point_columns()
    return ranked(scores, by).select(*by, "rank", points["fraction"].alias("fraction"), points["qini"].alias("qini"))


def uplift_curve(scores: DataFrame, by=()) -> DataFrame:
    points = _point_columns()
    return ranked(scores, by).select(
        *by, "rank", points["fraction"].alias("fraction"), points["uplift_rate"].alias("uplift")
    )


def downsampled(curve: DataFrame, max_points: int = 800) -> DataFrame:
    """Every step-th point and the last one. A point's rank over its fraction is
    the group's row count, so no second pass over the curve is needed."""
    n = F.round(F.col("rank") / F.col("fraction")).cast("long")
    step = F.greatest(F.lit(1).cast("long"), F.floor(n / F.lit(max_points)))
    keep = ((F.col("rank") - 1) % step == 0) | (F.col("rank") == n)
    return curve.filter((n <= max_points) | keep)


def _area(value: Column) -> Column:
    """Trapezoid over fraction 1/n..1 in closed form."""
    n = F.max("n").cast("double")
    ends = F.sum(F.when(F.col("rank") == 1, value).otherwise(0.0)) + F.sum(
        F.when(F.col("rank") == F.col("n"), value).otherwise(0.0)
    )
    return (F.sum(value) - ends / 2) / n


def _curve_areas():
    points = _point_columns()
    return (
        F.round(_area(points["qini"]), 6).alias("qini_auc"),
        F.round(_area(points["uplift_rate"]), 6).alias("uplift_auc"),
    )


def qini_auc(scores: DataFrame, by=()) -> DataFrame:
    return ranked(scores, by).groupBy(*by).agg(_curve_areas()[0])


def uplift_auc(scores: DataFrame, by=()) -> DataFrame:
    return ranked(scores, by).groupBy(*by).agg(_curve_areas()[1])


def count_curve(scores: DataFrame, by=()) -> DataFrame:
    """Count-space Qini curve: one point per distinct score, ties collapsed
    before any ordering; carries the previous point for the trapezoids."""
    t, y = F.col(TREATMENT), F.col(TARGET)
    rows = guarded(scores, by)
    per_score = (
        rows.groupBy(*by, SCORE)
        .agg(
            F.count(F.lit(1)).alias("m"),
            F.sum(t).alias("m_t"),
            F.sum(t * y).alias("m_yt"),
            F.sum((1 - t) * y).alias("m_yc"),
            F.sum("bad").alias("m_bad"),
        )
    )
    walk = running(
        per_score,
        list(by),
        [(SCORE, True)],
        {"x": F.col("m"), "cum_t": F.col("m_t"), "cum_yt": F.col("m_yt"), "cum_yc": F.col("m_yc"), "bad": F.col("m_bad")},
        totals=True,
    )
    now = _qini(F.col("cum_t"), F.col("x") - F.col("cum_t"), F.col("cum_yt"), F.col("cum_yc"))
    t0 = F.col("cum_t") - F.col("m_t")
    x0 = F.col("x") - F.col("m")
    before = _qini(t0, x0 - t0, F.col("cum_yt") - F.col("m_yt"), F.col("cum_yc") - F.col("m_yc"))
    return walk.select(
        *by,
        SCORE,
        "x",
        now.alias("y"),
        x0.alias("x_before"),
        before.alias("y_before"),
        _checked(F.col("total_x"), F.col("total_bad"), F.col("total_cum_t")).alias("total_x"),
        "total_cum_t",
        "total_cum_yt",
        "total_cum_yc",
    )


def _count_areas(scores: DataFrame, by) -> DataFrame:
    return (
        count_curve(scores, by)
        .groupBy(*by)
        .agg(
            F.sum((F.col("y") + F.col("y_before")) / 2 * (F.col("x") - F.col("x_before"))).alias("area"),
            *[F.max(f"total_{name}").cast("double").alias(f"n_{name}") for name in ("x", "cum_t", "cum_yt", "cum_yc")],
        )
    )


def _oracle_terms():
    n, treated = F.col("n_x"), F.col("n_cum_t")
    control = n - treated
    gain = F.col("n_cum_yt") - treated * F.col("n_cum_yc") / F.nullif(control, F.lit(0.0))
    return n, gain


def _normalised(actual: Column, oracle: Column, baseline: Column) -> Column:
    gap = oracle - baseline
    return F.when(gap == 0, F.lit(0.0)).otherwise(
        F.round((actual - baseline) / F.nullif(gap, F.lit(0.0)), 6)
    )


def normalized_qini(scores: DataFrame, by=(), negative_effect: bool = False) -> DataFrame:
    """Area above the random line relative to the oracle's."""
    areas = _count_areas(scores, by)
    n, gain = _oracle_terms()
    if not negative_effect:
        oracle = gain * gain / 2 + gain * (n - gain)
        return areas.select(*by, _normalised(F.col("area"), oracle, n * gain / 2).alias("normalized_qini_auc"))
    t, y = F.col(TREATMENT), F.col(TARGET)
    best = _count_areas(scores.withColumn(SCORE, (y * t - y * (1 - t)).cast("double")), by).select(
        *by, F.col("area").alias("oracle")
    )
    joined = areas.join(best, list(by)) if by else areas.withColumn("oracle", best.scalar())
    return joined.select(
        *by, _normalised(F.col("area"), F.col("oracle"), n * gain / 2).alias("normalized_qini_auc")
    )


def _top_rates(cutoff: float):
    """Aggregates over the ceil(n*k) best rows, in double arithmetic."""
    top = F.greatest(F.lit(1.0), F.ceil(F.col("n") * F.lit(float(cutoff))).cast("double"))
    inside = F.col("rank") <= top
    t, y = F.col(TREATMENT), F.col(TARGET)

    def count(condition):
        return F.sum(F.when(inside & condition, 1).otherwise(0))

    treated, control = count(t == 1), count(t == 0)
    return F.round(
        _rate(count((t == 1) & (y == 1)), treated) - _rate(count((t == 0) & (y == 1)), control), 6
    )


def _percent(cutoff: float) -> int:
    return int(round(cutoff * 100))


def _unpivot(wide: DataFrame, by, cutoffs) -> DataFrame:
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(_percent(k)).alias("cutoff_pct"),
                    F.lit(float(k)).alias("cutoff"),
                    F.col(f"__k{i}").alias("uplift_at_k"),
                )
                for i, k in enumerate(cutoffs)
            ]
        )
    )
    return wide.select(*by, "n", rows.alias("r")).select(*by, "n", "r.cutoff_pct", "r.cutoff", "r.uplift_at_k")


def uplift_by_cutoff(scores: DataFrame, cutoffs, by=()) -> DataFrame:
    """Rates beside the cutoff share and the group's row count, long form."""
    if any(not 0 < k <= 1 for k in cutoffs):
        raise ValueError("cutoffs must lie in (0, 1]")
    wide = ranked(scores, by).groupBy(*by).agg(
        F.max("n").alias("n"), *[_top_rates(k).alias(f"__k{i}") for i, k in enumerate(cutoffs)]
    )
    return _unpivot(wide, by, cutoffs)


def uplift_at_k(scores: DataFrame, cutoffs=(0.05, 0.10, 0.20, 0.30), by=()) -> DataFrame:
    """Response-rate gap among the top rows; null when an arm is missing."""
    return uplift_by_cutoff(scores, cutoffs, by).select(*by, "cutoff_pct", "uplift_at_k")


def decile_table(scores: DataFrame, n_bins: int = 10, by=()) -> DataFrame:
    """Near-equal rank bins, larger bins first, at most one per row."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    n, rank = F.col("n"), F.col("rank")
    bins = F.least(F.lit(n_bins), n)
    small = F.floor(n / bins)
    large_rows = (n % bins) * (small + 1)
    bin_no = F.when(rank <= large_rows, F.floor((rank - 1) / (small + 1)) + 1).otherwise(
        n % bins + F.floor((rank - large_rows - 1) / small) + 1
    )
    t, y = F.col(TREATMENT), F.col(TARGET)
    table = (
        ranked(scores, by)
        .withColumn("bin", bin_no.cast("int"))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(t).alias("treated_n"),
            F.sum(1 - t).alias("control_n"),
            F.sum(t * y).alias("yt"),
            F.sum((1 - t) * y).alias("yc"),
            F.sum(SCORE).alias("total_score"),
        )
    )
    treated = F.coalesce(_rate(F.col("yt"), F.col("treated_n")), F.lit(0.0))
    control = F.coalesce(_rate(F.col("yc"), F.col("control_n")), F.lit(0.0))
    return table.select(
        *by,
        "bin",
        "n",
        "treated_n",
        "control_n",
        F.round(treated, 6).alias("treated_response_rate"),
        F.round(control, 6).alias("control_response_rate"),
        F.round(treated - control, 6).alias("uplift"),
        F.round(F.round(F.col("total_score"), 6) / F.col("n"), 6).alias("avg_predicted_uplift"),
    )


def _gain_rows(rates: DataFrame, policy: EvalPolicy, by) -> DataFrame:
    scenarios = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("scenario"), F.lit(float(cost)).alias("cost"))
                for name, cost in policy.cost_scenarios.items()
            ]
        )
    )
    contacted = F.ceil(F.col("n") * F.col("cutoff"))
    gain = F.col("uplift_at_k") * contacted * F.lit(float(policy.conversion_value)) - contacted * F.col("s.cost")
    return rates.withColumn("s", scenarios).select(
        *by,
        "cutoff_pct",
        F.col("s.scenario").alias("scenario"),
        F.concat(F.lit("top_"), F.col("cutoff_pct"), F.lit("pct_"), F.col("s.scenario")).alias("key"),
        contacted.cast("long").alias("n_contacted"),
        "uplift_at_k",
        F.round(gain, 6).alias("gain"),
    )


def policy_gain(scores: DataFrame, policy: EvalPolicy = EvalPolicy(), by=()) -> DataFrame:
    return _gain_rows(uplift_by_cutoff(scores, policy.cutoffs, by), policy, by)


def metric_bundle(scores: DataFrame, by=(), cutoffs=(0.05, 0.10, 0.20, 0.30)) -> DataFrame:
    """All scalar metrics, one row per group: two ordered passes in total."""
    areas = ranked(scores, by).groupBy(*by).agg(
        F.max("n").alias("n"),
        *_curve_areas(),
        *[_top_rates(k).alias(f"uplift_at_{_percent(k)}pct") for k in cutoffs],
    )
    normal = normalized_qini(scores, by)
    if by:
        return areas.join(normal, list(by))
    return areas.withColumn("normalized_qini_auc", normal.scalar())


def sound_scores(scores: DataFrame, by) -> DataFrame:
    """The rows of groups whose scores break no rule."""
    sound = score_problems(scores, by).filter("problem is null").select(*[F.col(c).alias(f"__ok_{c}") for c in by])
    same = reduce(lambda a, b: a & b, [scores[c].eqNullSafe(sound[f"__ok_{c}"]) for c in by])
    # One row per group, so nothing repeats. A semi join would be pushed into the branches of a union and,
    # where a branch names its group by a literal, lose its key.
    return scores.join(sound, same).select(*scores.columns)


def metric_bundle_with_problems(scores: DataFrame, by, cutoffs=(0.05, 0.10, 0.20, 0.30)) -> DataFrame:
    """``metric_bundle`` for groups that can be judged; the others have null metrics and their ``problem``."""
    judged = score_problems(scores, by).select(*by, "problem")
    return metric_bundle(sound_scores(scores, by), by, cutoffs).join(judged, list(by), "right")


def evaluate(scores: DataFrame, policy: EvalPolicy = EvalPolicy(), by=()) -> dict[str, DataFrame]:
    """Every metric, curve and table of a ranking as lazy DataFrames.

    Write or persist ``scores`` first when they come from a fitted model. Of groups that
    cannot be judged only the metrics speak, by their ``problem``; a single ranking fails.
    """
    metrics = metric_bundle_with_problems(scores, by, policy.cutoffs) if by else metric_bundle(scores, by, policy.cutoffs)
    scores = sound_scores(scores, by) if by else scores
    return {
        "metrics": metrics,
        "uplift_at_k": uplift_at_k(scores, policy.cutoffs, by),
        "policy_gain": policy_gain(scores, policy, by),
        "decile_table": decile_table(scores, by=by),
        "qini_curve": qini_curve(scores, by),
        "uplift_curve": uplift_curve(scores, by),
    }
