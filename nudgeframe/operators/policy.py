"""Targeting policies, budgets and customer segments from scored rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nudgeframe.config import EvalPolicy
from nudgeframe.functions import clean
from nudgeframe.operators import metrics
from nudgeframe.operators.metrics import SCORE, TARGET, TREATMENT
from nudgeframe.operators.quality import melted
from nudgeframe.plans.prefix import exact_quantiles, running
from nudgeframe.plans.skew import skew_join

# Probability thresholds and names of the five-way segments.
P_HIGH, P_LOW = 0.40, 0.25
SEGMENTS = ("Persuadable", "Sleeping Dog", "Sure Thing", "Lost Cause", "Uncertain")


def _money(rate, n_targeted, coupon_cost, revenue):
    """Shared arithmetic of a targeting row; null rates stay null."""
    incremental = rate * n_targeted
    cost = n_targeted * F.lit(float(coupon_cost))
    lift = incremental * F.lit(float(revenue))
    roi = F.when(cost > 0, (lift - cost) / F.nullif(cost, F.lit(0.0)))
    return {
        "incremental_conversions": F.round(incremental, 2),
        "total_cost": F.round(cost, 2),
        "estimated_revenue_lift": F.round(lift, 2),
        "roi": F.round(roi, 3),
    }


def targeting_policies(
    scores: DataFrame,
    thresholds=(0.05, 0.10, 0.20, 0.30),
    coupon_cost: float = 1.0,
    revenue_per_conversion: float = 10.0,
    by=(),
) -> DataFrame:
    """Lift, cost and return of contacting the best share of customers."""
    rates = metrics.uplift_by_cutoff(scores, thresholds, by)
    n_targeted = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("cutoff")).cast("long"))
    money = _money(F.col("uplift_at_k"), n_targeted, coupon_cost, revenue_per_conversion)
    return rates.select(
        *by,
        F.col("cutoff_pct").alias("threshold_pct"),
        n_targeted.alias("n_targeted"),
        F.round("uplift_at_k", 4).alias("lift_rate"),
        *[column.alias(name) for name, column in money.items()],
    )


def budget_targeting(
    scores: DataFrame,
    budget: float,
    coupon_cost: float = 1.0,
    revenue_per_conversion: float = 10.0,
    by=(),
) -> DataFrame:
    """Best positive-uplift customers a budget can contact, one row per group."""
    affordable = (
        F.lit(int(budget / coupon_cost)).cast("long") if coupon_cost > 0 else F.max("n")
    )
    t, y = F.col(TREATMENT), F.col(TARGET)
    cap = F.lit(int(budget / coupon_cost)).cast("long") if coupon_cost > 0 else F.col("n")
    chosen = (F.col(SCORE) > 0) & (F.col("rank") <= cap)

    def count(condition):
        return F.count_if(chosen & condition)

    sums = metrics.ranked(scores, by).groupBy(*by).agg(
        F.max("n").alias("n"),
        affordable.alias("max_coupons_affordable"),
        F.count_if(chosen).alias("n_targeted"),
        count(t == 1).cast("double").alias("nt"),
        count(t == 0).cast("double").alias("nc"),
        count((t == 1) & (y == 1)).alias("yt"),
        count((t == 0) & (y == 1)).alias("yc"),
    )
    zero = F.lit(0.0)
    rate = F.round(F.col("yt") / F.nullif("nt", zero) - F.col("yc") / F.nullif("nc", zero), 6)
    money = _money(rate, F.col("n_targeted"), coupon_cost, revenue_per_conversion)
    return sums.select(
        *by,
        F.lit(float(budget)).alias("budget"),
        "max_coupons_affordable",
        "n_targeted",
        F.round(F.col("n_targeted") / F.col("n").cast("double"), 3).alias("pct_of_base"),
        *[column.alias(name) for name, column in money.items()],
    )


def elbow_threshold(policies: DataFrame, by=()) -> DataFrame:
    """Cutoff before the sharpest drop in return; null returns count as 0.

    ``policies`` is a targeting table: a handful of rows per group.
    """
    order = Window.partitionBy(*by).orderBy("threshold_pct")
    roi = F.coalesce("roi", F.lit(0.0))
    # The last cutoff has no successor; alone it still answers for its group.
    drop = roi - F.lead(roi).over(order)
    best = F.max_by("threshold_pct", F.struct(F.coalesce("drop", F.lit(float("-inf"))), -F.col("threshold_pct")))
    return policies.withColumn("drop", drop).groupBy(*by).agg(
        F.coalesce(best, F.lit(10)).alias("elbow_threshold_pct")
    )


def segment_summary(scores: DataFrame, threshold: float = 0.10, by=()) -> DataFrame:
    """Sizes of the high- and low-score groups by interpolated quantiles.

    The groups may overlap when scores tie (``middle_ground`` then falls below
    the disjoint count, which is reported beside it).
    """
    cuts = exact_quantiles(scores, list(by), SCORE, {"high": 1 - threshold, "low": threshold})
    if by:
        joined = skew_join(scores.select(*by, SCORE), cuts, list(by))
    else:
        both = cuts.select(F.struct("high", "low")).scalar()
        joined = scores.select(SCORE, both.alias("c")).select(SCORE, "c.high", "c.low")
    high, low = F.col(SCORE) >= F.col("high"), F.col(SCORE) <= F.col("low")
    counts = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(high).alias("persuadables"),
        F.count_if(low).alias("sleeping_dogs"),
        F.count_if(~high & ~low).alias("middle_disjoint"),
    )
    total = F.col("total_customers")

    def share(name):
        return clean.rounded(F.coalesce(F.col(name) / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0)), 3)

    return counts.select(
        *by,
        "total_customers",
        "persuadables",
        "sleeping_dogs",
        (total - F.col("persuadables") - F.col("sleeping_dogs")).alias("middle_ground"),
        "middle_disjoint",
        share("persuadables").alias("persuadable_pct"),
        share("sleeping_dogs").alias("sleeping_dog_pct"),
    )


def policy_summary(
    scores: DataFrame,
    coupon_cost: float = 1.0,
    revenue_per_conversion: float = 10.0,
    budget: float | None = None,
    by=(),
) -> dict[str, DataFrame]:
    """Every policy table of a ranking as lazy DataFrames."""
    targeting = targeting_policies(
        scores, coupon_cost=coupon_cost, revenue_per_conversion=revenue_per_conversion, by=by
    )
    tables = {
        "targeting_results": targeting,
        "elbow_threshold": elbow_threshold(targeting, by),
        "segment_summary": segment_summary(scores, by=by),
        "decile_table": metrics.decile_table(scores, by=by),
    }
    if budget is not None:
        tables["budget_result"] = budget_targeting(scores, budget, coupon_cost, revenue_per_conversion, by)
    return tables


def five_way_segments(scores: DataFrame, high: float = P_HIGH, low: float = P_LOW) -> DataFrame:
    """Named segment per customer from uplift and both response probabilities."""
    top_quarter = exact_quantiles(scores, [], SCORE, {"p75": 0.75})
    u, pt, pc = F.col(SCORE), F.col("p_treated"), F.col("p_control")
    segment = (
        F.when((u >= F.col("p75")) & (pt >= high) & (pc < high), SEGMENTS[0])
        .when((u < 0) & (pc >= high) & (pt < high), SEGMENTS[1])
        .when((pt >= high) & (pc >= high), SEGMENTS[2])
        .when((pt < low) & (pc < low), SEGMENTS[3])
        .otherwise(SEGMENTS[4])
    )
    return scores.withColumn("p75", top_quarter.scalar()).withColumn("segment", segment).drop("p75")


def segment_means(segmented: DataFrame) -> DataFrame:
    """Size, share and mean scores of each segment."""
    per = segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        *[
            (F.round(F.sum(name), 6) / F.count(name)).alias(f"avg_{name}")
            for name in (SCORE, "p_treated", "p_control")
        ],
    )
    total = segmented.agg(F.count(F.lit(1)))
    return per.select(
        "segment",
        "customers",
        *[F.round(name, 6).alias(name) for name in per.columns if name.startswith("avg_")],
        F.round(F.col("customers") * 100 / total.scalar(), 1).alias("pct"),
    )


def segment_profiles(segmented: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of every profile feature per segment."""
    joined = segmented.select("client_id", "segment").join(features.select("client_id", *columns), "client_id", "left")
    return joined.groupBy("segment").agg(
        *[F.round(F.round(F.sum(c), 6) / F.nullif(F.count(c).cast("double"), F.lit(0.0)), 2).alias(c) for c in columns]
    )


def recommended_cutoff(policies: DataFrame, by: tuple | list = ()) -> DataFrame:
    """A row per group: best positive return (then lift, then the smaller cutoff), else best lift."""
    usable = F.col("roi").isNotNull() & F.col("lift_rate").isNotNull() & (F.col("roi") > 0)
    profitable = F.coalesce(usable, F.lit(False))
    order = [
        profitable.desc(),
        F.when(profitable, F.col("roi")).desc_nulls_last(),
        F.col("lift_rate").desc_nulls_last(),
        F.col("threshold_pct").asc(),
    ]
    reason = F.when(profitable, "highest positive return").otherwise("highest lift, no positive return")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return policies.withColumn("__place", first).filter("__place = 1").drop("__place").withColumn("rationale", reason)


def gain_grid(scores: DataFrame, cutoffs, scenarios: dict[str, float]) -> DataFrame:
    """Gain of every cutoff under every cost scenario, in long form."""
    grid = metrics.policy_gain(scores, EvalPolicy(tuple(cutoffs), 1.0, dict(scenarios)))
    return grid.select(
        "cutoff_pct", "n_contacted", F.round("uplift_at_k", 5).alias("obs_uplift"), "scenario",
        F.round("gain", 2).alias("gain"),
    )


def gain_pivot(grid: DataFrame, scenarios: list[str]) -> DataFrame:
    return grid.groupBy("cutoff_pct", "n_contacted", "obs_uplift").pivot("scenario", scenarios).agg(F.max("gain"))


def best_gain(grid: DataFrame) -> DataFrame:
    """Gain-maximising cutoff of each scenario, the smaller one on ties."""
    known = grid.filter(F.col("gain").isNotNull())
    best = F.max_by(F.struct("cutoff_pct", "n_contacted", "gain"), F.struct("gain", -F.col("cutoff_pct")))
    return known.groupBy("scenario").agg(best.alias("b")).select("scenario", "b.*")


# Chebyshev coefficients of erfc, highest power first; the relative error is below 1.2e-7.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def two_sided_p(z: Column) -> Column:
    """Two-sided tail of the normal distribution beyond ``z``, in plain columns."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    series = reduce(lambda total, c: total * t + F.lit(c), ERFC[1:], F.lit(ERFC[0]))
    tail = t * F.exp(series - x * x)
    return F.when(tail > 1, F.lit(1.0)).otherwise(tail)  # least() would pass over a null


def segment_rank_test(segmented: DataFrame, features: DataFrame, columns: list[str], with_p: bool = True) -> DataFrame:
    """Persuadables against the rest: means, Mann-Whitney U and its p-value.

    Everything follows from one (feature, value) table of group sizes and tied
    ranks, so ranking costs two aggregates rather than a sort per feature.
    """
    joined = segmented.select("client_id", (F.col("segment") == SEGMENTS[0]).cast("long").alias("a")).join(
        features.select("client_id", *columns), "client_id", "left"
    )
    long = melted(joined, ["a"], columns).filter(F.col("value").isNotNull())
    cells = long.groupBy("feature", "value").agg(F.sum("a").alias("n_a"), F.count(F.lit(1)).alias("ties"))
    value, n_a, ties = F.col("value"), F.col("n_a"), F.col("ties")
    walk = running(cells, ["feature"], [("value", False)], {"upto": ties})
    per_value = walk.withColumn("avg_rank", F.col("upto") - ties + (ties + 1) / F.lit(2.0))
    stats = per_value.groupBy("feature").agg(
        F.sum(n_a).cast("double").alias("na"),
        F.sum(ties - n_a).cast("double").alias("nb"),
        F.sum(n_a * F.col("avg_rank")).alias("rank_sum"),
        F.round(F.sum(n_a * value), 6).alias("sum_a"),
        F.round(F.sum((ties - n_a) * value), 6).alias("sum_b"),
        F.sum(ties.cast("double") * ties * ties - ties).alias("tie_term"),
        F.count(F.lit(1)).alias("n_values"),
    ).filter((F.col("na") > 5) & (F.col("nb") > 5))
    na, nb = F.col("na"), F.col("nb")
    n = na + nb
    u = F.col("rank_sum") - na * (na + 1) / 2
    # One value has no variance; in doubles the tie term of many rows leaves a remainder of either sign.
    variance = F.when(F.col("n_values") > 1, na * nb / 12 * (n + 1 - F.col("tie_term") / (n * (n - 1))))
    # Continuity-corrected distance of the larger U from its mean.
    gap = F.greatest(u, na * nb - u) - na * nb / 2 - 0.5
    mean_a, mean_b = F.col("sum_a") / na, F.col("sum_b") / nb
    table = stats.select(
        "feature",
        F.round(mean_a, 3).alias("persuadable_mean"),
        F.round(mean_b, 3).alias("others_mean"),
        F.round(mean_a - mean_b, 3).alias("diff"),
        F.round(u, 1).alias("u_statistic"),
        F.round(gap / F.sqrt(F.nullif(variance, F.lit(0.0))), 6).alias("z"),
    )
    if not with_p:
        return table
    # greatest() would pass over a null: no variance, no p-value.
    p = F.when(F.col("z").isNotNull(), two_sided_p(F.greatest(F.col("z"), F.lit(0.0))))
    return table.withColumn("p_value", F.round(p, 5)).withColumn("significant", F.col("p_value") < 0.05)
