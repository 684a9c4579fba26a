"""Agreement of rankings and policies between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgeframe.plans.prefix import running
from nudgeframe.plans.rank_correlation import spearman
from nudgeframe.plans.skew import skew_join

ENTITY, SCORE = "client_id", "uplift"
# Fixed value: layout of policy-gain keys.
POLICY_KEY = r"^top_(\d+)pct_(.+)$"


def run_pairs(runs: DataFrame, group: str | None = None) -> DataFrame:
    """Comparisons (run_a, run_b) of each run with its group's reference run, the one of the
    smallest id: one fewer than there are runs. Without a group all runs share one reference.
    """
    keys = [] if group is None else [group]
    ids = runs.select(*keys, F.col("run_id").alias("run_b")).distinct()
    first = runs.groupBy(*keys).agg(F.min("run_id").alias("run_a"))
    paired = ids.join(first, keys) if keys else ids.withColumn("run_a", first.scalar())
    return paired.filter("run_a < run_b").select(*keys, "run_a", "run_b")


def shared_scores(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both scores of every entity two paired runs have in common."""
    value = F.col(SCORE).try_cast("double")
    usable = scores.select("run_id", ENTITY, value.alias(SCORE)).filter(value.isNotNull() & ~F.isnan(value))

    def side(run, name):
        return skew_join(usable.withColumnRenamed("run_id", run), pairs, [run], "inner", [ENTITY]).select(
            "run_a", "run_b", ENTITY, F.col(SCORE).alias(name)
        )

    return side("run_a", "left").join(side("run_b", "right"), ["run_a", "run_b", ENTITY])


def rank_correlation(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Spearman correlation per run pair over shared entities."""
    result = spearman(shared_scores(scores, pairs), ["run_a", "run_b"], "left", "right")
    return result.select(
        "run_a", "run_b", F.col("n").alias("shared_entities"), F.round("correlation", 6).alias("rank_correlation")
    )


def top_k_overlap(scores: DataFrame, pairs: DataFrame, k: float | int = 0.2) -> DataFrame:
    """Share of the best rows two runs have in common (exactly n per side)."""
    if isinstance(k, int) and k <= 0 or isinstance(k, float) and not 0 < k <= 1:
        raise ValueError("k must be a positive row count or a share in (0, 1]")
    shared = shared_scores(scores, pairs)
    keys = ["run_a", "run_b"]
    one = {"pos_left": F.lit(1).cast("long")}
    placed = running(shared, keys, [("left", True), (ENTITY, False)], one, totals=True)
    placed = placed.withColumnRenamed("total_pos_left", "n")
    placed = running(placed, keys, [("right", True), (ENTITY, False)], {"pos_right": F.lit(1).cast("long")})
    top = F.least(F.lit(k), F.col("n")) if isinstance(k, int) else F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(k)))
    both = (F.col("pos_left") <= top) & (F.col("pos_right") <= top)
    return placed.groupBy(*keys).agg(
        F.max(top).cast("long").alias("top_n"),
        F.round(F.count_if(both) / F.max(top).cast("double"), 6).alias("top_k_overlap"),
    )


def ranking_stability(
    scores: DataFrame,
    pairs: DataFrame,
    k: float | int = 0.2,
    min_correlation: float = 0.8,
    min_overlap: float = 0.7,
) -> DataFrame:
    """One row: weakest and mean agreement with the reference run, and the verdict."""
    agreement = pairs.join(rank_correlation(scores, pairs), ["run_a", "run_b"], "left").join(
        top_k_overlap(scores, pairs, k), ["run_a", "run_b"], "left"
    )
    c, o = F.col("rank_correlation"), F.col("top_k_overlap")
    missing = F.count_if(c.isNull()) + F.count_if(o.isNull())
    return agreement.agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.min(c).alias("min_rank_correlation"),
        F.round(F.avg(c), 6).alias("mean_rank_correlation"),
        F.min(o).alias("min_top_k_overlap"),
        F.round(F.avg(o), 6).alias("mean_top_k_overlap"),
        missing.alias("limitations"),
        F.coalesce((missing == 0) & (F.min(c) >= min_correlation) & (F.min(o) >= min_overlap), F.lit(False)).alias("stable"),
    )


def policy_cutoffs(gains: DataFrame, run_keys: list[str]) -> DataFrame:
    """Best cutoff per run and scenario from ``gain_rows``; the key listed first
    wins among equal gains."""
    cutoff = F.regexp_extract("key", POLICY_KEY, 1)
    usable = gains.filter(F.col("gain").isNotNull() & ~F.isnan("gain") & F.col("key").rlike(POLICY_KEY))
    parsed = usable.select(
        *run_keys,
        F.regexp_extract("key", POLICY_KEY, 2).alias("scenario"),
        F.struct("gain", (-F.col("position")).alias("first"), F.concat(F.lit("top_"), cutoff, F.lit("pct")).alias("cutoff")).alias("b"),
    )
    return parsed.groupBy(*run_keys, "scenario").agg(F.max("b").alias("b")).select(*run_keys, "scenario", "b.cutoff", "b.gain")


def gain_rows(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Policy-gain maps as (keys..., position, key, gain) rows in map order."""
    return trials.select(*keys, F.posexplode("policy_gain").alias("position", "key", "gain"))


def policy_stability(trials: DataFrame, group: str, min_gain: float = 0.0) -> DataFrame:
    """Per group and scenario: the cutoff every run agrees on, if any."""
    best = policy_cutoffs(gain_rows(trials, [group, "run_id"]), [group, "run_id"])
    runs = trials.groupBy(group).agg(F.count_distinct("run_id").alias("runs"))
    per = best.groupBy(group, "scenario").agg(
        F.count(F.lit(1)).alias("runs_with_scenario"),
        F.min("cutoff").alias("lowest"),
        F.max("cutoff").alias("highest"),
        F.round(F.min("gain"), 6).alias("min_gain"),
    )
    complete = F.col("runs_with_scenario") == F.col("runs")
    agreed = complete & (F.col("lowest") == F.col("highest")) & (F.col("min_gain") >= min_gain)
    return skew_join(per, runs, [group]).select(
        group,
        "scenario",
        "runs",
        "runs_with_scenario",
        "min_gain",
        F.when(agreed, F.col("lowest")).alias("stable_cutoff"),
        complete.alias("complete"),
        agreed.alias("stable"),
    )


def robustness(ranking: DataFrame, policy: DataFrame) -> DataFrame:
    """Ranking and policy verdicts combined into one row."""
    policies = policy.agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.count_if(~F.col("stable")).alias("unstable_scenarios"),
    ).select(F.struct("*").alias("p"))
    combined = ranking.withColumn("p", policies.scalar())
    calm = (F.col("p.scenarios") > 0) & (F.col("p.unstable_scenarios") == 0)
    return combined.select(
        "pair_count",
        F.col("p.scenarios").alias("scenarios"),
        F.col("p.unstable_scenarios").alias("unstable_scenarios"),
        F.col("stable").alias("ranking_stable"),
        calm.alias("policy_stable"),
        (F.col("stable") & calm).alias("stable"),
    )
