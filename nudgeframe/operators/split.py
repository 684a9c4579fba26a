"""Stratified train/validation/test splits and folds by seeded md5 order.

Strata hold a large share of the rows each (four at most), so positions inside a
stratum come from the bucketed running count rather than a window per stratum.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgeframe.config import Columns, SplitPolicy
from nudgeframe.functions import clean
from nudgeframe.plans.prefix import running

_STRATUM, _ORDER, _POSITION = "__stratum", "__order", "__position"
JOINT, TREATMENT_ONLY, RANDOM = "joint_treatment_outcome", "treatment_only", "random"


def stratum_counts(labelled: DataFrame, columns: Columns = Columns()) -> DataFrame:
    return labelled.groupBy(columns.treatment, columns.target).agg(F.count(F.lit(1)).alias("n"))


def stratification_decision(
    labelled: DataFrame, policy: SplitPolicy = SplitPolicy(), columns: Columns = Columns()
) -> DataFrame:
    """One row: the finest key whose present strata are all large enough."""
    joint = stratum_counts(labelled, columns)
    treatment = joint.groupBy(columns.treatment).agg(F.sum("n").alias("n"))
    smallest = joint.agg(F.min("n").alias("min_joint_stratum")).select(
        "min_joint_stratum", treatment.agg(F.min("n")).scalar().alias("min_treatment_stratum")
    )
    needed = F.lit(policy.min_stratum_rows)
    return smallest.select(
        "*",
        needed.alias("min_stratum_size"),
        F.when(F.col("min_joint_stratum") >= needed, JOINT)
        .when(F.col("min_treatment_stratum") >= needed, TREATMENT_ONLY)
        .otherwise(RANDOM)
        .alias("strategy"),
    )


def _key(strategy: str, columns: Columns):
    if strategy == JOINT:
        return clean.joint_key(F.col(columns.treatment), F.col(columns.target))
    if strategy == TREATMENT_ONLY:
        return F.col(columns.treatment).cast("string")
    return F.lit("all")


def _counts(labelled: DataFrame, strategy: str, columns: Columns) -> dict[str, int]:
    """Rows per stratum on the driver: at most four numbers."""
    rows = labelled.groupBy(_key(strategy, columns).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {row["k"]: row["n"] for row in sorted(rows, key=lambda row: row["k"])}


def quotas(counts: dict[str, int], wanted: int) -> dict[str, int]:
    """Share ``wanted`` rows over strata in proportion; the largest remainders,
    then the smaller key, take the rows that rounding down leaves over."""
    total = sum(counts.values())
    exact = {key: n / total * wanted for key, n in counts.items()}
    share = {key: int(value) for key, value in exact.items()}
    left = wanted - sum(share.values())
    for key in sorted(counts, key=lambda key: (share[key] - exact[key], key))[:left]:
        share[key] += 1
    return share


def _position(labelled: DataFrame, strategy: str, seed, columns: Columns) -> DataFrame:
    keyed = labelled.withColumns(
        {
            _STRATUM: _key(strategy, columns),
            _ORDER: clean.hash_order(F.col(columns.entity), seed),
        }
    )
    return running(keyed, [_STRATUM], [(_ORDER, False), (columns.entity, False)], {_POSITION: F.lit(1).cast("long")})


def _by_stratum(values: dict[str, int]):
    column = F.lit(None).cast("long")
    for key, value in values.items():
        column = F.when(F.col(_STRATUM) == key, F.lit(value).cast("long")).otherwise(column)
    return column


def stratified_split(
    labelled: DataFrame, policy: SplitPolicy = SplitPolicy(), columns: Columns = Columns()
) -> DataFrame:
    """Labelled rows with a ``split`` column (train, validation, test).

    Sizes follow the two-stage rule: the rest is ``ceil(n * rest_share)`` rows,
    and the test part ``ceil`` of its share of the rest.
    """
    strategy = stratification_decision(labelled, policy, columns).first()["strategy"]
    counts = _counts(labelled, strategy, columns)
    if any(n < 2 for n in counts.values()):
        strategy = RANDOM
        counts = {"all": sum(counts.values())}
    n = sum(counts.values())
    rest_share = policy.validation + policy.test
    if rest_share <= 0 or n == 0:
        return labelled.withColumn("split", F.lit("train"))
    train = quotas(counts, n - ceil(n * rest_share))
    rest = {key: counts[key] - train[key] for key in counts}
    n_rest = sum(rest.values())
    if policy.test <= 0:
        validation = rest
    elif policy.validation <= 0 or n_rest == 0:
        validation = {key: 0 for key in rest}
    else:
        validation = quotas(rest, n_rest - ceil(n_rest * (policy.test / rest_share)))
    first = _by_stratum(train)
    second = first + _by_stratum(validation)
    split = F.when(F.col(_POSITION) <= first, "train").when(F.col(_POSITION) <= second, "validation").otherwise("test")
    placed = _position(labelled, strategy, policy.seed, columns)
    return placed.select(*labelled.columns, split.alias("split"))


def fold_strategy(labelled: DataFrame, n_folds: int, columns: Columns = Columns()) -> str:
    """Joint strata when each can fill the folds, else treatment, else none."""
    for strategy in (JOINT, TREATMENT_ONLY):
        if min(_counts(labelled, strategy, columns).values(), default=0) >= n_folds:
            return strategy
    return RANDOM


def kfold(
    labelled: DataFrame, n_folds: int = 5, seed: int = 20260501, columns: Columns = Columns()
) -> DataFrame:
    """Labelled rows with a ``fold`` column 1..n, balanced inside each stratum."""
    if n_folds < 2:
        raise ValueError("at least two folds are needed")
    strategy = fold_strategy(labelled, n_folds, columns)
    placed = _position(labelled, strategy, seed, columns)
    fold = F.pmod(F.col(_POSITION) - 1, F.lit(n_folds)) + 1
    return placed.select(*labelled.columns, fold.cast("int").alias("fold"))


def partition_stats(split: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Sizes, rates and label cells of every partition, one pass."""
    t, y = F.col(columns.treatment), F.col(columns.target)
    cells = {(a, b): F.count_if((t == a) & (y == b)) for a in (0, 1) for b in (0, 1)}

    def rate(column):
        return F.round(F.avg(column), 6)

    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        rate(t).alias("treatment_rate"),
        rate(y).alias("target_rate"),
        rate(F.when(t == 1, y)).alias("treated_response_rate"),
        rate(F.when(t == 0, y)).alias("control_response_rate"),
        *[cell.alias(f"t{a}_y{b}") for (a, b), cell in cells.items()],
        F.least(*cells.values()).alias("min_joint_count"),
    )


def split_diagnostics(
    split: DataFrame, columns: Columns = Columns(), min_eval_rows: int = 100, max_rate_delta: float = 0.03
) -> DataFrame:
    """Partition statistics beside those of all rows, with the rules each breaks."""
    both = split.select(
        columns.treatment, columns.target, F.explode(F.array(F.col("split"), F.lit("all"))).alias("split")
    )
    stats = partition_stats(both, columns)
    overall = stats.filter("split = 'all'").select(
        F.struct("treatment_rate", "target_rate").alias("o")
    )
    evaluated = F.col("split").isin("validation", "test")
    joined = stats.withColumn("o", overall.scalar())
    few = evaluated & (F.col("n_rows") < min_eval_rows)
    drift = {
        name: evaluated & (F.abs(F.col(name) - F.col(f"o.{name}")) > max_rate_delta)
        for name in ("treatment_rate", "target_rate")
    }
    hole = evaluated & (F.col("min_joint_count") < 1)
    return joined.select(
        *stats.columns,
        few.alias("too_few_rows"),
        drift["treatment_rate"].alias("treatment_rate_drift"),
        drift["target_rate"].alias("target_rate_drift"),
        hole.alias("missing_cell"),
        (~(few | drift["treatment_rate"] | drift["target_rate"] | hole)).alias("reliable"),
    )
