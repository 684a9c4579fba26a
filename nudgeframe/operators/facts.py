"""Purchase facts: cohort and temporal filters, collapsing, reference date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nudgeframe.functions import clean
from nudgeframe.plans.sizing import fits_broadcast, is_small, spread, tasks_for
from nudgeframe.plans.skew import NONE, HeavyKeys, find_heavy_keys, skew_join

KEY = "client_id"
TIME = "transaction_datetime"
ISSUE = "first_issue_date"
POINTS = (
    "regular_points_received",
    "express_points_received",
    "regular_points_spent",
    "express_points_spent",
)
TRANSACTION_KEY = (KEY, "transaction_id", TIME)


def cohort_ids(train: DataFrame, scoring: DataFrame, cohort: str = "train") -> DataFrame:
    """Ids of the train rows, the scoring rows, or both (duplicates kept)."""
    ids = {
        "train": lambda: train.select(clean.text_id(F.col(KEY)).alias(KEY)),
        "scoring": lambda: scoring.select(clean.text_id(F.col(KEY)).alias(KEY)),
    }
    if cohort == "all":
        return ids["train"]().unionByName(ids["scoring"]())
    if cohort not in ids:
        raise ValueError(f"unsupported cohort: {cohort}")
    return ids[cohort]()


def issue_dates(clients: DataFrame) -> DataFrame:
    """One issue date per client (the earliest should a client repeat)."""
    return clients.groupBy(clean.text_id(F.col(KEY)).alias(KEY)).agg(
        F.min(clean.timestamp_or_null(F.col(ISSUE))).alias(ISSUE)
    )


def first_listing(clients: DataFrame) -> DataFrame:
    """One row per client: the one of the earliest issue date should a client repeat."""
    order = Window.partitionBy(clean.text_id(F.col(KEY))).orderBy(
        clean.timestamp_or_null(F.col(ISSUE)).asc_nulls_last(), F.xxhash64(*clients.columns)
    )
    return clients.withColumn("__listing", F.row_number().over(order)).filter("__listing = 1").drop("__listing")


def cohort_lookup(cohort: DataFrame, clients: DataFrame) -> DataFrame:
    """Distinct cohort ids with their issue date: one lookup serves both the
    cohort filter and the temporal filter."""
    return cohort.select(KEY).distinct().join(issue_dates(clients), KEY, "left")


def purchase_lines(purchases: DataFrame) -> DataFrame:
    """Leniently typed line-level facts with only the columns features use."""
    numeric = [*POINTS, "purchase_sum", "product_quantity"]
    return purchases.select(
        clean.text_id(F.col(KEY)).alias(KEY),
        clean.text_id(F.col("transaction_id")).alias("transaction_id"),
        clean.timestamp_or_null(F.col(TIME)).alias(TIME),
        *[clean.number_or_zero(F.col(name)).alias(name) for name in numeric],
    )


def product_lines(purchases: DataFrame) -> DataFrame:
    return purchases.select(
        clean.text_id(F.col(KEY)).alias(KEY),
        clean.timestamp_or_null(F.col(TIME)).alias(TIME),
        clean.text_id(F.col("product_id")).alias("product_id"),
        clean.number_or_zero(F.col("product_quantity")).alias("product_quantity"),
    )


def temporal_condition(policy: str):
    """Row condition of a policy; clients without an issue date keep all rows."""
    before = F.col(TIME) < F.col(ISSUE)
    after = F.col(TIME) >= F.col(ISSUE)
    conditions = {
        "pre_issue_only": before,
        "post_issue_history": after,
        "safe_history_until_reference": after,
    }
    if policy not in conditions:
        raise ValueError(f"unsupported temporal policy: {policy}")
    return F.col(ISSUE).isNull() | conditions[policy]


def hot_clients(purchases: DataFrame, lookup: DataFrame) -> HeavyKeys:
    """Clients holding more lines than one task should; searched once per build
    in a sample of the key column, and only when a shuffled join lies ahead."""
    if is_small(purchases) or fits_broadcast(lookup):
        return NONE
    return find_heavy_keys(purchases.select(clean.text_id(F.col(KEY)).alias(KEY)), [KEY])


def within_policy(
    facts: DataFrame, lookup: DataFrame, policy: str, salt_by=None, hot: HeavyKeys | None = None
) -> DataFrame:
    """Cohort rows allowed by the temporal policy."""
    joined = skew_join(facts, lookup, [KEY], "inner", salt_by, hot, tasks=tasks_for(facts))
    return joined.filter(temporal_condition(policy)).drop(ISSUE)


def until(facts: DataFrame, reference: str | None) -> DataFrame:
    """Keep rows at or before the reference; bad dates go with it."""
    if reference is None:
        return facts
    return facts.filter(F.col(TIME) <= clean.timestamp_literal(reference))


def collapse(lines: DataFrame) -> DataFrame:
    """Purchase lines to transactions. Transaction attributes repeat on every
    line, hence max; quantities add up. Null keys form groups of their own.
    Much input is dealt first over tasks that grow with it."""
    return spread(lines, *TRANSACTION_KEY).groupBy(*TRANSACTION_KEY).agg(
        F.max("purchase_sum").alias("purchase_sum"),
        F.sum("product_quantity").alias("product_quantity"),
        *[F.max(name).alias(name) for name in POINTS],
    )


def reference_date(
    purchases: DataFrame, lookup: DataFrame, policy: str, hot: HeavyKeys | None = None
) -> str | None:
    """Latest allowed purchase time in the cohort (one value to the driver).

    Reads two columns of the facts; a pinned recipe date skips this pass.
    """
    hot = hot_clients(purchases, lookup) if hot is None else hot
    times = purchases.select(
        clean.text_id(F.col(KEY)).alias(KEY),
        clean.timestamp_or_null(F.col(TIME)).alias(TIME),
    )
    # Rows shrink before a shuffled join: to each key's maximum when the policy
    # looks forward (the filter keeps it), else to distinct times. A lookup that
    # Spark broadcasts filters inside the scan stage and needs neither.
    if fits_broadcast(lookup):
        pass
    elif policy != "pre_issue_only":
        times, hot = times.groupBy(KEY).agg(F.max(TIME).alias(TIME)), NONE
    else:
        times = times.distinct()
    latest = within_policy(times, lookup, policy, [TIME], hot).agg(F.max(TIME)).first()[0]
    return None if latest is None else latest.isoformat()


def transactions(
    purchases: DataFrame, lookup: DataFrame, policy: str, reference: str | None, hot: HeavyKeys | None = None
) -> DataFrame:
    """Collapsed transactions of the cohort under policy and reference date.

    The filters only touch grouping keys, so they commute with the collapse:
    with a broadcastable lookup they run first, inside the scan stage; otherwise
    the collapse runs first, so the shuffled join sees transactions, not lines.
    """
    lines = until(purchase_lines(purchases), reference)
    if fits_broadcast(lookup):
        return collapse(within_policy(lines, lookup, policy))
    hot = hot_clients(purchases, lookup) if hot is None else hot
    return within_policy(collapse(lines), lookup, policy, ["transaction_id", TIME], hot)
