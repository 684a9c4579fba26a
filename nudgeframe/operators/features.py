"""Customer-level feature blocks and the full feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgeframe.config import Columns, Recipe
from nudgeframe.functions import clean
from nudgeframe.operators import facts
from nudgeframe.operators.facts import ISSUE, KEY, TIME
from nudgeframe.plans.sizing import fits_broadcast, spread, tasks_for
from nudgeframe.plans.skew import skew_join

# Output columns of one purchase block, before the suffix.
PURCHASE_COLUMNS = (
    "purchase_txn_count",
    "purchase_sum",
    "avg_transaction_value",
    "basket_quantity",
    "avg_basket_quantity",
    "recency_days",
    "points_received_total",
    "points_spent_total",
    "points_received_to_purchase_ratio",
    "points_spent_to_purchase_ratio",
)
# Distinct-count columns of the product block.
PRODUCT_COUNTS = {
    "product": "product_unique_count_lifetime",
    "level_1": "product_level_1_unique_count_lifetime",
    "segment": "product_segment_unique_count_lifetime",
    "brand": "product_brand_unique_count_lifetime",
}


def client_features(
    cohort: DataFrame, clients: DataFrame, groups=("demographic",), reference: str | None = None
) -> DataFrame:
    """Demographic block plus the optional age, lifecycle and redeem blocks."""
    source = facts.first_listing(clients).select(
        clean.text_id(F.col(KEY)).alias(KEY),
        clean.number_or_null(F.col("age")).alias("age"),
        F.col("gender").cast("string").alias("gender"),
        clean.timestamp_or_null(F.col(ISSUE)).alias("issue"),
        clean.timestamp_or_null(F.col("first_redeem_date")).alias("redeem"),
    )
    joined = cohort.select(KEY).join(source, KEY, "left")
    age, issue, redeem = F.col("age"), F.col("issue"), F.col("redeem")

    blocks = {
        "age_clean": clean.age_clean(age),
        "age_invalid_flag": (~clean.age_valid(age)).cast("int"),
        "issue_date_missing_flag": issue.isNull().cast("int"),
        "issue_year": F.coalesce(F.year(issue), F.lit(-1)),
        "issue_month": F.coalesce(F.month(issue), F.lit(-1)),
        **clean.gender_flags(F.col("gender")),
    }
    if "age_buckets" in groups:
        blocks |= clean.age_band_flags(age)
    if "account_lifecycle" in groups:
        if reference is None:
            latest = joined.agg(F.max("issue")).first()[0]
            reference = None if latest is None else latest.isoformat()
        days = (
            F.lit(0.0)
            if reference is None
            else clean.whole_days_between(issue, clean.timestamp_literal(reference))
        )
        blocks["account_age_days"] = F.coalesce(F.greatest(days, F.lit(0.0)), F.lit(0.0))
        if reference is not None:
            blocks["account_age_days"] = F.when(issue.isNull(), 0.0).otherwise(blocks["account_age_days"])
    if "redeem_behavior" in groups:
        days = clean.whole_days_between(issue, redeem)
        blocks["has_redeemed"] = redeem.isNotNull().cast("int")
        blocks["days_to_first_redeem"] = F.when(days.isNull(), -1.0).otherwise(F.greatest(days, F.lit(0.0)))
    return joined.select(KEY, *[column.alias(name) for name, column in blocks.items()])


def _gates(windows, reference):
    """(suffix, start of the window or None for lifetime)."""
    gates = [("lifetime", None)]
    for days in windows:
        start = None
        if reference is not None:
            start = clean.timestamp_literal(reference) - F.expr(f"interval {int(days)} days")
        gates.append((f"{int(days)}d", start))
    return gates


def purchase_aggregates(
    transactions: DataFrame, windows=(), reference: str | None = None
) -> DataFrame:
    """All look-back windows in one pass over the transactions.

    Transactions first meet per (client, transaction) for the exact distinct
    count; windows nest, so one latest time per transaction answers every
    window's count and one per client every window's recency.
    """
    gates = _gates(windows, reference)
    measures = {
        "sum": F.col("purchase_sum"),
        "qty": F.col("product_quantity"),
        "got": F.col("regular_points_received") + F.col("express_points_received"),
        "spent": F.col("regular_points_spent") + F.col("express_points_spent"),
    }

    def gated(column, suffix, start, time=F.col(TIME)):
        if suffix == "lifetime":
            return column
        if start is None:
            return F.lit(0.0)
        return F.when(time >= start, column).otherwise(F.lit(0.0))

    per_transaction = spread(transactions, KEY, "transaction_id").groupBy(KEY, "transaction_id").agg(
        F.max(TIME).alias("last"),
        *[
            F.sum(gated(column, suffix, start)).alias(f"{name}_{suffix}")
            for suffix, start in gates
            for name, column in measures.items()
        ],
    )
    one = F.col("transaction_id").isNotNull().cast("double")
    per_client = per_transaction.groupBy(KEY).agg(
        F.max("last").alias("last"),
        *[
            F.sum(gated(one, suffix, start, F.col("last"))).cast("long").alias(f"n_{suffix}")
            for suffix, start in gates
        ],
        *[
            F.sum(f"{name}_{suffix}").alias(f"{name}_{suffix}")
            for suffix, _ in gates
            for name in measures
        ],
    )
    columns = []
    for suffix, start in gates:
        # Rounding sums first makes the ratios independent of summation order.
        count = F.col(f"n_{suffix}")
        total, quantity, got, spent = (F.round(f"{name}_{suffix}", 6) for name in measures)
        recency = F.lit(None).cast("double")
        if reference is not None:
            recency = clean.days_between(F.col("last"), clean.timestamp_literal(reference))
            if start is not None:
                recency = F.when(F.col("last") >= start, recency)
        values = (
            count,
            total,
            clean.ratio_or_zero(total, count.cast("double"), 6),
            quantity,
            clean.ratio_or_zero(quantity, count.cast("double"), 6),
            F.round(F.coalesce(recency, F.lit(-1.0)), 3),
            got,
            spent,
            clean.ratio_or_zero(got, total, 6),
            clean.ratio_or_zero(spent, total, 6),
        )
        columns += [value.alias(f"{name}_{suffix}") for name, value in zip(PURCHASE_COLUMNS, values)]
    return per_client.select(KEY, *columns)


def _fill(joined: DataFrame, block: DataFrame) -> DataFrame:
    """Defaults for clients without facts: recency -1, everything else 0."""
    fills = {name: -1.0 if name.startswith("recency_days") else 0 for name in block.columns if name != KEY}
    return joined.fillna(fills)


def purchase_features(cohort: DataFrame, transactions: DataFrame, windows=(), reference=None) -> DataFrame:
    block = purchase_aggregates(transactions, windows, reference)
    return _fill(cohort.select(KEY).join(block, KEY, "left"), block)


def product_aggregates(
    lines: DataFrame, products: DataFrame, diversity: bool = False, probe: DataFrame | None = None
) -> DataFrame:
    """Product breadth, quantity shares and (optionally) entropies per client.

    Lines shrink to (client, product) before meeting the product table. Then one
    long (client, kind, value) aggregate answers the four distinct counts and
    both entropies, using -sum(p ln p) = (ln T * sum(q) - sum(q ln q)) / T.
    """
    catalogue = products.select(
        clean.text_id(F.col("product_id")).alias("product_id"),
        F.col("level_1").cast("string").alias("level_1"),
        F.col("segment_id").cast("string").alias("segment"),
        F.col("brand_id").cast("string").alias("brand"),
        clean.number_or_zero(F.col("is_own_trademark")).alias("own"),
        clean.number_or_zero(F.col("is_alcohol")).alias("alcohol"),
    )
    # Lines of a client and product rarely repeat: they are dealt before they merge, and each
    # later step keeps its number of tasks, so none holds more as the tables grow.
    tasks = tasks_for(lines)
    dealt = spread(lines.select(KEY, "product_id", "product_quantity"), KEY, "product_id", tasks=tasks)
    per_product = dealt.groupBy(KEY, "product_id").agg(F.sum("product_quantity").alias("q"))
    joined = skew_join(per_product, catalogue, ["product_id"], "left", [KEY], probe=probe, tasks=tasks)
    kinds = {"product": F.col("product_id"), **{k: F.col(k) for k in ("level_1", "segment", "brand")}}
    exploded = joined.select(
        KEY,
        "q",
        (F.col("q") * F.coalesce("own", F.lit(0.0))).alias("own_q"),
        (F.col("q") * F.coalesce("alcohol", F.lit(0.0))).alias("alcohol_q"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
        ).alias("item"),
    ).select(KEY, "q", "own_q", "alcohol_q", "item.*")
    per_value = spread(exploded, KEY, "kind", "value", tasks=tasks).groupBy(KEY, "kind", "value").agg(
        F.sum("q").alias("q"), F.sum("own_q").alias("own_q"), F.sum("alcohol_q").alias("alcohol_q")
    )
    is_product = F.col("kind") == "product"
    positive = F.when(F.col("q") > 0, F.col("q"))
    sums = per_value.groupBy(KEY).agg(
        *[
            F.count(F.when((F.col("kind") == kind) & F.col("value").isNotNull(), 1)).alias(name)
            for kind, name in PRODUCT_COUNTS.items()
        ],
        F.sum(F.when(is_product, F.col("q")).otherwise(0.0)).alias("total"),
        F.sum(F.when(is_product, F.col("own_q")).otherwise(0.0)).alias("own_total"),
        F.sum(F.when(is_product, F.col("alcohol_q")).otherwise(0.0)).alias("alcohol_total"),
        *[
            column.alias(name)
            for kind in ("level_1", "brand")
            for name, column in (
                (f"pos_{kind}", F.sum(F.when(F.col("kind") == kind, positive).otherwise(0.0))),
                (f"log_{kind}", F.sum(F.when(F.col("kind") == kind, positive * F.ln(positive)).otherwise(0.0))),
            )
        ],
    )

    def entropy(kind):
        total = F.when(F.col("total") > 0, F.col("total"))
        value = (F.ln(total) * F.col(f"pos_{kind}") - F.col(f"log_{kind}")) / total
        return F.round(F.coalesce(value, F.lit(0.0)), 6) + F.lit(0.0)

    return sums.select(
        KEY,
        *PRODUCT_COUNTS.values(),
        F.col("total").alias("product_purchase_quantity_lifetime"),
        clean.ratio_or_zero(F.col("own_total"), F.col("total"), 6).alias("own_trademark_quantity_share_lifetime"),
        clean.ratio_or_zero(F.col("alcohol_total"), F.col("total"), 6).alias("alcohol_quantity_share_lifetime"),
        *(
            [
                entropy("level_1").alias("product_level_1_entropy_lifetime"),
                entropy("brand").alias("product_brand_entropy_lifetime"),
            ]
            if diversity
            else []
        ),
    )


def _product_block(purchases, products, lookup, policy, reference, diversity, hot) -> DataFrame:
    raw = facts.product_lines(purchases)
    lines = facts.within_policy(facts.until(raw, reference), lookup, policy, ["product_id", TIME], hot)
    return product_aggregates(lines, products, diversity, probe=raw.select("product_id"))


def product_features(
    cohort: DataFrame,
    purchases: DataFrame,
    products: DataFrame,
    lookup: DataFrame,
    policy: str,
    reference: str | None,
    diversity: bool = False,
) -> DataFrame:
    hot = facts.hot_clients(purchases, lookup)
    if reference is None:
        reference = facts.reference_date(purchases, lookup, policy, hot)
    block = _product_block(purchases, products, lookup, policy, reference, diversity, hot)
    return _fill(cohort.select(KEY).join(block, KEY, "left"), block)


def feature_table(
    recipe: Recipe,
    cohort: DataFrame,
    clients: DataFrame,
    purchases: DataFrame,
    products: DataFrame | None = None,
    collapsed: DataFrame | None = None,
    reference: str | None = None,
) -> DataFrame:
    """One row per cohort id with every block the recipe names.

    ``collapsed`` lets several recipes share one scan of the facts: it must hold
    the cohort's collapsed transactions (see ``shared_transactions``).
    ``reference`` passes on an already computed reference date.
    """
    table = client_features(cohort, clients, recipe.feature_groups, recipe.reference_date)
    if not (recipe.wants_purchases or recipe.wants_products):
        return table
    lookup = facts.cohort_lookup(cohort, clients)
    source = purchases if collapsed is None else collapsed
    hot = facts.hot_clients(source, lookup)
    reference = (
        recipe.reference_date or reference or facts.reference_date(source, lookup, recipe.temporal_policy, hot)
    )
    if recipe.wants_purchases:
        if collapsed is None:
            history = facts.transactions(purchases, lookup, recipe.temporal_policy, reference, hot)
        else:
            history = facts.within_policy(
                facts.until(collapsed, reference), lookup, recipe.temporal_policy, ["transaction_id", TIME], hot
            )
        block = purchase_aggregates(history, recipe.windows_days, reference)
        table = _fill(table.join(block, KEY, "left"), block)
    if recipe.wants_products:
        if products is None:
            raise ValueError("product feature groups need a products table")
        diversity = "diversity" in recipe.feature_groups
        block = _product_block(purchases, products, lookup, recipe.temporal_policy, reference, diversity, hot)
        table = _fill(table.join(block, KEY, "left"), block)
    return table


def shared_transactions(cohort: DataFrame, purchases: DataFrame) -> DataFrame:
    """Collapsed transactions of a cohort before any temporal filter: persist or
    write this once and derive every recipe from it."""
    ids = cohort.select(KEY).distinct()
    lines = facts.purchase_lines(purchases)
    if fits_broadcast(ids):
        return facts.collapse(lines.join(ids, KEY, "left_semi"))
    # The cohort test is on a grouping key: meet it with transactions, not lines.
    hot = facts.hot_clients(purchases, ids)
    return skew_join(facts.collapse(lines), ids, [KEY], "left_semi", ["transaction_id", TIME], hot)


def labelled_features(features: DataFrame, labels: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Feature rows that carry both labels."""
    return features.join(labels.select(columns.entity, columns.treatment, columns.target), columns.entity)


def feature_columns(df: DataFrame, columns: Columns = Columns(), extra=()) -> list[str]:
    """Everything except the id, the labels and the score."""
    excluded = {columns.entity, columns.treatment, columns.target, columns.score, *extra}
    return [name for name in df.columns if name not in excluded]
