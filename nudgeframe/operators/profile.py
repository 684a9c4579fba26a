"""Profiling tables: segment response, purchase and feature summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgeframe.config import Columns
from nudgeframe.functions import clean
from nudgeframe.operators.quality import melted
from nudgeframe.plans.distinct import distinct_counts
from nudgeframe.plans.prefix import exact_quantiles
from nudgeframe.session import cut_lineage

# Printed names of the right-closed age bands.
AGE_BAND_LABELS = (
    "(-0.001, 25.0]",
    "(25.0, 35.0]",
    "(35.0, 45.0]",
    "(45.0, 55.0]",
    "(55.0, 65.0]",
    "(65.0, 200.0]",
)


def age_band(age: Column) -> Column:
    return clean.right_closed_bin(age, clean.AGE_EDGES, AGE_BAND_LABELS, include_lowest=True)


def segment_response(
    train: DataFrame, clients: DataFrame, columns: Columns = Columns(), top_n: int = 10, min_rows: int = 2
) -> DataFrame:
    """Arm response by gender and by age band, widest gaps first.

    Groups below ``min_rows`` or without both arms are left out.
    """
    source = clients.select(
        clean.text_id(F.col(columns.entity)).alias(columns.entity),
        F.col("gender").alias("gender"),
        age_band(clean.number_or_null(F.col("age"))).alias("age_band"),
    )
    long = train.join(source, columns.entity, "left").select(
        columns.treatment,
        columns.target,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("segment_col"), F.coalesce(name, F.lit("nan")).alias("segment"))
                    for name in ("gender", "age_band")
                ]
            )
        ).alias("s"),
    )
    treatment, target = F.col(columns.treatment), F.col(columns.target)
    groups = long.groupBy("s.segment_col", "s.segment").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(treatment == 1).alias("treated_rows"),
        F.count_if(treatment == 0).alias("control_rows"),
        F.avg(F.when(treatment == 1, target)).alias("rate1"),
        F.avg(F.when(treatment == 0, target)).alias("rate0"),
    )
    kept = groups.filter((F.col("n_rows") >= min_rows) & F.col("rate1").isNotNull() & F.col("rate0").isNotNull())
    table = kept.select(
        "segment_col",
        "segment",
        "n_rows",
        "treated_rows",
        "control_rows",
        F.round("rate1", 6).alias("treated_target_rate"),
        F.round("rate0", 6).alias("control_target_rate"),
        F.round(F.col("rate1") - F.col("rate0"), 6).alias("response_gap"),
    )
    return table.orderBy(F.abs("response_gap").desc(), F.col("segment_col").desc(), "segment").limit(top_n)


def purchase_summary(purchases: DataFrame) -> DataFrame:
    """Distinct counts and the spend distribution over all purchase lines."""
    spend = purchases.select(clean.number_or_null(F.col("purchase_sum")).alias("spend"))
    quantiles = exact_quantiles(spend, [], "spend", {"p50": 0.5, "p95": 0.95})
    value = clean.number_or_null(F.col("purchase_sum"))
    ids = {"unique_customers": "client_id", "transactions": "transaction_id", "unique_products": "product_id", "unique_stores": "store_id"}
    found = distinct_counts(purchases, [], {k: F.col(c) for k, c in ids.items()}, {"sums": ("sum", value), "known": ("count", value)})
    mean = F.round(F.col("sums") / F.nullif(F.col("known").cast("double"), F.lit(0.0)), 6)
    counts = found.select(*ids, mean.alias("purchase_sum_mean"))
    return counts.withColumn("q", quantiles.select(F.struct("p50", "p95")).scalar()).select(
        *counts.columns,
        F.round("q.p50", 6).alias("purchase_sum_median"),
        F.round("q.p95", 6).alias("purchase_sum_p95"),
    )


def feature_summary(table: DataFrame, features: list[str]) -> DataFrame:
    """Count, missing, distinct, moments and quartiles of every feature.

    Everything is taken from value counts, which are cut once, so the table behind
    them is computed once.
    """
    counts = cut_lineage(melted(table, [], features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    value, n = F.col("value"), F.col("n")
    weight = F.when(value.isNotNull(), n).otherwise(0)
    rows = F.sum(weight)
    total = F.sum(weight * F.coalesce(value, F.lit(0.0)))
    basic = counts.groupBy("feature").agg(
        rows.alias("non_null_count"),
        (F.sum(n) - rows).alias("missing_count"),
        F.round((F.sum(n) - rows) / F.sum(n).cast("double"), 4).alias("missing_pct"),
        F.count(F.lit(1)).alias("unique_values"),
        (total / F.nullif(rows.cast("double"), F.lit(0.0))).alias("mean"),
        F.round(F.min(value), 6).alias("min"),
        F.round(F.max(value), 6).alias("max"),
    )
    # Squares around the mean, weighed by count: no cancellation of large sums.
    around = counts.filter("value is not null").join(basic.select("feature", "mean"), "feature")
    squares, known = F.sum(n * (value - F.col("mean")) * (value - F.col("mean"))), F.sum(n)
    std = F.when(known > 1, F.sqrt(squares / F.nullif(known - 1, F.lit(0))))
    spread = around.groupBy("feature").agg(F.round(std, 6).alias("std"))
    quartiles = exact_quantiles(
        counts, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, weight="n"
    )
    return (
        basic.withColumn("mean", F.round("mean", 6))
        .join(spread, "feature", "left")
        .join(quartiles, "feature", "left")
        .select(
            *basic.columns,
            "std",
            *[F.round(name, 6).alias(name) for name in ("p25", "p50", "p75")],
        )
    )
