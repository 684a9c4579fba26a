"""Running totals over an ordering, without pulling a group into one task.

A plain window with no (or a coarse) partition key sends each group to a single
task. ``running`` instead cuts large inputs into ordered buckets:

1. rows are range-partitioned by (group, sort key) with Spark's own partitioner, the
   partition is their bucket, and they are written once to the shared folder;
2. per-bucket totals of the written rows (one small row each) become exclusive offsets;
3. rows are numbered inside their bucket and the offset is added.

Placement and windows order by the same sort columns, so nulls, NaN and signed zeros
fall alike on both paths, and rows equal in the whole key stay together. Bucket
numbers are read from the written rows: a retried task cannot see other cuts. The
number of buckets is the session's number of shuffle partitions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nudgeframe.plans.sizing import is_small
from nudgeframe.session import shared_folder

_BUCKET = "__bucket"


def _sort_columns(order):
    return [F.col(name).desc() if down else F.col(name).asc() for name, down in order]


def _bucketed(rows: DataFrame, by, order) -> DataFrame:
    """``rows`` with their bucket, written once."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(buckets, *[F.col(name).asc() for name in by], *_sort_columns(order))
    placed.withColumn(_BUCKET, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def _same(left: DataFrame, right: DataFrame, names) -> Column:
    return reduce(lambda a, b: a & b, [left[name].eqNullSafe(right[f"__k_{name}"]) for name in names])


def running(
    df: DataFrame,
    by: list[str],
    order: list[tuple[str, bool]],
    sums: dict[str, Column],
    prior_max: dict[str, Column] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums, exclusive running maxima and group totals.

    ``order`` lists ``(column, descending)`` and should end in a column that tells
    the rows of a group apart; nulls, in ``by`` too, are values like others. Group
    totals appear as ``total_<name>``.
    """
    prior_max = prior_max or {}
    rows = df.select("*", *[column.alias(f"__v_{name}") for name, column in (sums | prior_max).items()])
    small = is_small(df)
    rows = rows.withColumn(_BUCKET, F.lit(0)) if small else _bucketed(rows, by, order)
    group = Window.partitionBy(*by, _BUCKET)
    upto = group.orderBy(*_sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = group.orderBy(*_sort_columns(order)).rowsBetween(Window.unboundedPreceding, -1)

    local = rows.select(
        *df.columns,
        _BUCKET,
        *[F.sum(f"__v_{name}").over(upto).alias(name) for name in sums],
        *[F.max(f"__v_{name}").over(before).alias(name) for name in prior_max],
        *(
            [F.sum(f"__v_{name}").over(group).alias(f"total_{name}") for name in sums]
            if totals and small
            else []
        ),
    )
    if small:
        return local.drop(_BUCKET)

    per_bucket = rows.groupBy(*by, _BUCKET).agg(
        *[F.sum(f"__v_{name}").alias(f"__b_{name}") for name in sums],
        *[F.max(f"__v_{name}").alias(f"__b_{name}") for name in prior_max],
    )
    # One row a bucket beyond one per group.
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *[F.col(name).alias(f"__k_{name}") for name in (*by, _BUCKET)],
        *[F.coalesce(F.sum(f"__b_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in sums],
        *[F.max(f"__b_{name}").over(earlier).alias(f"__o_{name}") for name in prior_max],
        *([F.sum(f"__b_{name}").over(whole).alias(f"total_{name}") for name in sums] if totals else []),
    )
    joined = local.join(offsets, _same(local, offsets, (*by, _BUCKET)), "left")
    return joined.select(
        *df.columns,
        *[(F.col(name) + F.col(f"__o_{name}")).alias(name) for name in sums],
        *[
            F.when(F.col(name).isNull(), F.col(f"__o_{name}"))
            .when(F.col(f"__o_{name}") > F.col(name), F.col(f"__o_{name}"))
            .otherwise(F.col(name))
            .alias(name)
            for name in prior_max
        ],
        *([F.col(f"total_{name}") for name in sums] if totals else []),
    )


def value_counts(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows per group and distinct known value: (by..., value, ties)."""
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("ties"))


def average_ranks(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Tie-averaged rank of every distinct value: (by..., value, ties, avg_rank).

    ``weight`` names a row-count column when rows are already aggregated.
    """
    ties = value_counts(df, by, value, weight)
    ranked = running(ties, by, [(value, False)], {"upto": F.col("ties")})
    return ranked.select(
        *by,
        value,
        "ties",
        (F.col("upto") - F.col("ties") + (F.col("ties") + 1) / F.lit(2.0)).alias("avg_rank"),
    )


def tied_ranks(cells: DataFrame, by: list[str], value: str, tiebreak: str, weight: str, name: str) -> DataFrame:
    """``cells`` with the tie-averaged rank of ``value`` as ``name`` and its group's weight as ``total_<name>``.

    ``weight`` counts the rows a cell stands for; ``value`` and ``tiebreak`` are known and
    tell the cells of a group apart. Large inputs are placed by both, so a value shared by
    many cells spans buckets instead of filling one. Only a bucket's first and last value
    can do so: their ties are summed over the buckets' ends, two small rows a bucket, and no
    table of ranks is joined on values.
    """
    small = is_small(cells)
    rows = cells.withColumn(_BUCKET, F.lit(0)) if small else _bucketed(cells, by, [(value, False), (tiebreak, False)])
    bucket = Window.partitionBy(*by, _BUCKET)
    ordered = bucket.orderBy(F.col(value).asc())
    local = rows.select(
        *cells.columns,
        _BUCKET,
        F.sum(weight).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("__upto"),
        F.sum(weight).over(ordered.rangeBetween(Window.currentRow, Window.currentRow)).alias("__ties"),
        *([F.sum(weight).over(bucket).alias(f"total_{name}")] if small else []),
    )

    def middle(start, ties):
        return F.col(start) + (F.col(ties) + 1) / F.lit(2.0)

    if small:
        ranks = local.withColumn("__start", F.col("__upto") - F.col("__ties"))
        return ranks.select(*cells.columns, middle("__start", "__ties").alias(name), f"total_{name}")

    ends = local.groupBy(*by, _BUCKET).agg(
        F.sum(weight).alias("__n"),
        F.min(value).alias("__first"),
        F.min_by("__ties", value).alias("__first_ties"),
        F.max(value).alias("__last"),
        F.max_by("__ties", value).alias("__last_ties"),
    )
    # One row a bucket beyond one per group.
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    placed = ends.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumn(
        f"total_{name}", F.sum("__n").over(group)
    )
    first = F.struct(F.lit(True).alias("low"), F.col("__first").alias("end"), F.col("__before").alias("start"), F.col("__first_ties").alias("ties"))
    last_start = F.col("__before") + F.col("__n") - F.col("__last_ties")
    last = F.struct(F.lit(False).alias("low"), F.col("__last").alias("end"), last_start.alias("start"), F.col("__last_ties").alias("ties"))
    one_value = F.col("__first").eqNullSafe(F.col("__last"))
    values = placed.select(*by, _BUCKET, "__before", f"total_{name}", F.inline(F.when(one_value, F.array(first)).otherwise(F.array(first, last))))
    same_value = Window.partitionBy(*by, "end")
    values = values.withColumn("__start", F.min("start").over(same_value)).withColumn("__all", F.sum("ties").over(same_value))
    rank = middle("__start", "__all")
    offsets = values.groupBy(*[F.col(c).alias(f"__k_{c}") for c in (*by, _BUCKET)]).agg(
        F.max("__before").alias("__before"),
        F.max(f"total_{name}").alias(f"total_{name}"),
        F.min("end").alias("__first"),
        F.max("end").alias("__last"),
        F.max(F.when(F.col("low"), rank)).alias("__first_rank"),
        F.max(F.when(~F.col("low"), rank)).alias("__last_rank"),
    )
    joined = local.join(offsets, _same(local, offsets, (*by, _BUCKET)))
    inner = F.col("__before") + F.col("__upto") - F.col("__ties") + (F.col("__ties") + 1) / F.lit(2.0)
    ranked = F.when(F.col(value) == F.col("__first"), F.col("__first_rank")).when(F.col(value) == F.col("__last"), F.col("__last_rank"))
    return joined.select(*cells.columns, ranked.otherwise(inner).alias(name), f"total_{name}")


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated exact quantiles, one row per group.

    Works on value counts and their running totals, so no task holds a group's
    full value list as the built-in exact ``percentile`` would.
    """
    walk = running(
        value_counts(df, by, value, weight),
        by,
        [(value, False)],
        {"upto": F.col("ties")},
        totals=True,
    )
    last, first = F.col("upto") - 1, F.col("upto") - F.col("ties")
    position = {name: (F.col("total_upto") - 1) * F.lit(float(p)) for name, p in probs.items()}

    def at(index):
        return F.max(F.when((first <= index) & (index <= last), F.col(value).cast("double")))

    picked = walk.groupBy(*by).agg(
        *[
            part
            for name, pos in position.items()
            for part in (
                at(F.floor(pos)).alias(f"__lo_{name}"),
                at(F.ceil(pos)).alias(f"__hi_{name}"),
                F.max(pos - F.floor(pos)).alias(f"__w_{name}"),
            )
        ]
    )
    return picked.select(
        *by,
        *[
            (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__w_{name}")).alias(name)
            for name in probs
        ],
    )
