"""Several exact distinct counts, and totals, in one pass without widening rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGAIN = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
_FIRST = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def distinct_counts(df: DataFrame, by: list[str], distinct: dict[str, Column], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """(by..., a distinct count of known values for each of ``distinct``, totals...).

    A row becomes one narrow (kind, value) row for each counted column, and the first also
    carries what is totalled. Equal (group, kind, value) rows merge before the shuffle, so
    a group with very many rows is spread over its values; then groups add up. Several
    count(distinct) in one aggregate would copy every row, all columns wide, once for each
    of them. ``totals`` names (min, max, sum or count, column).
    """
    entries = [
        F.struct(
            F.lit(k).alias("__kind"), value.cast("string").alias("__value"),
            *[F.when(F.lit(k == 0), column).alias(f"__t_{name}") for name, (_, column) in totals.items()],
        )
        for k, value in enumerate(distinct.values())
    ]
    long = df.select(*by, F.explode(F.array(*entries)).alias("__e")).select(*by, "__e.*")
    merged = long.groupBy(*by, "__kind", "__value").agg(F.lit(1).alias("__one"), *[_FIRST[f](f"__t_{name}").alias(name) for name, (f, _) in totals.items()])
    counts = [F.count_if((F.col("__kind") == k) & F.col("__value").isNotNull()).alias(name) for k, name in enumerate(distinct)]
    return merged.groupBy(*by).agg(*counts, *[_AGAIN[f](name).alias(name) for name, (f, _) in totals.items()])
