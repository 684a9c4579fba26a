"""Spearman correlation over any number of groups without sorting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgeframe.plans.prefix import tied_ranks


def pearson(x: Column, y: Column, weight: Column) -> Column:
    """Weighted correlation from plain sums; null when a side is constant."""
    n = F.sum(weight)
    sx, sy = F.sum(weight * x), F.sum(weight * y)
    sxx, syy, sxy = F.sum(weight * x * x), F.sum(weight * y * y), F.sum(weight * x * y)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.nullif(F.sqrt(vx) * F.sqrt(vy), F.lit(0.0)))


def spearman(rows: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys..., n, correlation) with tie-averaged ranks; rows with an unknown side do not count.

    Equal (left, right) pairs merge first. Two passes over the merged cells, each in the
    order of one side, attach the ranks; nothing is joined on values, so a value shared
    by many cells is no hot key. Ranks are centred on the group's mean rank to keep the
    sums well conditioned.
    """
    known = rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    cells = known.groupBy(*keys, left, right).agg(F.count(F.lit(1)).alias("__m"))
    ranked = tied_ranks(cells, keys, left, right, "__m", "__left").drop("total___left")
    ranked = tied_ranks(ranked, keys, right, left, "__m", "__right")
    middle = (F.col("total___right") + 1) / F.lit(2.0)
    correlation = pearson(F.col("__left") - middle, F.col("__right") - middle, F.col("__m").cast("double"))
    return ranked.groupBy(*keys).agg(F.sum("__m").alias("n"), correlation.alias("correlation"))
