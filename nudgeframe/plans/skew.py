"""Equi-joins that survive keys holding a large share of the fact rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgeframe.plans.sizing import fits_broadcast, is_small, rows_per_task, spread
from nudgeframe.session import cut_lineage

_SALT = "__salt"
#: Expected sampled rows of a key that fills one task.
_HITS = 16


@dataclass(frozen=True)
class HeavyKeys:
    """A table (__h, __salts) of the keys to salt, by hash, or None."""

    table: DataFrame | None = None

    @property
    def any(self) -> bool:
        return self.table is not None


NONE = HeavyKeys()


def find_heavy_keys(probe: DataFrame, on: list[str]) -> HeavyKeys:
    """Keys whose estimated row count exceeds one task, each with its own number of salts.

    ``probe`` needs the key columns only. The sample takes rows by hash of a random
    draw so that a key filling one task is expected ``_HITS`` times; it decides where
    salting is applied, never which rows are kept, so a missed key costs balance and
    not correctness. The keys stay a table, however many there are.
    """
    limit = rows_per_task(probe)
    fraction = min(1.0, _HITS / limit)
    counts = (
        probe.select(F.xxhash64(*on).alias("__h"))
        .sample(fraction, seed=7)
        .groupBy("__h")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit * fraction)
    )
    found = cut_lineage(counts.select("__h", F.ceil(F.col("n") / (limit * fraction) + 1).cast("long").alias("__salts")))
    return HeavyKeys(found) if found.head(1) else NONE


def skew_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_by: list[str] | None = None,
    heavy: HeavyKeys | None = None,
    probe: DataFrame | None = None,
    tasks: int = 0,
) -> DataFrame:
    """Join ``fact`` to ``dim``; rows of heavy keys are salted over many tasks.

    Small inputs, and lookups Spark can broadcast under its own size check, take
    the plain join. Otherwise the rows of each heavy key spread over its own number
    of salts and only those keys' lookup rows are repeated. The table of heavy keys
    has a row for each key that fills a task; Spark broadcasts it under its own
    check, else it is joined by hash. Known heavy keys skip the search; ``probe``
    names a cheaper frame to search in. ``tasks`` is the number of tasks of a shuffled
    join whose rows widen behind it (0: Spark's own).
    """
    if fits_broadcast(dim):
        return fact.join(dim, on, how)
    if is_small(fact):
        return spread(fact, *on, tasks=tasks).join(spread(dim, *on, tasks=tasks), on, how)
    if heavy is None:
        heavy = find_heavy_keys(fact if probe is None else probe, on)
    if not heavy.any:
        return spread(fact, *on, tasks=tasks).join(spread(dim, *on, tasks=tasks), on, how)
    salted_by = salt_by or [c for c in fact.columns if c not in on] or on
    zero, salts = F.lit(0).cast("long"), F.col("__salts")
    salted = fact.join(heavy.table, F.xxhash64(*[fact[c] for c in on]) == F.col("__h"), "left").withColumn(
        _SALT, F.when(salts.isNull(), zero).otherwise(F.pmod(F.xxhash64(*salted_by), salts))
    )
    repeated = dim.join(heavy.table, F.xxhash64(*[dim[c] for c in on]) == F.col("__h"), "left").withColumn(
        _SALT, F.explode(F.when(salts.isNull(), F.array(zero)).otherwise(F.sequence(zero, salts - 1)))
    )
    salted, repeated = salted.drop("__h", "__salts"), repeated.drop("__h", "__salts")
    salted, repeated = (spread(side, *on, _SALT, tasks=tasks) for side in (salted, repeated))
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)
