"""Exact medians of many columns at once, by refining histograms.

A double maps to a 64-bit number of the same order. Each round reads the columns once
and counts 16 more bits of the values that share the bits found so far, so four
rounds settle every middle value. Rows are neither sorted nor melted, and what leaves a task is a
list of counts.

Counts are kept per ``cell`` (a small whole number on every row, such as arm and fold).
A group is a set of cells: medians of all training folds come from the same counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS, _ROUNDS = 16, 4
_TOP = np.uint64(1 << 63)
#: Counts that a task holds before it adds up equal ones.
_HELD = 1_000_000


def order_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits ^ _TOP)


def value_of(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits & _TOP, bits ^ _TOP, ~bits).view(np.float64)[0])


def _merged(names, counts):
    names, place = np.unique(np.concatenate(names), return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return names, total


def _counts(df: DataFrame, columns: list[str], opened: list[np.ndarray], n_cells: int, turn: int) -> DataFrame:
    """(column, slot, cell, bucket, n): how often the next bits follow each open prefix."""
    below = np.uint64(64 - _BITS * (turn + 1))

    def run(batches):
        held = [([], [], 0) for _ in columns]
        for batch in batches:
            cell = batch.column(0).to_numpy().astype(np.int64)
            for c in range(len(columns)):
                column = batch.column(c + 1)
                keys = order_keys(column.to_numpy(zero_copy_only=False).astype(np.float64))
                take = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                slot = np.zeros(len(take), np.int64)
                if turn:
                    prefix = keys[take] >> np.uint64(64 - _BITS * turn)
                    slot = np.minimum(np.searchsorted(opened[c], prefix), len(opened[c]) - 1)
                    mine = opened[c][slot] == prefix if len(opened[c]) else np.zeros(len(take), bool)
                    take, slot = take[mine], slot[mine]
                bucket = ((keys[take] >> below) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
                names, counts = np.unique(((slot * n_cells + cell[take]) << _BITS) | bucket, return_counts=True)
                own, often, size = held[c]
                own.append(names)
                often.append(counts)
                size += len(names)
                if size > _HELD:
                    names, counts = _merged(own, often)
                    own, often, size = [names], [counts], len(names)
                held[c] = (own, often, size)
        for c, (own, often, _) in enumerate(held):
            if own:
                names, counts = _merged(own, often)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), c, np.int32)), pa.array(names), pa.array(counts)], ["column", "name", "n"])

    found = df.select("cell", *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(run, "column int, name long, n long")
    found = found.groupBy("column", "name").agg(F.sum("n").alias("n"))
    place = F.shiftright("name", _BITS)
    return found.select(
        "column", F.floor(place / n_cells).cast("int").alias("slot"), F.pmod(place, F.lit(n_cells)).cast("int").alias("cell"),
        F.col("name").bitwiseAND((1 << _BITS) - 1).cast("int").alias("bucket"), "n",
    )


def medians(df: DataFrame, columns: list[str], groups: dict[str, list[int]], known: dict[tuple[str, str], int]) -> dict[tuple[str, str], float | None]:
    """{(group, column): median of the known values, or None}, one value per group and column.

    ``df`` has ``cell`` and the columns, and is read ``_ROUNDS`` times: write or persist it first.
    ``known`` says how many values are not null. The middle of an even number is the mean of two.
    """
    n_cells = 1 + max(cell for cells in groups.values() for cell in cells)
    state = {}
    for g in groups:
        for c in columns:
            n = known[g, c]
            for side, rank in (("low", (n - 1) // 2), ("high", n // 2)) if n else ():
                state[g, c, side] = (0, rank)
    spark = df.sparkSession
    for turn in range(_ROUNDS if state else 0):
        opened = [np.array(sorted({p for (_, o, _), (p, _) in state.items() if o == c}), np.uint64) for c in columns]
        slots = [{int(p): i for i, p in enumerate(o)} for o in opened]
        wanted = [
            (g, columns.index(c), side, slots[columns.index(c)][prefix], rank, cell)
            for (g, c, side), (prefix, rank) in state.items()
            for cell in groups[g]
        ]
        wanted = spark.createDataFrame(wanted, "g string, column int, side string, slot int, rank long, cell int")
        counts = _counts(df, columns, opened, n_cells, turn).join(wanted, ["column", "slot", "cell"])
        counts = counts.groupBy("g", "column", "side", "rank", "bucket").agg(F.sum("n").alias("n"))
        # A group has one row a bucket, 2^16 at most.
        upto = F.sum("n").over(Window.partitionBy("g", "column", "side").orderBy("bucket"))
        for r in counts.withColumn("upto", upto).filter("rank < upto and rank >= upto - n").collect():
            key = r["g"], columns[r["column"]], r["side"]
            state[key] = (state[key][0] << _BITS | r["bucket"], r["rank"] - (r["upto"] - r["n"]))
    out = {}
    for g in groups:
        for c in columns:
            ends = [value_of(state[g, c, side][0]) for side in ("low", "high")] if known[g, c] else None
            out[g, c] = None if ends is None else ends[0] + (ends[1] - ends[0]) * 0.5
    return out
