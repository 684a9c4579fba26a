"""Input-size checks that decide whether a plan needs skew handling.

The estimate is the sum of the sizes Catalyst reports for the leaves of the
analysed plan, so it costs no job. A plan over inputs below ``SMALL_BYTES`` fits
comfortably in one task per group; above it the callers measure key frequencies
and split what is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 2_000_000
#: Input bytes (as stored) for each task of a step whose rows widen or fill hash tables.
TASK_BYTES = 4 * 1024 * 1024

_SMALL_KEY = "spark.nudgeframe.smallBytes"
_ROWS_KEY = "spark.nudgeframe.rowsPerTask"
_TASK_KEY = "spark.nudgeframe.taskBytes"
_UNKNOWN = 2**62


def _setting(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def rows_per_task(df: DataFrame) -> int:
    return max(1, _setting(df, _ROWS_KEY, ROWS_PER_TASK))


def input_bytes(df: DataFrame) -> int:
    """Total size of the plan's leaf relations, as Catalyst reports it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame) -> bool:
    """Whether one task per group is enough; decides the plan, never the result."""
    return input_bytes(df) <= _setting(df, _SMALL_KEY, SMALL_BYTES)


def spread(df: DataFrame, *on: str, tasks: int | None = None) -> DataFrame:
    """``df`` dealt by ``on`` over as many tasks as its input asks for, so that a task's share stays the same.

    Adaptive execution merges small partitions by their compressed bytes, which says little
    about the memory of sorts and hash tables; it leaves a stated number alone. Inputs
    that the session's own number of partitions divides finely enough stay as they are.
    ``tasks`` passes on a number found before.
    """
    tasks = tasks_for(df) if tasks is None else tasks
    return df.repartition(tasks, *on) if tasks else df


def tasks_for(df: DataFrame) -> int:
    """Number of tasks for steps over the input of ``df``, or 0 where Spark's own number will do.

    Rows that come from no stored table have no known size (Spark reports the largest
    long) and keep Spark's number.
    """
    size = input_bytes(df)
    tasks = -(-size // _setting(df, _TASK_KEY, TASK_BYTES))
    return tasks if size < _UNKNOWN and tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark would broadcast ``df`` under its own threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return input_bytes(df) <= min(limit, _setting(df, _SMALL_KEY, SMALL_BYTES))
