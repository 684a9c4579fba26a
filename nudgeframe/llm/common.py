"""Helpers shared by the operators: lineage cuts, hashes, Arrow text access."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import nudgeframe
from nudgeframe.session import cut_lineage as cut
from nudgeframe.session import shared_folder  # noqa: F401

#: A null doc_id sorts after every other one.
LAST_ID = 2**63 - 1
#: Rows under which a measured lookup table is broadcast; above it Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per context: they may not find it where the driver did."""
    context = spark.sparkContext
    if getattr(context, "nudgeframe_shipped", False):
        return
    root = Path(nudgeframe.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "nudgeframe_package.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context.nudgeframe_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_lookup(df: DataFrame, lookup: DataFrame, on: Column | list[str], how: str) -> DataFrame:
    """Join a checkpointed ``lookup``; it is broadcast only after its rows are counted."""
    if lookup.count() <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    return df.join(lookup, on, how)


def with_column(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` and one more column."""
    return StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (or binary) column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int):
    """Row ranges [i, j) whose bytes stay within ``limit``; a longer row stands alone."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def order_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))
