"""Source tables of a campaign study: schemas, reading and required columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.config import Columns
from nudgeframe.functions import clean

# Layouts of the five source tables (all read as text from CSV and
# cleaned leniently, column by column, by the operators).
TABLE_COLUMNS = {
    "clients": ("client_id", "first_issue_date", "first_redeem_date", "age", "gender"),
    "purchases": (
        "client_id",
        "transaction_id",
        "transaction_datetime",
        "regular_points_received",
        "express_points_received",
        "regular_points_spent",
        "express_points_spent",
        "purchase_sum",
        "store_id",
        "product_id",
        "product_quantity",
        "trn_sum_from_iss",
        "trn_sum_from_red",
    ),
    "products": (
        "product_id",
        "level_1",
        "level_2",
        "level_3",
        "level_4",
        "segment_id",
        "brand_id",
        "vendor_id",
        "netto",
        "is_own_trademark",
        "is_alcohol",
    ),
    "train": ("client_id", "treatment_flg", "target"),
    "scoring": ("client_id",),
}


class TableReadError(ValueError):
    """A source table is missing or cannot be read."""


def read_table(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Lazily scan one table; missing or unreadable input raises TableReadError.

    CSV columns arrive as text under their header names, so no inference pass
    runs over the data; pruning and filters still reach the scan.
    """
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    return _loaded(reader.format(file_format), path)


def _loaded(reader, path: str) -> DataFrame:
    try:
        return reader.load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise TableReadError(f"missing required table: {path}") from error
        raise TableReadError(f"cannot read table {path}: {error}") from error


#: Beside the columns of a CSV table: the text of a line whose fields do not fit, and its file.
LINE, FILE = "__line", "__file"
_UNREADABLE = {"number": clean.number_or_null, "timestamp": clean.timestamp_or_null}


def read_csv_lines(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Lazily scan CSV files with headers; no line ends the job.

    All columns arrive as text. A line with more or fewer fields than ``columns`` keeps the
    fields there are and its text in ``LINE``, which is null for all others; ``FILE`` names
    its file. Blank lines are no rows.
    """
    schema = ", ".join(f"`{c}` string" for c in (*columns, LINE))
    # A pruned parser splits no further than the columns asked for, and finds no broken line.
    reader = spark.read.schema(schema).options(columnPruning=False, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE)
    return _loaded(reader.format("csv"), path).select("*", F.col("_metadata.file_path").alias(FILE))


def _row_problems(key: str, kinds: dict[str, str]):
    """The problems of a row of ``read_csv_lines`` as an array of texts.

    A line whose fields do not fit has that problem alone: its fields may be those of others.
    """
    found = [F.when(F.coalesce(F.trim(key), F.lit("")) == "", "missing_key")]
    for name, kind in kinds.items():
        given = F.coalesce(F.trim(name), F.lit("")) != ""
        found.append(F.when(given & _UNREADABLE[kind](F.col(name)).isNull(), f"unreadable_{name}"))
    others = F.array_compact(F.array(*found))
    return F.when(F.col(LINE).isNotNull(), F.array(F.lit("wrong_number_of_fields"))).otherwise(others)


def csv_problems(rows: DataFrame, table: str, key: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """(table_name, problem, n_rows, n_files, example) of ``read_csv_lines``, one row a problem found.

    ``kinds`` names columns that must hold a number or a timestamp where they hold anything.
    ``example`` is the least of the lines, or of the keys where the fields fit. One scan,
    summed before the shuffle; an empty table gives no row.
    """
    each = rows.select(F.explode(_row_problems(key, kinds or {})).alias("problem"), FILE, F.coalesce(LINE, key).alias("example"))
    per_file = each.groupBy("problem", FILE).agg(F.count(F.lit(1)).alias("n"), F.min("example").alias("example"))
    total = per_file.groupBy("problem").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.min("example").alias("example"))
    return total.select(F.lit(table).alias("table_name"), "*")


def readable_rows(rows: DataFrame, key: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``read_csv_lines`` without any problem, in their own columns."""
    return rows.filter(F.size(_row_problems(key, kinds or {})) == 0).drop(LINE, FILE)


def required_columns(columns: Columns = Columns()) -> dict[str, tuple]:
    return {
        "clients": (columns.entity,),
        "train": (columns.entity, columns.treatment, columns.target),
        "scoring": (columns.entity,),
        "purchases": (columns.entity, "transaction_id", "transaction_datetime", "purchase_sum"),
    }
