"""Data-quality reports: every check is a row (check, table, column, value, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.config import Columns
from nudgeframe.functions import clean
from nudgeframe.sources.tables import required_columns

CHECK_SCHEMA = "check string, table_name string, column_name string, value double, severity string"
# Columns whose null rate is reported per table.
NULL_CHECK_COLUMNS = {
    "clients": ("client_id", "age", "gender", "first_issue_date"),
    "train": ("client_id", "treatment_flg", "target", "first_issue_date"),
    "scoring": ("client_id",),
    "purchases": ("client_id", "transaction_datetime", "purchase_sum"),
    "products": ("product_id",),
}


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _long(wide: DataFrame, cells: list[tuple[dict, Column]], value_name: str = "value") -> DataFrame:
    """Turn one row of aggregates into labelled rows."""
    items = [
        F.struct(*[F.lit(v).cast("string").alias(k) for k, v in labels.items()], column.alias(value_name))
        for labels, column in cells
    ]
    return wide.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union(
        [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    )


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column.isNull() | F.isnan(column) if dict(df.dtypes)[name] in ("double", "float") else column.isNull()


def null_rates(tables: dict[str, DataFrame], only: dict[str, tuple] | None = None) -> DataFrame:
    """Null share of every (chosen) column: one aggregate pass per table."""
    frames = []
    for name, df in tables.items():
        columns = [c for c in (only or {}).get(name, df.columns) if c in df.columns]
        if only is not None and name not in only:
            continue
        wide = df.agg(
            *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
            F.count(F.lit(1)).alias("n"),
        )
        rate = [F.col(f"m{i}") / F.nullif(F.col("n").cast("double"), F.lit(0.0)) for i in range(len(columns))]
        frames.append(
            _long(
                wide,
                [({"table_name": name, "column_name": c}, F.round(r, 6)) for c, r in zip(columns, rate)],
                "null_rate",
            )
        )
    return union(frames)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key (a null key counts as one key)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def _ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(clean.text_id(F.col(key)).alias(key)).filter(F.col(key).isNotNull()).distinct()


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Share of distinct left ids present on the right; 0 without left ids."""
    marked = _ids(left, key).join(_ids(right, key).withColumn("hit", F.lit(1)), key, "left")
    share = F.count("hit") / F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0))
    return marked.agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("coverage"))


def join_coverage(pairs: dict[str, tuple[DataFrame, DataFrame]], key: str = "client_id") -> DataFrame:
    return union(
        [
            key_coverage(left, right, key).select(F.lit(name).alias("pair"), "coverage")
            for name, (left, right) in pairs.items()
        ]
    )


def id_differences(expected: DataFrame, observed: DataFrame, key: str = "client_id") -> DataFrame:
    """Counts of missing, extra and shared distinct ids, from one full join."""
    both = (
        _ids(expected, key)
        .withColumn("e", F.lit(1))
        .join(_ids(observed, key).withColumn("o", F.lit(1)), key, "full")
    )
    return both.agg(
        F.count_if(F.col("o").isNull()).alias("missing_ids"),
        F.count_if(F.col("e").isNull()).alias("extra_ids"),
        F.count_if(F.col("e").isNotNull() & F.col("o").isNotNull()).alias("shared_ids"),
    )


def label_counts(train: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Value counts of both label columns in one pass."""
    long = train.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))
                    for name in (columns.treatment, columns.target)
                ]
            )
        ).alias("r")
    )
    return long.filter("r.value is not null").groupBy("r.column_name", "r.value").agg(F.count(F.lit(1)).alias("n"))


def _check(frame: DataFrame, check: str, table: str, column: str | None, value: str, fail: str | None) -> DataFrame:
    severity = F.lit("info") if fail is None else F.when(F.col(value) > 0, fail).otherwise("ok")
    return frame.select(
        F.lit(check).alias("check"),
        F.lit(table).alias("table_name"),
        F.lit(column).cast("string").alias("column_name"),
        F.col(value).cast("double").alias("value"),
        severity.alias("severity"),
    )


def _schema_checks(spark: SparkSession, tables: dict[str, DataFrame], columns: Columns) -> DataFrame:
    """Column-level facts known from the schemas alone."""
    rows = []
    for name, needed in required_columns(columns).items():
        for column in needed:
            absent = float(column not in tables[name].columns)
            rows.append(("missing_required_column", name, column, absent, "error" if absent else "ok"))
    for column in columns.labels:
        leaked = float(column in tables["scoring"].columns)
        rows.append(("label_in_scoring", "scoring", column, leaked, "error" if leaked else "ok"))
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def _flagged(value: Column, level: str | None, above: float = 0.0) -> Column:
    return F.lit("info") if level is None else F.when(value > above, level).otherwise("ok")


def _table_pass(df: DataFrame, name: str, columns: Columns, high_null: float) -> DataFrame:
    """Row count, null rates, label and date checks of one table, in one scan."""
    measures = {("row_count", None): (F.count(F.lit(1)), None, 0.0)}
    n = F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0))
    if name == "train":
        for label in (columns.treatment, columns.target):
            if label in df.columns:
                bad = F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1))
                measures["non_binary_label", label] = (bad, "error", 0.0)
    for column in NULL_CHECK_COLUMNS.get(name, ()):
        if column in df.columns:
            rate = F.round(F.count_if(_missing(df, column)) / n, 6)
            measures["null_rate", column] = (rate, "warning", high_null)
    for table, column in (("purchases", "transaction_datetime"), ("train", "first_issue_date")):
        if table == name and column in df.columns:
            bad = F.count_if(clean.timestamp_or_null(F.col(column)).isNull())
            measures["unparseable_dates", column] = (F.round(bad / n, 6), "warning", 0.0)
    wide = df.agg(*[measure.cast("double").alias(f"v{i}") for i, (measure, _, _) in enumerate(measures.values())])
    cells = F.array(
        *[
            F.struct(
                F.lit(check).alias("check"),
                F.lit(name).alias("table_name"),
                F.lit(column).cast("string").alias("column_name"),
                F.col(f"v{i}").alias("value"),
                _flagged(F.col(f"v{i}"), level, above).alias("severity"),
            )
            for i, ((check, column), (_, level, above)) in enumerate(measures.items())
        ]
    )
    return wide.select(F.explode(cells).alias("r")).select("r.*")


def dataset_checks(
    tables: dict[str, DataFrame], columns: Columns = Columns(), high_null: float = 0.30
) -> DataFrame:
    """The full dataset report, over whole tables (no head sample): one pruned
    scan per table, plus key-only scans for duplicates, overlap and coverage."""
    key = columns.entity
    frames = [_schema_checks(tables["train"].sparkSession, tables, columns)]
    frames += [_table_pass(df, name, columns, high_null) for name, df in tables.items()]
    for name in ("train", "scoring"):
        if key in tables[name].columns:
            frames.append(_check(duplicate_count(tables[name], key), "duplicate_keys", name, key, "duplicates", "error"))
    overlap = _ids(tables["train"], key).join(_ids(tables["scoring"], key), key, "left_semi")
    frames.append(_check(overlap.agg(F.count(F.lit(1)).alias("n")), "train_scoring_overlap", "train", key, "n", "error"))
    for left in ("train", "scoring", "purchases"):
        covered = key_coverage(tables[left], tables["clients"], key)
        frames.append(_check(covered, "coverage_in_clients", left, key, "coverage", None))
    return union(frames)


def report_verdict(checks: DataFrame) -> DataFrame:
    """valid is true exactly when no check is an error."""
    return checks.agg(
        (F.count_if(F.col("severity") == "error") == 0).alias("valid"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def feature_table_checks(
    table: DataFrame,
    expected: DataFrame,
    forbidden=("target", "treatment_flg"),
    train_only=(),
    key: str = "client_id",
) -> DataFrame:
    """Grain, leakage and id coverage of a feature table."""
    direct = sorted(set(forbidden) & set(table.columns))
    indirect = sorted((set(train_only) - {key}) & set(table.columns))
    schema_rows = [
        ("missing_key", "features", key, float(key not in table.columns), "ok" if key in table.columns else "error"),
        ("forbidden_columns", "features", ",".join(direct) or None, float(len(direct)), "error" if direct else "ok"),
        ("train_only_columns", "features", ",".join(indirect) or None, float(len(indirect)), "error" if indirect else "ok"),
    ]
    frames = [table.sparkSession.createDataFrame(schema_rows, CHECK_SCHEMA)]
    if key in table.columns:
        frames.append(_check(duplicate_count(table, key), "duplicate_keys", "features", key, "duplicates", "error"))
        gaps = id_differences(expected, table, key)
        frames.append(_check(gaps, "missing_ids", "features", key, "missing_ids", "error"))
        frames.append(_check(gaps, "extra_ids", "features", key, "extra_ids", "error"))
    return union(frames)


def require_schema(table: DataFrame, columns: Columns = Columns()) -> None:
    """Raise before any job when a table lacks the key or carries a label."""
    if columns.entity not in table.columns:
        raise ValueError(f"feature table is missing {columns.entity}")
    leaked = sorted(set(columns.labels) & set(table.columns))
    if leaked:
        raise ValueError(f"forbidden feature columns present: {leaked}")


def require_feature_table(table: DataFrame, expected: DataFrame, forbidden=("target", "treatment_flg"), key="client_id"):
    """Raise when a feature table breaks its contract (one small job)."""
    failed = feature_table_checks(table, expected, forbidden, key=key).filter("severity = 'error'").collect()
    if failed:
        raise ValueError("; ".join(f"{row['check']}: {row['value']:.0f} ({row['column_name']})" for row in failed))


def modeling_table_checks(table: DataFrame, columns: Columns = Columns(), max_null: float = 0.05) -> DataFrame:
    """Unique ids, binary non-null labels, no redeem column, low null rates."""
    leaks = [c for c in table.columns if "redeem" in c.lower()]
    rows = [("redeem_columns", "modeling", ",".join(leaks) or None, float(len(leaks)), "error" if leaks else "ok")]
    frames = [table.sparkSession.createDataFrame(rows, CHECK_SCHEMA)]
    frames.append(_check(duplicate_count(table, columns.entity), "duplicate_keys", "modeling", columns.entity, "duplicates", "error"))
    for label in columns.labels:
        value = F.col(label)
        bad = table.agg(F.count_if(~F.coalesce(value.isin(0, 1), F.lit(False))).alias("n"))
        frames.append(_check(bad, "invalid_label", "modeling", label, "n", "error"))
    features = tuple(c for c in table.columns if c not in (columns.entity, "split", *columns.labels))
    rates = null_rates({"modeling": table}, {"modeling": features})
    frames.append(
        rates.select(
            F.lit("null_rate").alias("check"),
            "table_name",
            "column_name",
            F.col("null_rate").alias("value"),
            F.when(F.col("null_rate") > max_null, "warning").otherwise("ok").alias("severity"),
        )
    )
    return union(frames)


def submission_checks(submission: DataFrame, scoring: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Exact columns, row count, uniqueness, id set and numeric score."""
    key, score = columns.entity, columns.score
    wrong = float(submission.columns != [key, score])
    numeric = dict(submission.dtypes).get(score) in ("double", "float", "int", "bigint", "smallint", "tinyint")
    rows = [
        ("wrong_columns", "submission", None, wrong, "error" if wrong else "ok"),
        ("score_not_numeric", "submission", score, float(not numeric), "ok" if numeric else "error"),
    ]
    frames = [submission.sparkSession.createDataFrame(rows, CHECK_SCHEMA)]
    counts = submission.agg(F.count(F.lit(1)).alias("a")).select(
        F.abs(F.col("a") - scoring.agg(F.count(F.lit(1))).scalar()).alias("n")
    )
    frames.append(_check(counts, "row_count_gap", "submission", None, "n", "error"))
    frames.append(_check(duplicate_count(submission, key), "duplicate_keys", "submission", key, "duplicates", "error"))
    gaps = id_differences(scoring, submission, key)
    frames.append(_check(gaps, "missing_ids", "submission", key, "missing_ids", "error"))
    frames.append(_check(gaps, "extra_ids", "submission", key, "extra_ids", "error"))
    return union(frames)


def arm_response(train: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Response per arm and their difference; a missing arm counts as 0."""
    treatment, target = F.col(columns.treatment), F.col(columns.target)

    def rate(arm):
        return F.round(F.avg(F.when(treatment == arm, target)), 6)

    one = train.agg(
        F.count_if(treatment == 1).alias("treated_rows"),
        F.count_if(treatment == 0).alias("control_rows"),
        rate(1).alias("treated_target_rate"),
        rate(0).alias("control_target_rate"),
    )
    zero = F.lit(0.0)
    gap = F.coalesce("treated_target_rate", zero) - F.coalesce("control_target_rate", zero)
    return one.withColumn("average_treatment_effect", F.round(gap, 6))


def joint_counts(train: DataFrame, columns: Columns = Columns()) -> DataFrame:
    return train.groupBy(
        clean.joint_key(F.col(columns.treatment), F.col(columns.target)).alias("joint_key")
    ).agg(F.count(F.lit(1)).alias("n"))


def treatment_target_cube(train: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """Cross-tab with margins; null marks a margin."""
    return train.cube(columns.treatment, columns.target).agg(F.count(F.lit(1)).alias("n"))


def melted(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long (ids..., feature, value) rows with values as doubles."""
    typed = df.select(*ids, *[clean.number_or_null(F.col(f)).alias(f) for f in features])
    return typed.unpivot(ids, features, "feature", "value")


def balance_smd(
    labels: DataFrame,
    features: DataFrame,
    numeric_columns: list[str],
    columns: Columns = Columns(),
    threshold: float = 0.1,
) -> DataFrame:
    """Absolute standardised mean difference per feature, population variance.

    All features share one grouped pass; moments are combined map-side.
    """
    joined = labels.select(columns.entity, columns.treatment).join(
        features.select(columns.entity, *numeric_columns), columns.entity
    )
    long = melted(joined, [columns.treatment], numeric_columns)
    arm = F.col(columns.treatment)
    treated, control = F.when(arm == 1, F.col("value")), F.when(arm == 0, F.col("value"))
    stats = long.groupBy("feature").agg(
        F.avg(treated).alias("m1"),
        F.avg(control).alias("m0"),
        F.var_pop(treated).alias("v1"),
        F.var_pop(control).alias("v0"),
    )
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    smd = F.coalesce(F.abs((F.col("m1") - F.col("m0")) / F.nullif(pooled, F.lit(0.0))), F.lit(0.0))
    return stats.select("feature", F.round(smd, 6).alias("smd"), (smd > threshold).alias("imbalanced"))
