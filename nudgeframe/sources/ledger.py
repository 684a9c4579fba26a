"""Append-only trial ledger, patches, and tuning-plan documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout of one ledger record.
LEDGER_SCHEMA = (
    "experiment_id string, seq long, run_id string, parent_run_id string, hypothesis_id string, "
    "feature_recipe_id string, feature_artifact_id string, template_name string, uplift_learner_family string, "
    "base_estimator string, params_hash string, split_seed int, status string, error string, "
    "qini_auc double, normalized_qini_auc double, uplift_auc double, "
    "uplift_at_k map<string,double>, policy_gain map<string,double>, "
    "held_out_qini_auc double, held_out_normalized_qini_auc double, held_out_uplift_auc double, "
    "verdict string, next_recommended_actions array<string>, artifact_paths map<string,string>"
)
# The layout of a tuning-plan document.
PLAN_SCHEMA = (
    "plan_id string, trial_specs array<struct<spec_id string, hypothesis_id string, template_name string, "
    "learner_family string, base_estimator string, feature_recipe_id string, split_seed int, params map<string,string>>>"
)


def conform(records: DataFrame) -> DataFrame:
    """Records in ledger layout; absent fields become null."""
    empty = records.sparkSession.createDataFrame([], LEDGER_SCHEMA)
    return records.select(
        *[
            (F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in empty.schema
        ]
    )


def append(records: DataFrame, path: str) -> None:
    """Add records as gzipped JSON lines; parts written as plain text before stay readable beside them."""
    conform(records).write.mode("append").json(path, compression="gzip")


def load(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).json(list(paths))


def patched(ledger: DataFrame, patches: DataFrame, key: str = "run_id") -> DataFrame:
    """Ledger with the non-null fields of each patch row put in place.

    ``patches`` holds at most one row per run and any subset of the columns.
    """
    fields = [c for c in patches.columns if c != key]
    unknown = set(fields) - set(ledger.columns)
    if unknown:
        raise ValueError(f"unknown ledger fields: {sorted(unknown)}")
    renamed = patches.select(key, *[F.col(c).alias(f"__new_{c}") for c in fields])
    return ledger.join(renamed, key, "left").select(
        *[F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in ledger.columns]
    )


def rewrite(ledger: DataFrame, path: str) -> DataFrame:
    """Write a patched ledger as a new version and read it back."""
    conform(ledger).write.mode("errorifexists").json(path, compression="gzip")
    return load(ledger.sparkSession, path)


def plan_specs(spark: SparkSession, *paths: str, one_per_file: bool = True) -> DataFrame:
    """Trial specs of tuning-plan documents, one row per spec.

    A plan is a whole (multi-line) file, or a line of a plan table.
    """
    plans = spark.read.schema(PLAN_SCHEMA).option("multiLine", one_per_file).json(list(paths))
    return plans.select("plan_id", F.explode("trial_specs").alias("s")).select("plan_id", "s.*")


def spec_params(specs: DataFrame) -> DataFrame:
    """Parameters as (spec_id, name, value) rows."""
    return specs.select("spec_id", F.explode("params").alias("name", "value"))
