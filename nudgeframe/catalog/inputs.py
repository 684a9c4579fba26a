"""Campaign-study views over the benchmark parquet tables, for Spark and SQL.

Both renderings use integer arithmetic, md5 prefixes or the same double arithmetic,
rounding included, so they agree row for row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nudgeframe.functions import clean
from nudgeframe.plans.sizing import spread, tasks_for

_BASE = "1997-01-01 00:00:00"
PINNED = "1998-06-30T00:00:00"
PINNED_SQL = "timestamp '1998-06-30 00:00:00'"


class Study:
    """Lazy views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _days(column):
        return F.make_dt_interval(column.cast("int"))

    @property
    def clients(self) -> DataFrame:
        key = F.col("c_custkey")
        issue = F.when(key % 41 == 7, None).otherwise(
            clean.timestamp_literal(_BASE) + self._days((key * 37) % 1000)
        )
        gender = (
            F.when(key % 5 == 0, "F").when(key % 5 == 1, "M").when(key % 5 == 2, "u")
            .when(key % 5 == 3, None).otherwise("X")
        )
        return self.raw("customer").select(
            key.cast("string").alias("client_id"),
            issue.alias("first_issue_date"),
            F.when(key % 3 == 0, None).otherwise(issue + self._days(key % 90)).alias("first_redeem_date"),
            F.when(key % 29 == 3, None).otherwise((8 + (key * 13) % 100).cast("double")).alias("age"),
            gender.alias("gender"),
        )

    @property
    def purchases(self) -> DataFrame:
        key = F.col("o_orderkey")
        orders = self.raw("orders").select(
            key,
            F.col("o_custkey").cast("string").alias("client_id"),
            key.cast("string").alias("transaction_id"),
            F.col("o_orderdate").alias("transaction_datetime"),
            (key % 97).cast("double").alias("regular_points_received"),
            (key % 11).cast("double").alias("express_points_received"),
            F.when(key % 4 == 0, key % 53).otherwise(0).cast("double").alias("regular_points_spent"),
            F.when(key % 9 == 0, key % 7).otherwise(0).cast("double").alias("express_points_spent"),
            F.col("o_totalprice").alias("purchase_sum"),
        )
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_suppkey").cast("string").alias("store_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_quantity").alias("product_quantity"),
        )
        tasks = tasks_for(lines)
        lines, orders = (spread(side, "o_orderkey", tasks=tasks) for side in (lines, orders))
        return lines.join(orders, "o_orderkey").drop("o_orderkey")

    @property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.cast("string").alias("product_id"),
            F.when(key % 31 == 0, None).otherwise(F.col("p_type")).alias("level_1"),
            F.col("p_size").alias("segment_id"),
            F.col("p_brand").alias("brand_id"),
            (key % 7 == 0).cast("int").alias("is_own_trademark"),
            (key % 11 == 0).cast("int").alias("is_alcohol"),
        )

    @property
    def scores(self) -> DataFrame:
        """Train rows with a deterministic score as the uplift column."""
        key = F.col("c_custkey")
        arm = (F.substring(F.md5(F.concat(key.cast("string"), F.lit(":t"))), 1, 1) < "8").cast("int")
        return (
            self.raw("customer")
            .filter(key % 5 != 0)
            .select(
                key.cast("string").alias("client_id"),
                arm.alias("treatment_flg"),
                (F.col("c_acctbal") > 5500 - 1500 * arm).cast("int").alias("target"),
                clean.rounded(F.col("c_acctbal") / F.lit(10000.0) - F.lit(0.3), 2).alias("uplift"),
            )
        )

    @property
    def train(self) -> DataFrame:
        return self.scores.drop("uplift")

    @property
    def scoring(self) -> DataFrame:
        return self.raw("customer").filter(F.col("c_custkey") % 5 == 0).select(
            F.col("c_custkey").cast("string").alias("client_id")
        )

    @property
    def model_scores(self) -> DataFrame:
        """Four rankings per customer; the last covers half of the customers."""
        unit = clean.hash_uniform(F.col("client_id"), "m")
        ranked = F.array(
            F.struct(F.lit("m1").alias("run_id"), F.col("uplift").alias("uplift")),
            F.struct(F.lit("m2").alias("run_id"), clean.rounded(F.col("uplift") * 0.7 + unit * 0.2, 3).alias("uplift")),
            F.struct(F.lit("m3").alias("run_id"), (-F.col("uplift")).alias("uplift")),
            F.struct(
                F.lit("m4").alias("run_id"),
                F.when(unit < 0.5, clean.rounded(unit, 4)).alias("uplift"),
            ),
        )
        return (
            self.scores.withColumn("r", F.explode(ranked))
            .select("r.run_id", "client_id", "treatment_flg", "target", "r.uplift")
            .filter(F.col("uplift").isNotNull())
        )

    @property
    def arm_scores(self) -> DataFrame:
        """Scores with response probabilities under treatment and control."""
        base = clean.rounded(clean.hash_uniform(F.col("client_id"), "p"), 4)
        return self.scores.withColumn("p_control", base).withColumn(
            "p_treated", clean.rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.col("uplift"))), 4)
        )

    @property
    def trials(self) -> DataFrame:
        """One trial record per order; a customer is an experiment."""
        key = F.col("o_orderkey")
        family = F.element_at(
            F.array(*[F.lit(v) for v in FAMILIES]), (key % 5 + 1).cast("int")
        )
        estimator = F.element_at(
            F.array(*[F.lit(v) for v in ESTIMATORS]), (F.floor(key / 5) % 5 + 1).cast("int")
        )
        hypothesis = (
            F.when(key % 13 == 0, F.lit("manual_baseline"))
            .when(key % 11 == 0, F.concat(F.lit("h"), (key % 7).cast("string"), F.lit("__tune_p1_s42")))
            .when(key % 17 == 0, F.concat(F.lit("agentic_tune__h"), (key % 7).cast("string")))
            .otherwise(F.concat(F.lit("h"), (key % 7).cast("string")))
        )
        qini = F.when(key % 23 == 0, None).otherwise(((key * 7919) % 1000) / F.lit(4000.0) - F.lit(0.03))
        return self.raw("orders").select(
            F.col("o_custkey").cast("string").alias("experiment_id"),
            key.alias("seq"),
            F.concat(F.lit("r"), key.cast("string")).alias("run_id"),
            hypothesis.alias("hypothesis_id"),
            F.when(key % 19 == 0, "failed").otherwise("success").alias("status"),
            F.concat_ws("_", family, estimator).alias("template_name"),
            family.alias("uplift_learner_family"),
            estimator.alias("base_estimator"),
            F.concat(F.lit("rec"), (key % 3).cast("string")).alias("feature_recipe_id"),
            F.substring(F.md5((key % 6).cast("string")), 1, 8).alias("params_hash"),
            F.element_at(F.array(F.lit(42), F.lit(7), F.lit(99)), (key % 3 + 1).cast("int")).alias("split_seed"),
            qini.alias("qini_auc"),
            F.when(key % 29 == 0, None)
            .otherwise(((key * 104729) % 1000) / F.lit(2500.0) - F.lit(0.05))
            .alias("normalized_qini_auc"),
            (((key * 1299709) % 1000) / F.lit(8000.0)).alias("uplift_auc"),
            F.when(key % 7 == 0, None)
            .otherwise(((key * 15485863) % 1000) / F.lit(3000.0))
            .alias("held_out_normalized_qini_auc"),
            F.create_map(
                F.lit("top_10pct_zero_cost"), ((key * 31) % 101).cast("double") - F.lit(20.0),
                F.lit("top_20pct_zero_cost"), ((key * 37) % 101).cast("double") - F.lit(20.0),
                F.lit("top_10pct_low_cost"), ((key * 41) % 101).cast("double") - F.lit(30.0),
                F.lit("top_20pct_low_cost"), F.when(key % 5 == 0, None).otherwise(((key * 43) % 101).cast("double") - F.lit(30.0)),
            ).alias("policy_gain"),
        )

    @property
    def hypotheses(self) -> DataFrame:
        """Append-only snapshots: one per order, seven ids per customer."""
        key = F.col("o_orderkey")
        states = F.array(*[F.lit(v) for v in HYPOTHESIS_STATES])
        actions = F.array(*[F.lit(v) for v in WAVE_ACTIONS])
        return self.raw("orders").select(
            key.alias("seq"),
            F.concat_ws("-", F.col("o_custkey").cast("string"), (key % 3).cast("string")).alias("hypothesis_id"),
            F.element_at(states, (key % 5 + 1).cast("int")).alias("status"),
            F.element_at(actions, (key % 4 + 1).cast("int")).alias("action_type"),
            F.array(F.concat(F.lit("r"), key.cast("string")), F.concat(F.lit("r"), (key + 1).cast("string"))).alias("trial_ids"),
        )

    @property
    def waves(self) -> DataFrame:
        """One wave per customer; most list two of the customer's trials and name the later one champion."""
        key = F.col("c_custkey")
        own = self.raw("orders").filter("o_orderkey % 3 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")
        )
        first, last = (F.concat(F.lit("r"), F.col(c).cast("string")) for c in ("lo", "hi"))
        none = F.array().cast("array<string>")
        return self.raw("customer").join(own, "c_custkey", "left").select(
            key.cast("string").alias("experiment_id"),
            F.concat(F.lit("w"), key.cast("string")).alias("wave_id"),
            F.when(key % 17 == 0, "blocked").when(key % 19 == 0, "failed").otherwise("completed").alias("status"),
            F.when(key % 23 == 0, "leakage").alias("blocked_reason"),
            (key % 29 == 0).alias("compute_exhausted"),
            F.when(key % 13 == 0, F.array().cast("array<string>"))
            .when(key % 2 == 0, F.array(F.lit("window_sweep"), F.lit("ranking_stability_check")))
            .otherwise(F.array(F.lit("recipe_comparison")))
            .alias("valid_next_actions"),
            (key % 4).cast("int").alias("champion_stability_runs"),
            (key % 6 == 0).alias("policy_threshold_stable"),
            F.when(key % 3 == 0, key % 2 == 0).alias("robustness_stable"),
            F.when((key % 5 == 0) | F.col("lo").isNull(), none)
            .when(F.col("lo") == F.col("hi"), F.array(first))
            .otherwise(F.array(first, last))
            .alias("trial_ids"),
            F.when(key % 11 == 0, "elsewhere").when(key % 7 != 0, last).alias("champion_run_id"),
        )


# Fixed values used by the derived trial and hypothesis views.
FAMILIES = ("random", "response_model", "two_model", "solo_model", "class_transformation")
ESTIMATORS = ("logistic_regression", "gradient_boosting", "random_forest", "xgboost", "custom")
HYPOTHESIS_STATES = ("proposed", "under_test", "supported", "contradicted", "inconclusive")
WAVE_ACTIONS = ("recipe_comparison", "window_sweep", "feature_ablation", "cost_sensitivity")


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_VIEWS = {
    "clients": """
      select cast(c_custkey as varchar) as client_id, iss as first_issue_date,
        case when c_custkey % 3 = 0 then null else iss + to_days(cast(c_custkey % 90 as integer)) end as first_redeem_date,
        case when c_custkey % 29 = 3 then null else cast(8 + (c_custkey * 13) % 100 as double) end as age,
        case c_custkey % 5 when 0 then 'F' when 1 then 'M' when 2 then 'u' when 3 then null else 'X' end as gender
      from (select c_custkey, case when c_custkey % 41 = 7 then null
              else timestamp '1997-01-01 00:00:00' + to_days(cast((c_custkey * 37) % 1000 as integer)) end as iss
            from customer)""",
    "purchases": """
      select cast(o_custkey as varchar) as client_id, cast(o_orderkey as varchar) as transaction_id,
        o_orderdate as transaction_datetime,
        cast(o_orderkey % 97 as double) as regular_points_received,
        cast(o_orderkey % 11 as double) as express_points_received,
        cast(case when o_orderkey % 4 = 0 then o_orderkey % 53 else 0 end as double) as regular_points_spent,
        cast(case when o_orderkey % 9 = 0 then o_orderkey % 7 else 0 end as double) as express_points_spent,
        o_totalprice as purchase_sum, cast(l_suppkey as varchar) as store_id,
        cast(l_partkey as varchar) as product_id, l_quantity as product_quantity
      from lineitem join orders on l_orderkey = o_orderkey""",
    "products": """
      select cast(p_partkey as varchar) as product_id,
        case when p_partkey % 31 = 0 then null else p_type end as level_1,
        p_size as segment_id, p_brand as brand_id,
        cast(p_partkey % 7 = 0 as integer) as is_own_trademark, cast(p_partkey % 11 = 0 as integer) as is_alcohol
      from part""",
    "scores": """
      select client_id, treatment_flg, cast(c_acctbal > 5500 - 1500 * treatment_flg as integer) as target,
        round(c_acctbal / 10000.0::double - 0.3::double, 2) as uplift
      from (select cast(c_custkey as varchar) as client_id, c_acctbal,
              cast(substr(md5(concat(c_custkey, ':t')), 1, 1) < '8' as integer) as treatment_flg
            from customer where c_custkey % 5 <> 0)""",
    "train": "select client_id, treatment_flg, target from scores",
    "scoring": "select cast(c_custkey as varchar) as client_id from customer where c_custkey % 5 = 0",
    "hashed": """
      select *, cast(('0x' || substr(md5(concat(client_id, ':m')), 1, 7)) as bigint)::double / 268435456.0::double as unit
      from scores""",
    "model_scores": """
      select * from (
        select 'm1' as run_id, client_id, treatment_flg, target, uplift from hashed union all
        select 'm2', client_id, treatment_flg, target, round(uplift * 0.7::double + unit * 0.2::double, 3) from hashed union all
        select 'm3', client_id, treatment_flg, target, -uplift from hashed union all
        select 'm4', client_id, treatment_flg, target, round(unit, 4) from hashed where unit < 0.5)""",
    "arm_scores": """
      select client_id, treatment_flg, target, uplift, p_control,
        round(least(1.0::double, greatest(0.0::double, p_control + uplift)), 4) as p_treated
      from (select *, round(cast(('0x' || substr(md5(concat(client_id, ':p')), 1, 7)) as bigint)::double
                            / 268435456.0::double, 4) as p_control from scores)""",
    "trials": f"""
      select *, fam || '_' || est as template_name, fam as uplift_learner_family, est as base_estimator from (
      select cast(o_custkey as varchar) as experiment_id, o_orderkey as seq, 'r' || o_orderkey as run_id,
        case when o_orderkey % 13 = 0 then 'manual_baseline'
             when o_orderkey % 11 = 0 then 'h' || (o_orderkey % 7) || '__tune_p1_s42'
             when o_orderkey % 17 = 0 then 'agentic_tune__h' || (o_orderkey % 7)
             else 'h' || (o_orderkey % 7) end as hypothesis_id,
        case when o_orderkey % 19 = 0 then 'failed' else 'success' end as status,
        {_sql_list(FAMILIES)}[cast(o_orderkey % 5 + 1 as integer)] as fam,
        {_sql_list(ESTIMATORS)}[cast((o_orderkey // 5) % 5 + 1 as integer)] as est,
        'rec' || (o_orderkey % 3) as feature_recipe_id,
        substr(md5(cast(o_orderkey % 6 as varchar)), 1, 8) as params_hash,
        [42, 7, 99][cast(o_orderkey % 3 + 1 as integer)] as split_seed,
        case when o_orderkey % 23 = 0 then null else ((o_orderkey * 7919) % 1000) / 4000.0::double - 0.03::double end as qini_auc,
        case when o_orderkey % 29 = 0 then null else ((o_orderkey * 104729) % 1000) / 2500.0::double - 0.05::double end as normalized_qini_auc,
        ((o_orderkey * 1299709) % 1000) / 8000.0::double as uplift_auc,
        case when o_orderkey % 7 = 0 then null else ((o_orderkey * 15485863) % 1000) / 3000.0::double end as held_out_normalized_qini_auc,
        o_orderkey
      from orders)""",
    "gains": """
      select experiment_id, seq, run_id, status, pos, key, gain from (
        select *, 0 as pos, 'top_10pct_zero_cost' as key, cast((o_orderkey * 31) % 101 as double) - 20.0::double as gain from trials union all
        select *, 1, 'top_20pct_zero_cost', cast((o_orderkey * 37) % 101 as double) - 20.0::double from trials union all
        select *, 2, 'top_10pct_low_cost', cast((o_orderkey * 41) % 101 as double) - 30.0::double from trials union all
        select *, 3, 'top_20pct_low_cost', case when o_orderkey % 5 = 0 then null else cast((o_orderkey * 43) % 101 as double) - 30.0::double end from trials)""",
    "hypotheses": f"""
      select o_orderkey as seq, o_custkey || '-' || (o_orderkey % 3) as hypothesis_id,
        {_sql_list(HYPOTHESIS_STATES)}[cast(o_orderkey % 5 + 1 as integer)] as status,
        {_sql_list(WAVE_ACTIONS)}[cast(o_orderkey % 4 + 1 as integer)] as action_type,
        ['r' || o_orderkey, 'r' || (o_orderkey + 1)] as trial_ids
      from orders""",
    "waves": """
      select cast(c_custkey as varchar) as experiment_id, 'w' || c_custkey as wave_id,
        case when c_custkey % 17 = 0 then 'blocked' when c_custkey % 19 = 0 then 'failed' else 'completed' end as status,
        case when c_custkey % 23 = 0 then 'leakage' end as blocked_reason,
        c_custkey % 29 = 0 as compute_exhausted,
        case when c_custkey % 13 = 0 then [] when c_custkey % 2 = 0 then ['window_sweep', 'ranking_stability_check']
             else ['recipe_comparison'] end as valid_next_actions,
        cast(c_custkey % 4 as integer) as champion_stability_runs,
        c_custkey % 6 = 0 as policy_threshold_stable,
        case when c_custkey % 3 = 0 then c_custkey % 2 = 0 end as robustness_stable,
        case when c_custkey % 5 = 0 or lo is null then [] when lo = hi then ['r' || lo] else ['r' || lo, 'r' || hi] end as trial_ids,
        case when c_custkey % 11 = 0 then 'elsewhere' when c_custkey % 7 <> 0 then 'r' || hi end as champion_run_id
      from customer left join (select o_custkey as c_custkey, min(o_orderkey) as lo, max(o_orderkey) as hi from orders
        where o_orderkey % 3 <> 0 group by all) using (c_custkey)""",
}

_NEEDS = {
    "train": ("scores",),
    "hashed": ("scores",),
    "model_scores": ("hashed",),
    "arm_scores": ("scores",),
    "gains": ("trials",),
}


def with_views(names: str, body: str) -> str:
    """Prefix a SQL body with the named study views (and what they need)."""
    ordered: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{name} as ({SQL_VIEWS[name]})" for name in ordered)
    body = body.strip()
    glue = ",\n" + body[len("with ") :] if body.lower().startswith("with ") else "\n" + body
    return f"with {ctes}{glue}"
