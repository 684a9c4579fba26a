"""Alternative feature modes, data quality and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nudgeframe.catalog.feature_queries import client_sql
from nudgeframe.catalog.registry import Area
from nudgeframe.functions import clean
from nudgeframe.operators import facts, feature_modes, features, profile, quality

AREA = Area()

INGEST_SQL = """
    with h as (select p.*, c.first_issue_date as iss from purchases p join train using (client_id)
        join clients c using (client_id) where transaction_datetime < c.first_issue_date),
    r as (select client_id, min(transaction_datetime) as f, max(transaction_datetime) as l,
        count(distinct transaction_id) as n, round(sum(purchase_sum), 6) as ms, count(purchase_sum) as k,
        count(distinct store_id) as st, count(distinct product_id) as pr, round(sum(product_quantity), 6) as q,
        count(product_quantity) as kq from h group by client_id),
    ingest as (select t.client_id, coalesce(n, 0) as frequency, coalesce(ms, 0.0) as monetary_total,
        coalesce(round(ms / k, 6), 0.0) as monetary_avg, coalesce(st, 0) as n_stores_visited,
        coalesce(pr, 0) as n_unique_products, coalesce(round(q / kq, 6), 0.0) as avg_qty_per_tx,
        coalesce(floor((epoch_us(c.first_issue_date) - epoch_us(l)) / 86400000000.0::double), -1.0) as recency_days,
        coalesce(floor((epoch_us(l) - epoch_us(f)) / 86400000000.0::double), 0.0) as purchase_span_days,
        cast(l is not null as integer) as has_purchase_history,
        t.treatment_flg, t.target, c.age,
        case c.gender when 'M' then 1 when 'F' then 0 else -1 end as gender
      from train t left join clients c using (client_id) left join r using (client_id))"""


@AREA.query("ingest_mode_features", "clients train purchases", INGEST_SQL + " select * from ingest")
def ingest_mode_features(study):
    return feature_modes.ingest_modeling_table(study.train, study.clients, study.purchases)


@AREA.query(
    "token_mode_features",
    "clients purchases",
    """with ref as (select max(transaction_datetime) as ref from purchases),
    p as (select client_id, cast(floor((epoch_us(max(ref)) - epoch_us(max(transaction_datetime))) / 86400000000.0::double) as bigint) as r,
        count(transaction_datetime) as n, round(sum(purchase_sum), 6) as ms,
        count(*) filter (where transaction_datetime >= ref - to_days(60)) as f60, count(purchase_sum) as k
      from purchases, ref group by client_id)
    select client_id as customer_id, coalesce(age, 0.0) as age, coalesce(cast(gender = 'F' as integer), 0) as "gender_F",
      coalesce(cast(gender = 'M' as integer), 0) as "gender_M", coalesce(cast(gender = 'X' as integer), 0) as "gender_X",
      coalesce(cast(gender = 'u' as integer), 0) as gender_u, coalesce(r, 0) as recency_days, coalesce(n, 0) as frequency,
      coalesce(ms, 0.0) as monetary_total, coalesce(f60, 0) as freq_60d, coalesce(round(ms / k, 6), 0.0) as avg_basket_size
    from clients left join p using (client_id)""",
)
def token_mode_features(study):
    recipe = "rfm+demographic+purchase_frequency_60d+basket"
    return feature_modes.token_features(recipe, study.clients, study.purchases, "gender")


def _notebook_block(suffix: str, days: int | None) -> str:
    where = "" if days is None else f"where dt >= ref - to_days({days})"
    return f"""
    n_{suffix} as (select client_id, count(*) as n, round(sum(ps), 6) as ps, round(sum(q), 6) as q, max(dt) as l,
        round(sum(pr), 6) as pr, round(sum(psp), 6) as psp from tx, ref {where} group by client_id),
    m_{suffix} as (select t.client_id, coalesce(n, 0) as txn_count_{suffix}, coalesce(round(ps, 4), 0.0) as purchase_sum_{suffix},
        coalesce(round(ps / n, 4), 0.0) as avg_txn_{suffix}, coalesce(round(q, 4), 0.0) as basket_qty_{suffix},
        coalesce(round((epoch_us(ref) - epoch_us(l)) / 86400000000.0::double, 2), -1.0) as recency_days_{suffix},
        coalesce(round(pr, 4), 0.0) as pts_recv_{suffix}, coalesce(round(psp, 4), 0.0) as pts_spent_{suffix},
        coalesce(round(pr / case when ps > 0 then ps end, 4), 0.0) as pts_recv_ratio_{suffix},
        coalesce(round(psp / case when ps > 0 then ps end, 4), 0.0) as pts_spent_ratio_{suffix}
      from train t left join n_{suffix} using (client_id), ref)"""


def _notebook_sql() -> str:
    from nudgeframe.catalog.feature_queries import tx_sql

    blocks = ",".join(
        _notebook_block(s, d) for s, d in (("lifetime", None), ("30d", 30), ("60d", 60), ("90d", 90))
    )
    day = 86400000000.0
    return f"""with {tx_sql('>=')}, {blocks},
    d as (select t.client_id, case when age between 14 and 100 then age end as a, upper(coalesce(gender, 'U')) as g,
        first_issue_date as iss, first_redeem_date as red from train t left join clients using (client_id))
    select client_id, coalesce(a, -1.0) as age_clean, cast(a is null as integer) as age_invalid_flag,
      coalesce(cast(a > 0 and a <= 25 as integer), 0) as age_le25, coalesce(cast(a > 25 and a <= 35 as integer), 0) as age_26_35,
      coalesce(cast(a > 35 and a <= 45 as integer), 0) as age_36_45, coalesce(cast(a > 45 and a <= 55 as integer), 0) as age_46_55,
      coalesce(cast(a > 55 and a <= 65 as integer), 0) as age_56_65, coalesce(cast(a > 65 and a <= 200 as integer), 0) as age_gt65,
      cast(g = 'F' as integer) as "gender_F", cast(g = 'M' as integer) as "gender_M", cast(g = 'U' as integer) as "gender_U",
      cast(iss is null as integer) as issue_date_missing,
      coalesce(round((epoch_us(timestamp '2019-03-18 00:00:00') - epoch_us(iss)) / {day}::double, 1), -1.0) as account_age_days,
      cast(red is not null as integer) as has_redeemed,
      coalesce(round((epoch_us(red) - epoch_us(iss)) / {day}::double, 1), -1.0) as days_to_first_redeem,
      m_lifetime.* exclude (client_id), m_30d.* exclude (client_id), m_60d.* exclude (client_id), m_90d.* exclude (client_id)
    from d join m_lifetime using (client_id) join m_30d using (client_id) join m_60d using (client_id) join m_90d using (client_id)"""


@AREA.query("notebook_mode_features", "clients train purchases", _notebook_sql())
def notebook_mode_features(study):
    return feature_modes.notebook_features(study.train.select("client_id"), study.clients, study.purchases)


def _tables(study):
    return {
        "clients": study.clients,
        "train": study.train,
        "scoring": study.scoring,
        "purchases": study.purchases,
        "products": study.products,
    }


_TABLE_COLUMNS = {
    "clients": ("client_id", "first_issue_date", "first_redeem_date", "age", "gender"),
    "train": ("client_id", "treatment_flg", "target"),
    "scoring": ("client_id",),
    "purchases": (
        "client_id", "transaction_id", "transaction_datetime", "regular_points_received", "express_points_received",
        "regular_points_spent", "express_points_spent", "purchase_sum", "store_id", "product_id", "product_quantity",
    ),
    "products": ("product_id", "level_1", "segment_id", "brand_id", "is_own_trademark", "is_alcohol"),
}


def _null_sql(table: str, column: str) -> str:
    return (
        f"select '{table}' as table_name, '{column}' as column_name, "
        f"round(avg(cast({column} is null as integer)), 6) as null_rate from {table}"
    )


ALL_VIEWS = "clients train scoring purchases products"


@AREA.query(
    "null_rates", ALL_VIEWS, " union all ".join(_null_sql(t, c) for t, cols in _TABLE_COLUMNS.items() for c in cols)
)
def null_rates(study):
    return quality.null_rates(_tables(study))


@AREA.query(
    "row_counts",
    ALL_VIEWS,
    " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in _TABLE_COLUMNS),
)
def row_counts(study):
    return quality.row_counts(_tables(study))


def _coverage_sql(left: str) -> str:
    return (
        f"select round(count(*) filter (where client_id in (select client_id from clients))::double / count(*), 6)"
        f" from (select distinct client_id from {left} where client_id is not null)"
    )


@AREA.query(
    "join_coverage",
    ALL_VIEWS,
    " union all ".join(
        f"select '{t}_in_clients' as pair, ({_coverage_sql(t)}) as coverage" for t in ("train", "scoring", "purchases")
    )
    + " union all select 'purchases_in_train', (select round(count(*) filter (where client_id in (select client_id from train))::double / count(*), 6)"
    " from (select distinct client_id from purchases))",
)
def join_coverage(study):
    pairs = {f"{t}_in_clients": (getattr(study, t), study.clients) for t in ("train", "scoring", "purchases")}
    pairs["purchases_in_train"] = (study.purchases, study.train)
    return quality.join_coverage(pairs)


@AREA.query(
    "label_counts",
    "train",
    """select 'treatment_flg' as column_name, cast(treatment_flg as varchar) as value, count(*) as n from train group by treatment_flg
    union all select 'target', cast(target as varchar), count(*) from train group by target""",
)
def label_counts(study):
    return quality.label_counts(study.train)


def _checks_sql() -> str:
    def row(check, table, column, value, severity):
        column = "cast(null as varchar)" if column is None else f"'{column}'"
        return (
            f"select '{check}' as \"check\", '{table}' as table_name, {column} as column_name, "
            f"cast(({value}) as double) as value, {severity} as severity"
        )

    rows = []
    for table, cols in (
        ("clients", ("client_id",)),
        ("train", ("client_id", "treatment_flg", "target")),
        ("scoring", ("client_id",)),
        ("purchases", ("client_id", "transaction_id", "transaction_datetime", "purchase_sum")),
    ):
        rows += [row("missing_required_column", table, c, "0", "'ok'") for c in cols]
    rows += [row("label_in_scoring", "scoring", c, "0", "'ok'") for c in ("target", "treatment_flg")]
    rows += [row("row_count", t, None, f"select count(*) from {t}", "'info'") for t in _TABLE_COLUMNS]
    for t in ("train", "scoring"):
        value = f"select count(*) - count(distinct client_id) from {t}"
        rows.append(row("duplicate_keys", t, "client_id", value, f"case when ({value}) > 0 then 'error' else 'ok' end"))
    value = "select count(distinct client_id) from train where client_id in (select client_id from scoring)"
    rows.append(row("train_scoring_overlap", "train", "client_id", value, f"case when ({value}) > 0 then 'error' else 'ok' end"))
    for c in ("treatment_flg", "target"):
        value = f"select count(*) from train where {c} not in (0, 1)"
        rows.append(row("non_binary_label", "train", c, value, f"case when ({value}) > 0 then 'error' else 'ok' end"))
    rows += [row("coverage_in_clients", t, "client_id", _coverage_sql(t), "'info'") for t in ("train", "scoring", "purchases")]
    for t, cols in quality.NULL_CHECK_COLUMNS.items():
        for c in cols:
            if c in _TABLE_COLUMNS[t]:
                value = f"select round(avg(cast({c} is null as integer)), 6) from {t}"
                rows.append(row("null_rate", t, c, value, f"case when ({value}) > 0.3 then 'warning' else 'ok' end"))
    value = "select round(avg(cast(transaction_datetime is null as integer)), 6) from purchases"
    rows.append(row("unparseable_dates", "purchases", "transaction_datetime", value, f"case when ({value}) > 0 then 'warning' else 'ok' end"))
    return " union all ".join(rows)


@AREA.query("dataset_checks", ALL_VIEWS, _checks_sql())
def dataset_checks(study):
    return quality.dataset_checks(_tables(study))


@AREA.query(
    "dataset_verdict",
    ALL_VIEWS,
    f"""with c as ({_checks_sql()}) select count(*) filter (where severity = 'error') = 0 as valid,
      count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings from c""",
)
def dataset_verdict(study):
    return quality.report_verdict(quality.dataset_checks(_tables(study)))


@AREA.query(
    "feature_table_checks",
    "clients train scoring",
    """with f as (select client_id from clients where client_id not like '%7'), e as (select client_id from train),
    rows(c, col, v) as (values ('missing_key', 'client_id', 0::double), ('forbidden_columns', 'target', 1), ('train_only_columns', 'target', 1)),
    g as (select 'duplicate_keys' as c, 'client_id' as col, (select count(*) - count(distinct client_id) from f)::double as v
      union all select 'missing_ids', 'client_id', (select count(*) from e where client_id not in (select client_id from f))::double
      union all select 'extra_ids', 'client_id', (select count(*) from f where client_id not in (select client_id from e))::double)
    select c as "check", 'features' as table_name, col as column_name, v as value, case when v > 0 then 'error' else 'ok' end as severity
    from (select * from rows union all select * from g)""",
)
def feature_table_checks(study):
    # A deliberately faulty table: ids dropped and added, a label column kept.
    table = features.client_features(study.clients, study.clients).filter(~F.col("client_id").endswith("7"))
    table = table.withColumn("target", F.lit(0))
    return quality.feature_table_checks(table, study.train, train_only=study.train.columns)


@AREA.query(
    "modeling_table_checks",
    "clients train purchases",
    INGEST_SQL
    + """, x as (select 'duplicate_keys' as c, 'client_id' as col, (select count(*) - count(distinct client_id) from ingest)::double as v, 'error' as bad
      union all select 'invalid_label', 'target', (select count(*) from ingest where target is null or target not in (0, 1))::double, 'error'
      union all select 'invalid_label', 'treatment_flg', (select count(*) from ingest where treatment_flg is null or treatment_flg not in (0, 1))::double, 'error'
      union all select 'redeem_columns', null, 0::double, 'error')
    select c as "check", 'modeling' as table_name, col as column_name, v as value, case when v > 0 then bad else 'ok' end as severity from x
    union all select 'null_rate', 'modeling', col, v, case when v > 0.05 then 'warning' else 'ok' end from ("""
    + " union all ".join(
        f"select '{c}' as col, round(avg(cast({c} is null as integer)), 6) as v from ingest"
        for c in (
            "age", "gender", "frequency", "monetary_total", "monetary_avg", "n_stores_visited", "n_unique_products",
            "avg_qty_per_tx", "recency_days", "purchase_span_days", "has_purchase_history",
        )
    )
    + ")",
)
def modeling_table_checks(study):
    table = feature_modes.ingest_modeling_table(study.train, study.clients, study.purchases)
    return quality.modeling_table_checks(table)


@AREA.query(
    "submission_checks",
    "clients train scoring",
    """with s as (select client_id from scoring where client_id not like '%5'),
    x as (select 'wrong_columns' as c, cast(null as varchar) as col, 0::double as v union all select 'score_not_numeric', 'uplift', 0::double
      union all select 'row_count_gap', null, abs((select count(*) from s) - (select count(*) from scoring))::double
      union all select 'duplicate_keys', 'client_id', (select count(*) - count(distinct client_id) from s)::double
      union all select 'missing_ids', 'client_id', (select count(*) from scoring where client_id not in (select client_id from s))::double
      union all select 'extra_ids', 'client_id', (select count(*) from s where client_id not in (select client_id from scoring))::double)
    select c as "check", 'submission' as table_name, col as column_name, v as value, case when v > 0 then 'error' else 'ok' end as severity from x""",
)
def submission_checks(study):
    # A deliberately incomplete submission.
    partial = study.scoring.filter(~F.col("client_id").endswith("5"))
    submission = partial.select("client_id", clean.hash_uniform(F.col("client_id"), "s").alias("uplift"))
    return quality.submission_checks(submission, study.scoring)


@AREA.query(
    "id_set_differences",
    "train purchases",
    """with e as (select distinct client_id from train), o as (select distinct client_id from purchases)
    select (select count(*) from e where client_id not in (select client_id from o)) as missing_ids,
      (select count(*) from o where client_id not in (select client_id from e)) as extra_ids,
      (select count(*) from o where client_id in (select client_id from e)) as shared_ids""",
)
def id_set_differences(study):
    return quality.id_differences(study.train, study.purchases)


@AREA.query(
    "cohort_union",
    "train scoring",
    "select client_id from train union all select client_id from scoring",
)
def cohort_union(study):
    return facts.cohort_ids(study.train, study.scoring, "all")


@AREA.query(
    "arm_response_ate",
    "train",
    """select *, round(treated_target_rate - control_target_rate, 6) as average_treatment_effect from (
      select count(*) filter (where treatment_flg = 1) as treated_rows, count(*) filter (where treatment_flg = 0) as control_rows,
      round(avg(case when treatment_flg = 1 then target end), 6) as treated_target_rate,
      round(avg(case when treatment_flg = 0 then target end), 6) as control_target_rate from train)""",
)
def arm_response_ate(study):
    return quality.arm_response(study.train)


@AREA.query(
    "joint_counts",
    "train",
    "select treatment_flg || ':' || target as joint_key, count(*) as n from train group by treatment_flg, target",
)
def joint_counts(study):
    return quality.joint_counts(study.train)


BALANCE_COLUMNS = ["age_clean", "age_invalid_flag", "issue_year", "issue_month", "gender_F", "gender_M", "gender_U", "gender_other"]


@AREA.query(
    "balance_smd",
    "clients train",
    f"with {client_sql()}, j as (select * from demo join train using (client_id)), l as ("
    + " union all ".join(f"select '{c}' as feature, treatment_flg, \"{c}\"::double as v from j" for c in BALANCE_COLUMNS)
    + """), s as (select feature, avg(v) filter (where treatment_flg = 1) as m1, avg(v) filter (where treatment_flg = 0) as m0,
        var_pop(v) filter (where treatment_flg = 1) as v1, var_pop(v) filter (where treatment_flg = 0) as v0 from l group by feature),
    d as (select feature, coalesce(abs((m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0)), 0) as d from s)
    select feature, round(d, 6) as smd, d > 0.1 as imbalanced from d""",
)
def balance_smd(study):
    return quality.balance_smd(study.train, features.client_features(study.train, study.clients), BALANCE_COLUMNS)


@AREA.query(
    "treatment_target_cube",
    "train",
    "select treatment_flg, target, count(*) as n from train group by cube (treatment_flg, target)",
)
def treatment_target_cube(study):
    return quality.treatment_target_cube(study.train)


@AREA.query(
    "segment_response",
    "clients train",
    """with j as (select treatment_flg, target, gender, case when age >= 0 and age <= 25 then '(-0.001, 25.0]' when age > 25 and age <= 35 then '(25.0, 35.0]'
        when age > 35 and age <= 45 then '(35.0, 45.0]' when age > 45 and age <= 55 then '(45.0, 55.0]' when age > 55 and age <= 65 then '(55.0, 65.0]'
        when age > 65 and age <= 200 then '(65.0, 200.0]' end as band from train left join clients using (client_id)),
    l as (select 'gender' as segment_col, coalesce(gender, 'nan') as segment, treatment_flg, target from j
      union all select 'age_band', coalesce(band, 'nan'), treatment_flg, target from j),
    g as (select segment_col, segment, count(*) as n_rows, count(*) filter (where treatment_flg = 1) as treated_rows,
        count(*) filter (where treatment_flg = 0) as control_rows, avg(case when treatment_flg = 1 then target end) as r1,
        avg(case when treatment_flg = 0 then target end) as r0 from l group by segment_col, segment)
    select segment_col, segment, n_rows, treated_rows, control_rows, round(r1, 6) as treated_target_rate,
      round(r0, 6) as control_target_rate, round(r1 - r0, 6) as response_gap
    from g where n_rows >= 2 and r1 is not null and r0 is not null
    order by abs(round(r1 - r0, 6)) desc, segment_col desc, segment limit 10""",
)
def segment_response(study):
    return profile.segment_response(study.train, study.clients)


@AREA.query(
    "purchase_summary",
    "purchases",
    """select count(distinct client_id) as unique_customers, count(distinct transaction_id) as transactions,
      count(distinct product_id) as unique_products, count(distinct store_id) as unique_stores,
      round(avg(purchase_sum), 6) as purchase_sum_mean, round(quantile_cont(purchase_sum, 0.5), 6) as purchase_sum_median,
      round(quantile_cont(purchase_sum, 0.95), 6) as purchase_sum_p95 from purchases""",
)
def purchase_summary(study):
    return profile.purchase_summary(study.purchases)


SUMMARY_COLUMNS = ["age", "gender", "frequency", "monetary_total", "monetary_avg", "avg_qty_per_tx", "recency_days", "purchase_span_days"]


@AREA.query(
    "feature_summary",
    "clients train purchases",
    INGEST_SQL
    + ", l as ("
    + " union all ".join(f"select '{c}' as feature, {c}::double as v from ingest" for c in SUMMARY_COLUMNS)
    + """) select feature, count(v) as non_null_count, count(*) - count(v) as missing_count,
      round((count(*) - count(v)) / count(*)::double, 4) as missing_pct,
      count(distinct v) + max(cast(v is null as integer)) as unique_values, round(avg(v), 6) as mean, round(min(v), 6) as min,
      round(max(v), 6) as max, round(stddev_samp(v), 6) as std, round(quantile_cont(v, 0.25), 6) as p25,
      round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75 from l group by feature""",
)
def feature_summary(study):
    table = feature_modes.ingest_modeling_table(study.train, study.clients, study.purchases)
    return profile.feature_summary(table, SUMMARY_COLUMNS)
