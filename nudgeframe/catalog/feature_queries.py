"""Feature-building queries."""

from __future__ import annotations

from nudgeframe.catalog.inputs import PINNED, PINNED_SQL
from nudgeframe.catalog.registry import Area
from nudgeframe.config import Recipe, recipe_family
from nudgeframe.operators import facts, features

AREA = Area()

CLIENT_SQL = """
    base as (select t.client_id, c.age, upper(coalesce(c.gender, 'U')) as g, c.first_issue_date as iss,
        c.first_redeem_date as red from {cohort} t left join clients c using (client_id)),
    demo as (select client_id, case when age between 14 and 100 then age else -1.0::double end as age_clean,
        case when age between 14 and 100 then 0 else 1 end as age_invalid_flag,
        cast(iss is null as integer) as issue_date_missing_flag,
        cast(coalesce(year(iss), -1) as integer) as issue_year,
        cast(coalesce(month(iss), -1) as integer) as issue_month,
        cast(g = 'F' as integer) as "gender_F", cast(g = 'M' as integer) as "gender_M",
        cast(g = 'U' as integer) as "gender_U", cast(g not in ('F', 'M', 'U') as integer) as gender_other from base),
    ages as (select client_id, coalesce(cast(age between 0 and 25 as integer), 0) as age_le25,
        coalesce(cast(age between 26 and 35 as integer), 0) as age_26_35,
        coalesce(cast(age between 36 and 45 as integer), 0) as age_36_45,
        coalesce(cast(age between 46 and 55 as integer), 0) as age_46_55,
        coalesce(cast(age between 56 and 65 as integer), 0) as age_56_65,
        coalesce(cast(age > 65 as integer), 0) as age_gt65 from base),
    life as (select client_id, case when iss is null then 0.0
          else greatest(floor((epoch_us({ref}) - epoch_us(iss)) / 86400000000.0::double), 0.0) end as account_age_days,
        cast(red is not null as integer) as has_redeemed,
        case when iss is null or red is null then -1.0
          else greatest(floor((epoch_us(red) - epoch_us(iss)) / 86400000000.0::double), 0.0) end as days_to_first_redeem
      from base)"""
LATEST_ISSUE = "(select max(iss) from base)"


def client_sql(cohort: str = "train", ref: str = LATEST_ISSUE) -> str:
    return CLIENT_SQL.format(cohort=cohort, ref=ref)


TX_SQL = """
    tx0 as (select p.client_id, transaction_id, transaction_datetime as dt, max(purchase_sum) as ps,
        sum(product_quantity) as q, max(regular_points_received) + max(express_points_received) as pr,
        max(regular_points_spent) + max(express_points_spent) as psp
      from purchases p join {cohort} using (client_id) join clients c using (client_id)
      where c.first_issue_date is null or transaction_datetime {op} c.first_issue_date
      group by p.client_id, transaction_id, transaction_datetime),
    ref as (select {ref} as ref),
    tx as (select tx0.* from tx0, ref where dt <= ref)"""


def tx_sql(op: str = "<", ref: str = "(select max(dt) from tx0)", cohort: str = "train") -> str:
    return TX_SQL.format(op=op, ref=ref, cohort=cohort)


def block_sql(windows, cohort: str = "train") -> str:
    """CTEs b_<suffix>, one per look-back window, zero-filled for the cohort."""
    parts = []
    for suffix, days in [("lifetime", None), *[(f"{d}d", d) for d in windows]]:
        where = "" if days is None else f"where dt >= ref - to_days({days})"
        parts.append(
            f"""
    a_{suffix} as (select client_id, count(distinct transaction_id) as n, round(sum(ps), 6) as ps, round(sum(q), 6) as q,
        max(dt) as last, round(sum(pr), 6) as pr, round(sum(psp), 6) as psp from tx, ref {where} group by client_id),
    b_{suffix} as (select t.client_id, coalesce(n, 0) as purchase_txn_count_{suffix},
        coalesce(ps, 0.0) as purchase_sum_{suffix}, coalesce(round(ps / nullif(n, 0), 6), 0.0) as avg_transaction_value_{suffix},
        coalesce(q, 0.0) as basket_quantity_{suffix}, coalesce(round(q / nullif(n, 0), 6), 0.0) as avg_basket_quantity_{suffix},
        coalesce(round((epoch_us(ref) - epoch_us(last)) / 86400000000.0::double, 3), -1.0) as recency_days_{suffix},
        coalesce(pr, 0.0) as points_received_total_{suffix}, coalesce(psp, 0.0) as points_spent_total_{suffix},
        coalesce(round(pr / nullif(ps, 0), 6), 0.0) as points_received_to_purchase_ratio_{suffix},
        coalesce(round(psp / nullif(ps, 0), 6), 0.0) as points_spent_to_purchase_ratio_{suffix}
      from {cohort} t left join a_{suffix} using (client_id), ref)"""
        )
    return ",".join(parts)


def blocks_join(windows) -> str:
    return "b_lifetime" + "".join(f" join b_{d}d using (client_id)" for d in windows)


PRODUCT_SQL = """
    pl as (select p.client_id, product_id, product_quantity as q, level_1, segment_id, brand_id,
        coalesce(is_own_trademark, 0) as own, coalesce(is_alcohol, 0) as alc
      from purchases p join train using (client_id) join clients c using (client_id)
        left join products using (product_id), ref
      where (c.first_issue_date is null or transaction_datetime {op} c.first_issue_date) and transaction_datetime <= ref),
    pa as (select client_id, count(distinct product_id) as np, count(distinct level_1) as nl,
        count(distinct segment_id) as ns, count(distinct brand_id) as nb, sum(q) as q, sum(q * own) as o, sum(q * alc) as a
      from pl group by client_id),
    el as (select client_id, -sum(case when s > 0 then s / tot * ln(s / tot) else 0 end) as h from
        (select client_id, level_1, sum(q) as s, sum(sum(q)) over (partition by client_id) as tot from pl group by client_id, level_1)
        group by client_id),
    eb as (select client_id, -sum(case when s > 0 then s / tot * ln(s / tot) else 0 end) as h from
        (select client_id, brand_id, sum(q) as s, sum(sum(q)) over (partition by client_id) as tot from pl group by client_id, brand_id)
        group by client_id),
    pf as (select t.client_id, coalesce(np, 0) as product_unique_count_lifetime, coalesce(nl, 0) as product_level_1_unique_count_lifetime,
        coalesce(ns, 0) as product_segment_unique_count_lifetime, coalesce(nb, 0) as product_brand_unique_count_lifetime,
        coalesce(q, 0.0) as product_purchase_quantity_lifetime,
        coalesce(round(o / nullif(q, 0), 6), 0.0) as own_trademark_quantity_share_lifetime,
        coalesce(round(a / nullif(q, 0), 6), 0.0) as alcohol_quantity_share_lifetime {entropy}
      from train t left join pa using (client_id) {entropy_join})"""


def product_sql(op: str, diversity: bool) -> str:
    return PRODUCT_SQL.format(
        op=op,
        entropy=(
            ", coalesce(round(el.h, 6), 0.0) as product_level_1_entropy_lifetime,"
            " coalesce(round(eb.h, 6), 0.0) as product_brand_entropy_lifetime"
            if diversity
            else ""
        ),
        entropy_join="left join el using (client_id) left join eb using (client_id)" if diversity else "",
    )


def _study_lookup(study, cohort=None):
    cohort = study.train.select("client_id") if cohort is None else cohort
    return cohort, facts.cohort_lookup(cohort, study.clients)


@AREA.query("client_features", "clients train", f"with {client_sql()} select * from demo")
def client_features(study):
    return features.client_features(study.train, study.clients)


@AREA.query(
    "age_buckets", "clients train", f"with {client_sql()} select * from demo join ages using (client_id)"
)
def age_buckets(study):
    return features.client_features(study.train, study.clients, ("demographic", "age_buckets"))


@AREA.query(
    "lifecycle_redeem_features",
    "clients train scoring",
    "with cohort_all as (select client_id from train union all select client_id from scoring), "
    + client_sql("cohort_all")
    + " select * from demo join life using (client_id)",
)
def lifecycle_redeem_features(study):
    cohort = facts.cohort_ids(study.train, study.scoring, "all")
    return features.client_features(cohort, study.clients, ("demographic", "account_lifecycle", "redeem_behavior"))


@AREA.query(
    "collapse_transactions",
    "purchases",
    """select client_id, transaction_id, transaction_datetime, max(purchase_sum) as purchase_sum,
      sum(product_quantity) as product_quantity, max(regular_points_received) as regular_points_received,
      max(express_points_received) as express_points_received, max(regular_points_spent) as regular_points_spent,
      max(express_points_spent) as express_points_spent
    from purchases group by client_id, transaction_id, transaction_datetime""",
)
def collapse_transactions(study):
    return facts.collapse(facts.purchase_lines(study.purchases))


def _rfm(study, policy, windows, reference=None, cohort=None):
    cohort, lookup = _study_lookup(study, cohort)
    reference = reference or facts.reference_date(study.purchases, lookup, policy)
    history = facts.transactions(study.purchases, lookup, policy, reference)
    return features.purchase_features(cohort, history, windows, reference)


@AREA.query(
    "rfm_features_pre_issue",
    "clients train purchases",
    f"with {tx_sql('<')}, {block_sql([30, 90, 365])} select * from {blocks_join([30, 90, 365])}",
)
def rfm_features_pre_issue(study):
    return _rfm(study, "pre_issue_only", (30, 90, 365))


@AREA.query(
    "rfm_features_post_issue",
    "clients train purchases",
    f"with {tx_sql('>=')}, {block_sql([30, 60, 90])} select * from {blocks_join([30, 60, 90])}",
)
def rfm_features_post_issue(study):
    return _rfm(study, "post_issue_history", (30, 60, 90))


@AREA.query(
    "rfm_features_pinned_reference",
    "clients train purchases",
    f"with {tx_sql('>=', PINNED_SQL)}, {block_sql([30, 60, 90])} select * from {blocks_join([30, 60, 90])}",
)
def rfm_features_pinned_reference(study):
    return _rfm(study, "safe_history_until_reference", (30, 60, 90), PINNED)


@AREA.query(
    "rfm_features_scoring",
    "clients scoring purchases",
    f"with {tx_sql('>=', cohort='scoring')}, {block_sql([60], 'scoring')} select * from {blocks_join([60])}",
)
def rfm_features_scoring(study):
    return _rfm(study, "post_issue_history", (60,), cohort=study.scoring)


def _products(study, diversity):
    cohort, lookup = _study_lookup(study)
    return features.product_features(
        cohort, study.purchases, study.products, lookup, "pre_issue_only", None, diversity
    )


def _product_query(op, diversity):
    # The reference date of the lines equals that of the collapsed transactions.
    return f"with {tx_sql(op)}, {product_sql(op, diversity)} select * from pf"


@AREA.query("product_features", "clients train purchases products", _product_query("<", False))
def product_features(study):
    return _products(study, False)


@AREA.query("product_entropy", "clients train purchases products", _product_query("<", True))
def product_entropy(study):
    return _products(study, True)


FULL_RECIPE = Recipe(
    source_tables=("clients", "purchases", "products"),
    feature_groups=(
        "demographic", "age_buckets", "account_lifecycle", "redeem_behavior",
        "rfm", "basket", "points", "product_category", "diversity",
    ),
    windows_days=(30, 90),
    temporal_policy="safe_history_until_reference",
    reference_date=PINNED,
)


@AREA.query(
    "feature_table_full",
    "clients train purchases products",
    (
        f"with {client_sql(ref=PINNED_SQL)}, {tx_sql('>=', PINNED_SQL)}, {block_sql([30, 90])}, "
        f"{product_sql('>=', True)} select * from demo join ages using (client_id) join life using (client_id) "
        f"join {blocks_join([30, 90]).replace('b_lifetime', 'b_lifetime using (client_id)', 1)} join pf using (client_id)"
    ),
)
def feature_table_full(study):
    cohort = facts.cohort_ids(study.train, study.scoring, "train")
    return features.feature_table(FULL_RECIPE, cohort, study.clients, study.purchases, study.products)


@AREA.query(
    "feature_table_shared_scan",
    "clients train purchases",
    f"with {client_sql()}, {tx_sql('>=')}, {block_sql([30, 60, 90])} select * from demo join ages using (client_id) "
    f"join life using (client_id) join {blocks_join([30, 60, 90]).replace('b_lifetime', 'b_lifetime using (client_id)', 1)}",
)
def feature_table_shared_scan(study):
    cohort = facts.cohort_ids(study.train, study.scoring, "train")
    shared = features.shared_transactions(cohort, study.purchases)
    recipe = recipe_family("human_semantic_v1")
    return features.feature_table(recipe, cohort, study.clients, study.purchases, collapsed=shared)
