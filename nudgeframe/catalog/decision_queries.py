"""Split, targeting-policy and segment queries."""

from __future__ import annotations

from nudgeframe.catalog.feature_queries import client_sql
from nudgeframe.catalog.metric_queries import CUTOFFS_SQL, rate_sql, ranked_sql, top_sql
from nudgeframe.catalog.registry import Area
from nudgeframe.operators import features, policy, split

AREA = Area()

# Quotas: proportional shares rounded down; largest remainders take the rest.
SPLIT_SQL = """
    with s0 as (select *, treatment_flg || ':' || target as k, md5(concat(client_id, ':42')) as o from train),
    s1 as (select *, row_number() over (partition by k order by o, client_id) as pos from s0),
    c as (select k, count(*) as n, sum(count(*)) over () as tot from s1 group by k),
    e as (select *, n / tot::double * (tot - ceil(tot * 0.3::double)) as x from c),
    f as (select *, floor(x) as fl, row_number() over (order by floor(x) - x, k) as r,
        (tot - ceil(tot * 0.3::double)) - sum(floor(x)) over () as spare from e),
    q as (select k, n, cast(fl + case when r <= spare then 1 else 0 end as bigint) as tr from f),
    c2 as (select k, tr, n - tr as n, sum(n - tr) over () as tot from q),
    e2 as (select *, n / tot::double * (tot - ceil(tot * 0.5::double)) as x from c2),
    f2 as (select *, floor(x) as fl, row_number() over (order by floor(x) - x, k) as r,
        (tot - ceil(tot * 0.5::double)) - sum(floor(x)) over () as spare from e2),
    q2 as (select k, tr, cast(fl + case when r <= spare then 1 else 0 end as bigint) as va from f2),
    split as (select client_id, treatment_flg, target,
        case when pos <= tr then 'train' when pos <= tr + va then 'validation' else 'test' end as split
      from s1 join q2 using (k))"""


@AREA.query(
    "stratification_decision",
    "train",
    """with j as (select treatment_flg, target, count(*) as n from train group by 1, 2),
    t as (select treatment_flg, sum(n)::bigint as n from j group by 1)
    select (select min(n) from j) as min_joint_stratum, (select min(n) from t) as min_treatment_stratum, 6 as min_stratum_size,
      case when (select min(n) from j) >= 6 then 'joint_treatment_outcome' when (select min(n) from t) >= 6 then 'treatment_only'
           else 'random' end as strategy""",
)
def stratification_decision(study):
    return split.stratification_decision(study.train)


@AREA.query("stratified_split", "train", SPLIT_SQL + " select * from split")
def stratified_split(study):
    return split.stratified_split(study.train)


@AREA.query(
    "split_diagnostics",
    "train",
    SPLIT_SQL
    + """, b as (select treatment_flg, target, split from split union all select treatment_flg, target, 'all' from split),
    s as (select split, count(*) as n_rows, round(avg(treatment_flg), 6) as treatment_rate, round(avg(target), 6) as target_rate,
        round(avg(case when treatment_flg = 1 then target end), 6) as treated_response_rate,
        round(avg(case when treatment_flg = 0 then target end), 6) as control_response_rate,
        count(*) filter (where treatment_flg = 0 and target = 0) as t0_y0, count(*) filter (where treatment_flg = 0 and target = 1) as t0_y1,
        count(*) filter (where treatment_flg = 1 and target = 0) as t1_y0, count(*) filter (where treatment_flg = 1 and target = 1) as t1_y1
      from b group by split),
    w as (select *, least(t0_y0, t0_y1, t1_y0, t1_y1) as min_joint_count, split in ('validation', 'test') as ev,
        (select treatment_rate from s where split = 'all') as tr, (select target_rate from s where split = 'all') as yr from s),
    x as (select * exclude (ev, tr, yr), ev and n_rows < 100 as too_few_rows, ev and abs(treatment_rate - tr) > 0.03::double as treatment_rate_drift,
        ev and abs(target_rate - yr) > 0.03::double as target_rate_drift, ev and min_joint_count < 1 as missing_cell from w)
    select *, not (too_few_rows or treatment_rate_drift or target_rate_drift or missing_cell) as reliable from x""",
)
def split_diagnostics(study):
    return split.split_diagnostics(split.stratified_split(study.train))


@AREA.query(
    "kfold_assignment",
    "train",
    """select client_id, treatment_flg, target, cast((row_number() over (partition by treatment_flg, target
      order by md5(concat(client_id, ':20260501')), client_id) - 1) % 5 + 1 as integer) as fold from train""",
)
def kfold_assignment(study):
    return split.kfold(study.train, 5)


TARGETING_SQL = (
    ranked_sql("model_scores", "run_id")
    + f""", u as (select run_id, cutoff_pct, cutoff, max(n) as n, {rate_sql(top_sql('cutoff'))} as r
      from rk, {CUTOFFS_SQL} group by run_id, cutoff_pct, cutoff),
    v as (select *, greatest(1, ceil(n * cutoff)::bigint) as nt from u),
    pol as (select run_id, cutoff_pct as threshold_pct, nt as n_targeted, round(r, 4) as lift_rate,
        round(r * nt, 2) as incremental_conversions, round(nt * 1.0::double, 2) as total_cost,
        round(r * nt * 10.0::double, 2) as estimated_revenue_lift,
        round((r * nt * 10.0::double - nt * 1.0::double) / (nt * 1.0::double), 3) as roi from v)"""
)


@AREA.query("targeting_policies", "model_scores", TARGETING_SQL + " select * from pol")
def targeting_policies(study):
    return policy.targeting_policies(study.model_scores, by=["run_id"])


@AREA.query(
    "elbow_threshold",
    "model_scores",
    TARGETING_SQL
    + """, d as (select run_id, threshold_pct, coalesce(coalesce(roi, 0) - lead(coalesce(roi, 0)) over (partition by run_id order by threshold_pct), -1e300) as dr from pol),
    o as (select *, row_number() over (partition by run_id order by dr desc, threshold_pct) as i from d)
    select run_id, threshold_pct as elbow_threshold_pct from o where i = 1""",
)
def elbow_threshold(study):
    return policy.elbow_threshold(policy.targeting_policies(study.model_scores, by=["run_id"]), ["run_id"])


@AREA.query(
    "recommended_cutoff",
    "model_scores",
    TARGETING_SQL
    + """, x as (select *, coalesce(roi > 0 and lift_rate is not null, false) as good from pol)
    select run_id, threshold_pct, n_targeted, lift_rate, incremental_conversions, total_cost, estimated_revenue_lift, roi,
      case when good then 'highest positive return' else 'highest lift, no positive return' end as rationale
    from x qualify row_number() over (partition by run_id order by good desc, case when good then roi end desc nulls last, lift_rate desc nulls last, threshold_pct) = 1""",
)
def recommended_cutoff(study):
    return policy.recommended_cutoff(policy.targeting_policies(study.model_scores, by=["run_id"]), ["run_id"])


@AREA.query(
    "budget_targeting",
    "model_scores",
    ranked_sql("model_scores", "run_id")
    + """, b as (select run_id, max(n) as n, 150::bigint as mx,
        count(*) filter (where uplift > 0 and rank <= 150) as nt,
        round(count(*) filter (where uplift > 0 and rank <= 150 and treatment_flg = 1 and target = 1)::double
            / nullif(count(*) filter (where uplift > 0 and rank <= 150 and treatment_flg = 1), 0)
          - count(*) filter (where uplift > 0 and rank <= 150 and treatment_flg = 0 and target = 1)::double
            / nullif(count(*) filter (where uplift > 0 and rank <= 150 and treatment_flg = 0), 0), 6) as r from rk group by run_id)
    select run_id, 300.0::double as budget, mx as max_coupons_affordable, nt as n_targeted, round(nt / n::double, 3) as pct_of_base,
      round(r * nt, 2) as incremental_conversions, round(nt * 2.0::double, 2) as total_cost,
      round(r * nt * 10.0::double, 2) as estimated_revenue_lift,
      round((r * nt * 10.0::double - nt * 2.0::double) / nullif(nt * 2.0::double, 0), 3) as roi from b""",
)
def budget_targeting(study):
    return policy.budget_targeting(study.model_scores, 300.0, coupon_cost=2.0, by=["run_id"])


@AREA.query(
    "score_segments",
    "model_scores",
    """with c as (select run_id, quantile_cont(uplift, 0.9) as h, quantile_cont(uplift, 0.1) as l from model_scores group by run_id),
    g as (select run_id, count(*) as n, count(*) filter (where uplift >= h) as p, count(*) filter (where uplift <= l) as s,
        count(*) filter (where uplift < h and uplift > l) as m from model_scores join c using (run_id) group by run_id)
    select run_id, n as total_customers, p as persuadables, s as sleeping_dogs, n - p - s as middle_ground, m as middle_disjoint,
      round(p / n::double, 3) as persuadable_pct, round(s / n::double, 3) as sleeping_dog_pct from g""",
)
def score_segments(study):
    return policy.segment_summary(study.model_scores, by=["run_id"])


SEGMENT_SQL = """
    with q as (select quantile_cont(uplift, 0.75) as p75 from arm_scores),
    seg as (select a.*, case when uplift >= p75 and p_treated >= 0.40::double and p_control < 0.40::double then 'Persuadable'
        when uplift < 0 and p_control >= 0.40::double and p_treated < 0.40::double then 'Sleeping Dog'
        when p_treated >= 0.40::double and p_control >= 0.40::double then 'Sure Thing'
        when p_treated < 0.25::double and p_control < 0.25::double then 'Lost Cause' else 'Uncertain' end as segment
      from arm_scores a, q)"""


@AREA.query("five_way_segments", "arm_scores", SEGMENT_SQL + " select * from seg")
def five_way_segments(study):
    return policy.five_way_segments(study.arm_scores)


@AREA.query(
    "segment_means",
    "arm_scores",
    SEGMENT_SQL
    + """ select segment, count(*) as customers, round(round(sum(uplift), 6) / count(uplift), 6) as avg_uplift,
      round(round(sum(p_treated), 6) / count(*), 6) as avg_p_treated, round(round(sum(p_control), 6) / count(*), 6) as avg_p_control,
      round(count(*) * 100 / (select count(*) from seg)::double, 1) as pct from seg group by segment""",
)
def segment_means(study):
    return policy.segment_means(policy.five_way_segments(study.arm_scores))


PROFILE_COLUMNS = ["age_clean", "gender_F", "gender_M", "issue_year"]


@AREA.query(
    "segment_profiles",
    "arm_scores clients train",
    SEGMENT_SQL
    + f", {client_sql()} select segment, "
    + ", ".join(f'round(round(sum("{c}"), 6) / count("{c}"), 2) as "{c}"' for c in PROFILE_COLUMNS)
    + " from seg left join demo using (client_id) group by segment",
)
def segment_profiles(study):
    table = features.client_features(study.train, study.clients)
    return policy.segment_profiles(policy.five_way_segments(study.arm_scores), table, PROFILE_COLUMNS)


RANK_TEST_SQL = (
    SEGMENT_SQL
    + f", {client_sql()}, l as ("
    + " union all ".join(
        f"select '{c}' as feature, cast(segment = 'Persuadable' as integer) as a, \"{c}\"::double as v from seg join demo using (client_id)"
        for c in PROFILE_COLUMNS
    )
    + """), r as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0::double as rk,
        count(*) over (partition by feature, v)::double as ties from l where v is not null),
    s as (select feature, sum(a)::double as na, sum(1 - a)::double as nb, sum(a * rk) as rs, round(sum(a * v), 6) as sa,
        round(sum((1 - a) * v), 6) as sb, sum(ties * ties - 1) as tt from r group by feature),
    u as (select *, rs - na * (na + 1) / 2 as u, na + nb as n from s where na > 5 and nb > 5)
    select feature, round(sa / na, 3) as persuadable_mean, round(sb / nb, 3) as others_mean, round(sa / na - sb / nb, 3) as diff,
      round(u, 1) as u_statistic,
      round((greatest(u, na * nb - u) - na * nb / 2 - 0.5::double) / sqrt(nullif(na * nb / 12 * (n + 1 - tt / (n * (n - 1))), 0)), 6) as z
    from u"""
)


@AREA.query("segment_rank_statistics", "arm_scores clients train", RANK_TEST_SQL)
def segment_rank_statistics(study):
    table = features.client_features(study.train, study.clients)
    segmented = policy.five_way_segments(study.arm_scores)
    return policy.segment_rank_test(segmented, table, PROFILE_COLUMNS, with_p=False)


def _erfc_sql() -> str:
    """The same series as ``policy.two_sided_p``, over x and t."""
    series = f"{policy.ERFC[0]}::double"
    for c in policy.ERFC[1:]:
        series = f"({series} * t + {c}::double)"
    return f"case when t * exp({series} - x * x) > 1 then 1.0::double else t * exp({series} - x * x) end"


@AREA.query(
    "segment_rank_test",
    "arm_scores clients train",
    f"""select * exclude (x, t, p), round(p, 5) as p_value, round(p, 5) < 0.05::double as significant
    from (select *, {_erfc_sql()} as p from (select *, 1.0::double / (1.0::double + x / 2) as t
      from (select *, case when z is not null then greatest(z, 0) / sqrt(2.0::double) end as x from ({RANK_TEST_SQL}))))""",
)
def segment_rank_test(study):
    table = features.client_features(study.train, study.clients)
    return policy.segment_rank_test(policy.five_way_segments(study.arm_scores), table, PROFILE_COLUMNS)


GRID = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50)
SCENARIOS = {"zero_cost": 0.0, "low_cost": 0.01, "medium_cost": 0.05}
GRID_SQL = (
    ranked_sql()
    + ", u as (select k.pct, k.c as cutoff, max(n) as n, "
    + rate_sql(top_sql("k.c"))
    + " as r from rk, (values "
    + ", ".join(f"({int(round(c * 100))}, {c}::double)" for c in GRID)
    + ") k(pct, c) group by k.pct, k.c), g as (select pct as cutoff_pct, ceil(n * cutoff)::bigint as n_contacted, round(r, 5) as obs_uplift, scenario, "
    + "round(round(r * ceil(n * cutoff) * 1.0::double - ceil(n * cutoff) * cost, 6), 2) as gain from u, (values "
    + ", ".join(f"('{name}', {cost}::double)" for name, cost in SCENARIOS.items())
    + ") s(scenario, cost))"
)


@AREA.query(
    "gain_pivot",
    "scores",
    GRID_SQL
    + " select cutoff_pct, n_contacted, obs_uplift, "
    + ", ".join(f"max(case when scenario = '{s}' then gain end) as {s}" for s in SCENARIOS)
    + " from g group by all",
)
def gain_pivot(study):
    return policy.gain_pivot(policy.gain_grid(study.scores, GRID, SCENARIOS), list(SCENARIOS))


@AREA.query(
    "best_gain",
    "scores",
    GRID_SQL
    + """ select scenario, cutoff_pct, n_contacted, gain from (select *, row_number() over (partition by scenario order by gain desc, cutoff_pct) as i
      from g where gain is not null) where i = 1""",
)
def best_gain(study):
    return policy.best_gain(policy.gain_grid(study.scores, GRID, SCENARIOS))
