"""Ranking, curve and uplift-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nudgeframe.catalog.registry import Area
from nudgeframe.operators import metrics

AREA = Area()

CUTOFFS_SQL = "(values (5, 0.05::double), (10, 0.10::double), (20, 0.20::double), (30, 0.30::double)) k(cutoff_pct, cutoff)"


def ranked_sql(source: str = "scores", by: str = "") -> str:
    """CTEs with rank, totals and running arm counts, ties ranked by entity."""
    part = f"partition by {by}" if by else ""
    keys = f"{by}," if by else ""
    return f"""
    with rk as (
      select {keys} client_id, treatment_flg, target, uplift,
        row_number() over w as rank, count(*) over ({part}) as n,
        sum(treatment_flg) over w as ct, sum(1 - treatment_flg) over w as cc,
        sum(treatment_flg * target) over w as yt, sum((1 - treatment_flg) * target) over w as yc
      from {source}
      window w as ({part} order by uplift desc, client_id rows between unbounded preceding and current row)),
    pts as (
      select *, rank / n::double as fraction,
        yt - coalesce(ct / nullif(cc, 0)::double, 0) * yc as qini,
        coalesce(yt / nullif(ct, 0)::double - yc / nullif(cc, 0)::double, 0.0) as uplift_rate
      from rk)"""


def area_sql(value: str) -> str:
    return (
        f"round((sum({value}) - (sum(case when rank = 1 then {value} else 0 end)"
        f" + sum(case when rank = n then {value} else 0 end)) / 2) / max(n), 6)"
    )


def rate_sql(condition: str) -> str:
    def count(extra):
        return f"sum(case when {condition} and {extra} then 1 else 0 end)"

    return (
        f"round({count('treatment_flg = 1 and target = 1')}::double / nullif({count('treatment_flg = 1')}, 0)"
        f" - {count('treatment_flg = 0 and target = 1')}::double / nullif({count('treatment_flg = 0')}, 0), 6)"
    )


def top_sql(cutoff: str) -> str:
    return f"rank <= greatest(1, ceil(n * {cutoff}))"


def normalised_sql(source: str, by: str, oracle: str = "gain * gain / 2 + gain * (n - gain)") -> str:
    """Normalised Qini per group over distinct scores."""
    part = f"partition by {by}" if by else ""
    keys = f"{by}," if by else ""
    group = f"group by {by}" if by else ""

    def areas(name, score):
        return f"""
    {name}_g as (select {keys} {score} as s, count(*) as m, sum(treatment_flg) as t,
        sum(treatment_flg * target) as yt, sum((1 - treatment_flg) * target) as yc
      from {source} group by {keys} {score}),
    {name}_w as (select {keys} s, sum(m) over w as x, sum(t) over w as ct, sum(yt) over w as yt, sum(yc) over w as yc
      from {name}_g window w as ({part} order by s desc rows between unbounded preceding and current row)),
    {name}_y as (select *, yt - coalesce(ct / nullif(x - ct, 0)::double, 0) * yc as y from {name}_w),
    {name}_l as (select *, coalesce(lag(x) over w, 0) as x0, coalesce(lag(y) over w, 0) as y0 from {name}_y
      window w as ({part} order by s desc)),
    {name} as (select {keys} sum((y + y0) / 2 * (x - x0)) as area from {name}_l {group})"""

    join = f"using ({by})" if by else "on true"
    extra = "," + areas("best", "(target * treatment_flg - target * (1 - treatment_flg))") if "best" in oracle else ""
    best_join = f"join best {join}" if extra else ""
    return f"""{areas('act', 'uplift')}{extra},
    tot as (select {keys} count(*)::double as n, sum(treatment_flg)::double as nt,
        sum(treatment_flg * target)::double as nyt, sum((1 - treatment_flg) * target)::double as nyc
      from {source} {group}),
    norm as (select {keys} case when {oracle} - n * gain / 2 = 0 then 0
        else round((act.area - n * gain / 2) / nullif({oracle} - n * gain / 2, 0), 6) end as normalized_qini_auc
      from (select *, nyt - nt * nyc / (n - nt) as gain from tot) z join act {join} {best_join})"""


@AREA.query(
    "uplift_decile_table",
    "scores",
    ranked_sql()
    + """, d as (select *, ntile(10) over (order by rank) as bin from rk)
    select bin::integer as bin, count(*) as n, sum(treatment_flg)::bigint as treated_n,
      sum(1 - treatment_flg)::bigint as control_n,
      round(coalesce(avg(case when treatment_flg = 1 then target end), 0), 6) as treated_response_rate,
      round(coalesce(avg(case when treatment_flg = 0 then target end), 0), 6) as control_response_rate,
      round(coalesce(avg(case when treatment_flg = 1 then target end), 0)
          - coalesce(avg(case when treatment_flg = 0 then target end), 0), 6) as uplift,
      round(round(sum(uplift), 6) / count(*), 6) as avg_predicted_uplift
    from d group by bin""",
)
def uplift_decile_table(study):
    return metrics.decile_table(study.scores)


@AREA.query(
    "score_problems",
    "model_scores",
    """select run_id, count(*) as n_rows, count(*) filter (where target not in (0, 1)) as bad_target,
      count(*) filter (where treatment_flg not in (0, 1)) as bad_treatment,
      count(*) filter (where treatment_flg = 1) as treated, count(*) filter (where treatment_flg = 0) as control,
      count(*) filter (where uplift is null) as bad_score, cast(null as varchar) as problem
    from model_scores group by run_id""",
)
def score_problems(study):
    return metrics.score_problems(study.model_scores, ["run_id"])


@AREA.query("qini_curve", "scores", ranked_sql() + "select rank, fraction, qini from pts")
def qini_curve(study):
    return metrics.qini_curve(study.scores)


@AREA.query("uplift_curve", "scores", ranked_sql() + "select rank, fraction, uplift_rate as uplift from pts")
def uplift_curve(study):
    return metrics.uplift_curve(study.scores)


@AREA.query(
    "curve_downsample",
    "model_scores",
    ranked_sql("model_scores", "run_id")
    + """select run_id, rank, fraction, qini from pts
    where n <= 200 or (rank - 1) % greatest(1, n // 200) = 0 or rank = n""",
)
def curve_downsample(study):
    return metrics.downsampled(metrics.qini_curve(study.model_scores, ["run_id"]), 200)


@AREA.query("qini_auc", "scores", ranked_sql() + f"select {area_sql('qini')} as qini_auc from pts")
def qini_auc(study):
    return metrics.qini_auc(study.scores)


@AREA.query("uplift_auc", "scores", ranked_sql() + f"select {area_sql('uplift_rate')} as uplift_auc from pts")
def uplift_auc(study):
    return metrics.uplift_auc(study.scores)


@AREA.query(
    "normalized_qini",
    "model_scores",
    f"with {normalised_sql('model_scores', 'run_id')} select run_id, normalized_qini_auc from norm",
)
def normalized_qini(study):
    return metrics.normalized_qini(study.model_scores, ["run_id"])


@AREA.query(
    "normalized_qini_negative",
    "scores",
    f"with {normalised_sql('scores', '', 'best.area')} select normalized_qini_auc from norm",
)
def normalized_qini_negative(study):
    return metrics.normalized_qini(study.scores, negative_effect=True)


@AREA.query(
    "uplift_at_k",
    "model_scores",
    ranked_sql("model_scores", "run_id")
    + f"select run_id, cutoff_pct, {rate_sql(top_sql('cutoff'))} as uplift_at_k from rk, {CUTOFFS_SQL} group by run_id, cutoff_pct",
)
def uplift_at_k(study):
    return metrics.uplift_at_k(study.model_scores, by=["run_id"])


@AREA.query(
    "policy_gain",
    "model_scores",
    ranked_sql("model_scores", "run_id")
    + f""", u as (select run_id, cutoff_pct, cutoff, max(n) as n, {rate_sql(top_sql('cutoff'))} as uplift_at_k
      from rk, {CUTOFFS_SQL} group by run_id, cutoff_pct, cutoff)
    select run_id, cutoff_pct, scenario, 'top_' || cutoff_pct || 'pct_' || scenario as key,
      ceil(n * cutoff)::bigint as n_contacted, uplift_at_k,
      round(uplift_at_k * ceil(n * cutoff) * 1.0::double - ceil(n * cutoff) * cost, 6) as gain
    from u, (values ('zero_cost', 0.0::double), ('low_cost', 0.05::double), ('medium_cost', 0.20::double)) s(scenario, cost)""",
)
def policy_gain(study):
    return metrics.policy_gain(study.model_scores, by=["run_id"])


BUNDLE_SQL = (
    ranked_sql("model_scores", "run_id")
    + f""", {normalised_sql('model_scores', 'run_id')},
    a as (select run_id, max(n) as n, {area_sql('qini')} as qini_auc, {area_sql('uplift_rate')} as uplift_auc,
      {rate_sql(top_sql('0.05::double'))} as uplift_at_5pct, {rate_sql(top_sql('0.10::double'))} as uplift_at_10pct,
      {rate_sql(top_sql('0.20::double'))} as uplift_at_20pct, {rate_sql(top_sql('0.30::double'))} as uplift_at_30pct
      from pts group by run_id)
    select * from a join norm using (run_id)"""
)


@AREA.query("metric_bundle_by_model", "model_scores", BUNDLE_SQL)
def metric_bundle_by_model(study):
    return metrics.metric_bundle(study.model_scores, ["run_id"])


@AREA.query(
    "metric_bundle_with_problems",
    "model_scores",
    f"""select *, null::varchar as problem from ({BUNDLE_SQL})
    union all by name select 'one_arm' as run_id, 'both arms are required' as problem
    union all by name select 'null_score' as run_id, 'uplift contains missing values' as problem""",
)
def metric_bundle_with_problems(study):
    """A run without controls and one with missing scores leave the others' metrics as they are."""
    scores = study.model_scores
    own = scores.filter("run_id = 'm1'")
    one_arm = own.filter("treatment_flg = 1").withColumn("run_id", F.lit("one_arm"))
    missing = own.withColumns({"run_id": F.lit("null_score"), "uplift": F.when(F.col("uplift") > 0, F.col("uplift"))})
    return metrics.metric_bundle_with_problems(scores.unionByName(one_arm).unionByName(missing), ["run_id"])
