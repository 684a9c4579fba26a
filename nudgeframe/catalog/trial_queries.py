"""Trial-table, hypothesis and robustness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nudgeframe.catalog.metric_queries import area_sql, normalised_sql, ranked_sql
from nudgeframe.catalog.registry import Area
from nudgeframe.operators import metrics, robustness, split, trials

AREA = Area()

PAIR_SQL = """
    with pr as (select distinct (select min(run_id) from model_scores) as run_a, run_id as run_b from model_scores
        where run_id > (select min(run_id) from model_scores)),
    sh as (select run_a, run_b, x.client_id, x.uplift as l, y.uplift as r from pr
        join model_scores x on x.run_id = run_a join model_scores y on y.run_id = run_b and y.client_id = x.client_id),
    rk as (select *, rank() over (partition by run_a, run_b order by l) + (count(*) over (partition by run_a, run_b, l) - 1) / 2.0::double as rl,
        rank() over (partition by run_a, run_b order by r) + (count(*) over (partition by run_a, run_b, r) - 1) / 2.0::double as rr from sh),
    cor as (select run_a, run_b, count(*) as shared_entities, round(corr(rl, rr), 6) as rank_correlation from rk group by run_a, run_b),
    po as (select *, row_number() over (partition by run_a, run_b order by l desc, client_id) as pl,
        row_number() over (partition by run_a, run_b order by r desc, client_id) as pq,
        greatest(1, ceil(count(*) over (partition by run_a, run_b) * 0.2::double)) as top from sh),
    ov as (select run_a, run_b, max(top)::bigint as top_n, round(count(*) filter (where pl <= top and pq <= top) / max(top), 6) as top_k_overlap
      from po group by run_a, run_b),
    st as (select count(*) as pair_count, min(rank_correlation) as min_rank_correlation, round(avg(rank_correlation), 6) as mean_rank_correlation,
        min(top_k_overlap) as min_top_k_overlap, round(avg(top_k_overlap), 6) as mean_top_k_overlap,
        count(*) filter (where rank_correlation is null) + count(*) filter (where top_k_overlap is null) as limitations,
        min(rank_correlation) >= 0.8 and min(top_k_overlap) >= 0.7 as stable from cor join ov using (run_a, run_b))"""


def _pairs(study):
    scores = study.model_scores
    return scores, robustness.run_pairs(scores)


@AREA.query("rank_correlation", "model_scores", PAIR_SQL + " select * from cor")
def rank_correlation(study):
    return robustness.rank_correlation(*_pairs(study))


@AREA.query("top_k_overlap", "model_scores", PAIR_SQL + " select * from ov")
def top_k_overlap(study):
    return robustness.top_k_overlap(*_pairs(study))


@AREA.query("ranking_stability", "model_scores", PAIR_SQL + " select * from st")
def ranking_stability(study):
    return robustness.ranking_stability(*_pairs(study))


POLICY_STABILITY_SQL = """
    bc as (select experiment_id, run_id, regexp_extract(key, '^top_(\\d+)pct_(.+)$', 2) as scenario,
        'top_' || regexp_extract(key, '^top_(\\d+)pct_(.+)$', 1) || 'pct' as cutoff, gain,
        row_number() over (partition by experiment_id, run_id, regexp_extract(key, '^top_(\\d+)pct_(.+)$', 2) order by gain desc, pos) as i
      from gains where gain is not null),
    rn as (select experiment_id, count(distinct run_id) as runs from trials group by experiment_id),
    ps as (select experiment_id, scenario, runs, count(*) as runs_with_scenario, round(min(gain), 6) as min_gain,
        case when count(*) = runs and min(cutoff) = max(cutoff) and min(gain) >= 0 then min(cutoff) end as stable_cutoff,
        count(*) = runs as complete, count(*) = runs and min(cutoff) = max(cutoff) and min(gain) >= 0 as stable
      from bc join rn using (experiment_id) where i = 1 group by experiment_id, scenario, runs)"""


@AREA.query(
    "policy_best_cutoffs",
    "gains",
    f"with {POLICY_STABILITY_SQL} select experiment_id, run_id, scenario, cutoff, gain from bc where i = 1",
)
def policy_best_cutoffs(study):
    keys = ["experiment_id", "run_id"]
    return robustness.policy_cutoffs(robustness.gain_rows(study.trials, keys), keys)


@AREA.query("policy_stability", "gains", f"with {POLICY_STABILITY_SQL} select * from ps")
def policy_stability(study):
    return robustness.policy_stability(study.trials, "experiment_id")


@AREA.query(
    "robustness",
    "model_scores gains",
    PAIR_SQL
    + f", {POLICY_STABILITY_SQL}"
    + """ select pair_count, (select count(*) from ps) as scenarios, (select count(*) from ps where not stable) as unstable_scenarios,
      stable as ranking_stable, (select count(*) from ps) > 0 and (select count(*) from ps where not stable) = 0 as policy_stable,
      stable and (select count(*) from ps) > 0 and (select count(*) from ps where not stable) = 0 as stable from st""",
)
def robustness_report(study):
    ranking = robustness.ranking_stability(*_pairs(study))
    return robustness.robustness(ranking, robustness.policy_stability(study.trials, "experiment_id"))


SCORE = "coalesce(normalized_qini_auc, qini_auc)"
MANUAL = "coalesce(hypothesis_id = 'manual_baseline', false)"


@AREA.query(
    "trial_config_hash",
    "trials",
    """select run_id, substr(sha256('{"base_estimator":"' || base_estimator || '","feature_recipe_id":"' || feature_recipe_id
      || '","learner_family":"' || uplift_learner_family || '","split_seed":' || split_seed || '}'), 1, 12) as config_hash from trials""",
)
def trial_config_hash(study):
    return trials.config_hashes(study.trials)


@AREA.query(
    "trial_champion",
    "trials",
    """select experiment_id, run_id as champion_run_id, uplift_learner_family as champion_family, normalized_qini_auc as champion_metric
    from (select *, row_number() over (partition by experiment_id order by normalized_qini_auc desc nulls last, seq) as i
      from trials where status = 'success') where i = 1""",
)
def trial_champion(study):
    return trials.champions(study.trials)


@AREA.query(
    "trial_duplicates",
    "trials",
    """with d as (select *, row_number() over (partition by experiment_id, params_hash, uplift_learner_family, base_estimator, feature_recipe_id order by seq) as i
      from trials where status = 'success'),
    e as (select *, row_number() over (partition by experiment_id order by seq) as j from d where i = 2)
    select experiment_id, seq as duplicate_seq, run_id as duplicate_run_id, params_hash as duplicate_params_hash from e where j = 1""",
)
def trial_duplicates(study):
    return trials.duplicate_configs(study.trials.filter(trials.success()))


@AREA.query(
    "plateau_class",
    "trials",
    """with t as (select * from trials where hypothesis_id <> 'manual_baseline' and hypothesis_id not like '%\\_\\_tune\\_%' escape '\\'),
    s as (select experiment_id, count(*) filter (where status = 'success') as successful from t group by experiment_id),
    d as (select experiment_id, min_by(run_id, seq) as duplicate_run_id from (select *, row_number() over (partition by experiment_id, params_hash,
        uplift_learner_family, base_estimator, feature_recipe_id order by seq) as i from t where status = 'success') where i = 2 group by experiment_id),
    r as (select experiment_id, count(qini_auc) as known, max(qini_auc) - min(qini_auc) as spread from
        (select *, row_number() over (partition by experiment_id order by seq desc) as i from t where status = 'success') where i <= 3 group by experiment_id),
    c as (select experiment_id, successful, duplicate_run_id, case when successful >= 9 then 'budget_reached' when duplicate_run_id is not null then 'duplicate_config'
        when known = 3 and spread <= 0.05::double then 'plateau' else 'continue' end as decision from s left join d using (experiment_id) left join r using (experiment_id))
    select *, decision = 'continue' as should_continue, case decision when 'continue' then 'plan_next_trial' when 'duplicate_config' then 'change_strategy'
      else 'generate_report' end as next_action from c""",
)
def plateau_class(study):
    return trials.plateau_class(study.trials, max_trials=9, flat_qini=0.05)


@AREA.query(
    "seed_stability",
    "trials",
    """with g as (select uplift_learner_family, params_hash, base_estimator, feature_recipe_id, count(*) as runs, count(distinct split_seed) as distinct_seeds,
        round(avg(normalized_qini_auc), 6) as mean_validation, round(avg(held_out_normalized_qini_auc), 6) as mean_held_out,
        round(min(held_out_normalized_qini_auc), 6) as min_held_out,
        case when count(held_out_normalized_qini_auc) >= 2 then round(max(held_out_normalized_qini_auc) - min(held_out_normalized_qini_auc), 6) end as held_out_range
      from trials where status = 'success' and hypothesis_id <> 'manual_baseline' group by all)
    select *, case when min_held_out is null or held_out_range is null then 'needs more seeds' when min_held_out >= 0.20 and held_out_range <= 0.05 then 'stable'
      when min_held_out >= 0.15 and held_out_range <= 0.10 then 'watch' else 'unstable' end as verdict
    from g where runs >= 2 and (mean_validation is not null or mean_held_out is not null)""",
)
def seed_stability(study):
    return trials.seed_stability(study.trials, by=())


@AREA.query(
    "trial_table",
    "trials",
    """select experiment_id, run_id, case when hypothesis_id = 'manual_baseline' then 'manual' else 'agent' end as role, uplift_learner_family,
      base_estimator, feature_recipe_id, normalized_qini_auc, uplift_auc, held_out_normalized_qini_auc
    from trials where hypothesis_id not like '%\\_\\_tune\\_%' escape '\\'""",
)
def trial_table(study):
    return trials.trial_table(study.trials)


@AREA.query(
    "best_per_recipe",
    "trials",
    f"""select experiment_id, feature_recipe_id, n as trials, run_id as best_run_id, normalized_qini_auc as best_normalized_qini_auc
    from (select *, row_number() over (partition by experiment_id, feature_recipe_id order by {SCORE} desc nulls last, seq) as i,
        count(*) over (partition by experiment_id, feature_recipe_id) as n from trials where status = 'success' and not {MANUAL}) where i = 1""",
)
def best_per_recipe(study):
    return trials.best_per_recipe(study.trials)


@AREA.query(
    "benchmark_delta",
    "trials",
    f"""with c as (select *, {SCORE} as s, row_number() over (partition by experiment_id order by {SCORE} desc nulls last, seq) as i
        from trials where status = 'success' and not {MANUAL}),
    b as (select *, {SCORE} as s, row_number() over (partition by experiment_id order by seq desc) as i from trials where status = 'success' and {MANUAL})
    select c.experiment_id, c.run_id as champion_run_id, b.run_id as benchmark_run_id, round(c.s - b.s, 6) as delta,
      case when c.s - b.s is null then 'champion_only' when c.s - b.s >= 0 then 'use_champion' else 'keep_benchmark' end as decision,
      coalesce(b.held_out_normalized_qini_auc > c.held_out_normalized_qini_auc, false) as held_out_caution
    from c left join b on b.experiment_id = c.experiment_id and b.i = 1 where c.i = 1""",
)
def benchmark_delta(study):
    return trials.benchmark_delta(study.trials)


@AREA.query(
    "tuning_candidates",
    "trials",
    f"""with t as (select *, {SCORE} as score from trials where status = 'success' and hypothesis_id <> 'manual_baseline'
        and hypothesis_id not like '%\\_\\_tune\\_%' escape '\\' and not starts_with(hypothesis_id, 'agentic_tune__')
        and base_estimator in ('logistic_regression', 'gradient_boosting', 'random_forest', 'xgboost', 'lightgbm', 'catboost')
        and uplift_learner_family <> 'random' and {SCORE} is not null),
    b as (select *, row_number() over (partition by experiment_id, template_name, feature_recipe_id order by score desc, seq) as i from t),
    r as (select *, row_number() over (partition by experiment_id order by score desc, template_name desc, run_id desc)::integer as rank from b where i = 1)
    select experiment_id, template_name, feature_recipe_id, run_id, base_estimator, split_seed, params_hash, score, rank from r where rank <= 2""",
)
def tuning_candidates(study):
    return trials.tuning_candidates(study.trials)


@AREA.query(
    "validation_leaders",
    "trials",
    """select run_id, template_name, normalized_qini_auc, qini_auc, row_number() over (order by normalized_qini_auc desc, qini_auc desc, seq)::integer as validation_rank
    from trials where status = 'success' and normalized_qini_auc is not null and qini_auc is not null order by validation_rank limit 3""",
)
def validation_leaders(study):
    # Two ledgers that share runs: the second repeats the first's records.
    both = study.trials.unionByName(study.trials.withColumn("seq", F.col("seq") + 10**9))
    return trials.validation_leaders(both.drop("policy_gain"))


@AREA.query(
    "tuning_summary",
    "trials",
    f"""select run_id, hypothesis_id, status, uplift_learner_family as learner_family, base_estimator, split_seed, params_hash,
      normalized_qini_auc as val_normalized_qini, {SCORE} as selection_score, 'validation_only' as selection_score_source from trials""",
)
def tuning_summary(study):
    return trials.tuning_summary(study.trials)


@AREA.query(
    "trial_summary",
    "trials",
    """select experiment_id, count(*) as total, count(*) filter (where status = 'success') as successful,
      (arg_max(run_id, coalesce(normalized_qini_auc, 0) - seq * 1e-12) filter (where status = 'success')) as best_run_id,
      (arg_max(coalesce(normalized_qini_auc, -9), coalesce(normalized_qini_auc, 0) - seq * 1e-12) filter (where status = 'success')) as best_metric
    from trials group by experiment_id""".replace("coalesce(normalized_qini_auc, -9), ", "struct_pack(v := normalized_qini_auc), ").replace(
        "(where status = 'success')) as best_metric", "(where status = 'success')).v as best_metric"
    ),
)
def trial_summary(study):
    return trials.trial_summary(study.trials)


@AREA.query(
    "family_metric_mean",
    "trials",
    """select uplift_learner_family, count(*) as trials, round(avg(qini_auc), 6) as mean_qini_auc from trials
    where qini_auc is not null group by uplift_learner_family""",
)
def family_metric_mean(study):
    return trials.family_means(study.trials)


WAVE_SQL = """
    pool as (select w.wave_id, w.champion_run_id as named, t.* from waves w join trials t
      on t.experiment_id = w.experiment_id and (len(w.trial_ids) = 0 or list_contains(w.trial_ids, t.run_id))),
    ru as (select wave_id, qini_auc as runner_up_metric from pool where qini_auc is not null
      qualify row_number() over (partition by wave_id order by qini_auc desc, seq) = 2),
    ch as (select wave_id, qini_auc as champion_metric from pool where run_id = named),
    bg as (select p.wave_id, g.key as best_policy_gain_key, g.gain as best_policy_gain from pool p join gains g using (run_id)
      where p.run_id = p.named and g.gain is not null qualify row_number() over (partition by p.wave_id order by g.gain desc, g.pos) = 1),
    ev as (select *, round(champion_metric - runner_up_metric, 6) as metric_delta
      from waves left join ch using (wave_id) left join ru using (wave_id) left join bg using (wave_id))"""


@AREA.query("wave_evidence", "waves trials gains", f"with {WAVE_SQL} select * from ev")
def wave_evidence(study):
    return trials.wave_evidence(study.waves, study.trials)


@AREA.query(
    "wave_outcome",
    "waves trials gains",
    f"""with {WAVE_SQL}, x as (select *, coalesce(champion_metric >= 0.05 and best_policy_gain >= 0, false) as sup,
        coalesce(champion_metric <= -0.01 and (best_policy_gain is null or best_policy_gain <= 0), false) as con,
        status in ('blocked', 'failed') or blocked_reason is not null as blk,
        champion_metric is null or coalesce(metric_delta < 0.01, false) as low,
        coalesce(not robustness_stable, false) as uns,
        champion_stability_runs >= 2 as stb, coalesce(policy_threshold_stable and best_policy_gain >= 0, false) as pst from ev),
    r as (select *, case when blk then 1 when compute_exhausted then 2 when len(valid_next_actions) = 0 then 3 when low then 4 when uns then 5
        when stb then 6 when pst then 7 when sup then 8 else 9 end as rule from x)
    select experiment_id, wave_id, champion_run_id, champion_metric, metric_delta, best_policy_gain_key, best_policy_gain,
      ['validity_blocked', 'compute_exhausted', 'no_valid_next_action', 'low_information_gain', 'low_information_gain', 'champion_stable',
       'policy_threshold_stable', 'business_decision_supportable', 'low_information_gain'][rule] as stop_reason,
      case when rule in (1, 2, 5) then 'inconclusive' when rule in (6, 7, 8) then 'supported'
        when rule = 3 and sup then 'supported' when con then 'contradicted' else 'inconclusive' end as hypothesis_status,
      case when rule in (4, 9) then con when rule = 5 then false else true end as should_stop,
      case when rule = 1 then 'fix_validity_blocker' when rule in (4, 9) and not con then valid_next_actions[1]
        when rule = 5 then case when list_contains(valid_next_actions, 'ranking_stability_check') then 'ranking_stability_check' else valid_next_actions[1] end
        else 'stop' end as next_action from r""",
)
def wave_outcome(study):
    return trials.wave_outcomes(trials.wave_evidence(study.waves, study.trials))


VERDICT_SQL = f"""
    with p as (select t.*, (select struct_pack(q := p.qini_auc, u := p.uplift_auc) from trials p where p.experiment_id = t.experiment_id
        and p.seq < t.seq and p.status = 'success' and p.qini_auc is not null order by p.qini_auc desc, p.seq limit 1) as prior from trials t),
    v as (select *, case when status <> 'success' or {SCORE} is null then 'inconclusive' when {SCORE} <= -0.01 then 'contradicted'
        when {SCORE} >= 0.05 and not coalesce(qini_auc <= prior.q, false) and not coalesce(uplift_auc < prior.u - 0.001::double, false) then 'supported'
        else 'inconclusive' end as ceiling from p)"""


@AREA.query(
    "verdict_ceiling",
    "trials",
    VERDICT_SQL
    + """ select experiment_id, seq, run_id, status, prior.q as prior_qini_auc, ceiling, case when status <> 'success' then 'inconclusive'
      when list_position(['contradicted', 'inconclusive', 'supported'], pv) <= list_position(['contradicted', 'inconclusive', 'supported'], ceiling) then pv
      else ceiling end as verdict from (select *, ['contradicted', 'inconclusive', 'supported', 'unknown'][cast(seq % 4 + 1 as integer)] as pv from v)""",
)
def verdict_ceiling(study):
    names = F.array(*[F.lit(v) for v in (*trials.VERDICTS, "unknown")])
    proposed = study.trials.withColumn("proposed", F.element_at(names, (F.col("seq") % 4 + 1).cast("int")))
    return trials.verdict_ceiling(proposed.drop("policy_gain"), "proposed")


@AREA.query(
    "hypothesis_latest",
    "hypotheses",
    """select hypothesis_id, seq, status, action_type, trial_ids from (select *, row_number() over (partition by hypothesis_id order by seq desc) as i
      from hypotheses) where i = 1 and status = 'under_test' and action_type = 'window_sweep'""",
)
def hypothesis_latest(study):
    return trials.hypotheses_where(study.hypotheses, "under_test", "window_sweep")


@AREA.query(
    "hypothesis_by_trial",
    "hypotheses",
    """select hypothesis_id, seq, status, action_type, trial_ids from (select *, row_number() over (partition by hypothesis_id order by seq desc) as i
      from hypotheses) where i = 1 and list_contains(trial_ids, 'r884')""",
)
def hypothesis_by_trial(study):
    return trials.hypotheses_where(study.hypotheses, trial_id="r884")


@AREA.query(
    "first_seen_dedupe",
    "hypotheses",
    """select hypothesis_id, seq, status, action_type, trial_ids from (select *, row_number() over (partition by hypothesis_id order by seq) as i
      from hypotheses) where i = 1""",
)
def first_seen_dedupe(study):
    return trials.first_seen(study.hypotheses, ["hypothesis_id"])


FOLD_SQL = (
    """with kf as (select client_id, (row_number() over (partition by treatment_flg, target order by md5(concat(client_id, ':9')), client_id) - 1) % 3 + 1 as fold from train),
      fs as (select client_id, treatment_flg, target, uplift, run_id || '-' || cast(fold as varchar) as fold_id from model_scores join kf using (client_id)), """
    + ranked_sql("fs", "fold_id").strip()[len("with "):]
    + ", "
    + normalised_sql("fs", "fold_id")
    + f""", fm as (select split_part(fold_id, '-', 1) as run_id, a.fold_id, qini_auc, uplift_auc, normalized_qini_auc from
      (select fold_id, {area_sql('qini')} as qini_auc, {area_sql('uplift_rate')} as uplift_auc from pts group by fold_id) a join norm using (fold_id)),
    fl as (select run_id, 'qini_auc' as metric, qini_auc as v from fm union all select run_id, 'uplift_auc', uplift_auc from fm
      union all select run_id, 'normalized_qini_auc', normalized_qini_auc from fm),
    sm as (select run_id, metric, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max
      from fl group by run_id, metric)"""
)


def _fold_metrics(study):
    folds = split.kfold(study.train, 3, seed=9).select("client_id", "fold")
    keyed = study.model_scores.join(folds, "client_id")
    return metrics.metric_bundle(keyed, ["run_id", "fold"])


@AREA.query("fold_metric_summary", "model_scores train", FOLD_SQL + " select * from sm")
def fold_metric_summary(study):
    return trials.fold_summary(_fold_metrics(study), ["qini_auc", "uplift_auc", "normalized_qini_auc"], ["run_id"])


@AREA.query(
    "cv_test_gap",
    "model_scores train",
    FOLD_SQL
    + ", "
    + normalised_sql("model_scores", "run_id").replace("act_", "full_act_").replace("act as", "full_act as").replace(
        "join act using", "join full_act using"
    ).replace("from act_", "from full_act_").replace("act.area", "full_act.area").replace("tot as", "full_tot as").replace(
        "from tot)", "from full_tot)"
    ).replace("norm as", "full_norm as")
    + """ select run_id, mean as normalized_qini_auc_cv, normalized_qini_auc as normalized_qini_auc_test,
      round(mean - normalized_qini_auc, 5) as gap from sm join full_norm using (run_id) where metric = 'normalized_qini_auc'""",
)
def cv_test_gap(study):
    cv = trials.fold_summary(_fold_metrics(study), ["normalized_qini_auc"], ["run_id"]).select(
        "run_id", F.col("mean").alias("normalized_qini_auc")
    )
    return trials.cv_test_gap(cv, metrics.normalized_qini(study.model_scores, ["run_id"]))
