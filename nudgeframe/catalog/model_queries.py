"""Explanation, learner, cross-validation and artifact queries.

Fitted models have no SQL rendering; their queries are checked by invariants in the
tests and by companions with SQL: medians of all training sets, and the score equations
of the logistic fits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nudgeframe.catalog.decision_queries import SPLIT_SQL
from nudgeframe.catalog.feature_queries import client_sql
from nudgeframe.catalog.inputs import PINNED
from nudgeframe.catalog.metric_queries import CUTOFFS_SQL, ranked_sql, rate_sql, top_sql
from nudgeframe.catalog.registry import Area
from nudgeframe.config import RECIPE_FAMILIES, Recipe, recipe_family
from nudgeframe.operators import crossval, explain, facts, features, learners, policy, quality, split
from nudgeframe.operators.learners import TrialSpec
from nudgeframe.operators.logistic import LinearModel
from nudgeframe.session import cut_lineage, shared_folder
from nudgeframe.sources import artifacts, ledger
from nudgeframe.sources import tables as source_tables

AREA = Area()

ASSOCIATION_COLUMNS = ["age_clean", "age_invalid_flag", "issue_year", "issue_month", "gender_F", "gender_M", "gender_U", "gender_other"]


def _association_long(columns) -> str:
    return " union all ".join(
        f"select client_id, '{c}' as feature, \"{c}\"::double as v, uplift as u from demo join scores using (client_id)" for c in columns
    )


@AREA.query(
    "score_feature_association",
    "clients scores train",
    f"with {client_sql()}, l as ({_association_long(ASSOCIATION_COLUMNS)})"
    + """, r as (select *, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0::double as rv,
        rank() over (partition by feature order by u) + (count(*) over (partition by feature, u) - 1) / 2.0::double as ru from l),
    c as (select feature, corr(rv, ru) as c from r group by feature having min(v) < max(v))
    select feature, round(c, 4) as spearman_with_uplift, case when c >= 0 then 'higher_feature_higher_uplift' else 'higher_feature_lower_uplift' end as direction
    from c order by abs(round(c, 4)) desc, feature limit 6""",
)
def score_feature_association(study):
    table = features.client_features(study.train, study.clients)
    return explain.feature_association(table, study.scores, ASSOCIATION_COLUMNS, 6)


CASES_SQL = """
    p as (select client_id, uplift, row_number() over (order by uplift desc, client_id) as rank, count(*) over () as n from scores),
    cases as (select 'highest_uplift' as case_group, rank, client_id, uplift from p where rank <= 3 union all
      select 'lowest_uplift', rank, client_id, uplift from p where rank > n - 3 union all
      select 'near_boundary', rank, client_id, uplift from p where rank between n // 2 and n // 2 + 2)"""


@AREA.query("representative_cases", "scores", f"with {CASES_SQL} select * from cases")
def representative_cases(study):
    return explain.representative_cases(study.scores)


CASE_DRIVERS = ["age_clean", "issue_year", "gender_F"]


@AREA.query(
    "case_context",
    "clients scores train",
    f"with {client_sql()}, {CASES_SQL}, l as ("
    + " union all ".join(
        f"select case_group, client_id, '{c}' as feature, \"{c}\"::double as value from cases join demo using (client_id)" for c in CASE_DRIVERS
    )
    + """) select case_group, client_id, feature, value, round(coalesce((value - avg(value) over w)
      / case when stddev_pop(value) over w = 0 then 1 else stddev_pop(value) over w end, 0.0), 6) as z from l window w as (partition by feature)""",
)
def case_context(study):
    table = features.client_features(study.train, study.clients)
    return explain.case_context(explain.representative_cases(study.scores), table, CASE_DRIVERS)


IMPORTANCE_SQL = """
    imp as (select 'run' || (cast(client_id as bigint) % 4) as run_id, feature, round(sum(abs(v * u)), 3) as importance from l group by all)"""
DRIVER_COLUMNS = ["age_clean", "purchase_sum", "days_to_first_redeem", "recency_days", "gender_F"]
_DRIVER_SQL = """
    with d as (select s.client_id, s.uplift as u, case when age between 14 and 100 then age else -1.0::double end / 40 as age_clean,
        cast((cast(s.client_id as bigint) * 7) % 50 as double) / 10 as purchase_sum, cast(cast(s.client_id as bigint) % 90 as double) / 18 as days_to_first_redeem,
        cast((cast(s.client_id as bigint) * 3) % 40 as double) / 9 as recency_days, cast(coalesce(gender = 'F', false) as double) as "gender_F"
      from scores s join clients using (client_id)),
    l as (""" + " union all ".join(f"select client_id, u, '{c}' as feature, \"{c}\" as v from d" for c in DRIVER_COLUMNS) + "), " + IMPORTANCE_SQL + """,
    o as (select *, row_number() over (partition by run_id order by abs(importance) desc, feature) as pos from imp)"""


def _importance(study):
    """Per-run driver strengths derived from the scores and clients."""
    key = F.col("client_id").cast("long")
    age = F.col("age")
    base = study.scores.join(study.clients, "client_id").select(
        F.concat(F.lit("run"), (key % 4).cast("string")).alias("run_id"),
        "uplift",
        (F.when(age.between(14, 100), age).otherwise(-1.0) / 40).alias("age_clean"),
        (((key * 7) % 50).cast("double") / 10).alias("purchase_sum"),
        ((key % 90).cast("double") / 18).alias("days_to_first_redeem"),
        (((key * 3) % 40).cast("double") / 9).alias("recency_days"),
        F.coalesce(F.col("gender") == "F", F.lit(False)).cast("double").alias("gender_F"),
    )
    long = base.unpivot(["run_id", "uplift"], DRIVER_COLUMNS, "feature", "value")
    return long.groupBy("run_id", "feature").agg(F.round(F.sum(F.abs(F.col("value") * F.col("uplift"))), 3).alias("importance"))


@AREA.query(
    "driver_semantics",
    "clients scores",
    _DRIVER_SQL
    + """ select run_id, max(case when pos = 1 then feature end) as top_feature, max(case when pos = 1 then feature end) = 'age_clean' as age_dominance_warning,
      bool_or(regexp_matches(feature, '^(purchase_|txn_|recency_|basket_|points_|avg_transaction_|product_)')) as behavioral_top5_present
    from o where pos <= 5 group by run_id""",
)
def driver_semantics(study):
    return explain.driver_semantics(_importance(study))


@AREA.query(
    "leakage_flags",
    "clients scores",
    _DRIVER_SQL
    + """ select run_id, bool_or(regexp_matches(feature, 'post|after|response|outcome|target|redeem')) as leakage_suspected,
      count(*) filter (where regexp_matches(feature, 'post|after|response|outcome|target|redeem')) as suspicious_features
    from o where pos <= 5 group by run_id""",
)
def leakage_flags(study):
    return explain.leakage_flags(_importance(study))


@AREA.query(
    "driver_stability",
    "clients scores",
    _DRIVER_SQL
    + """, k as (select feature, count(*) as n from o where pos <= 3 group by feature), r as (select count(distinct run_id) as runs from imp),
    c as (select coalesce(list_sort(list(feature) filter (where n = runs and runs >= 2)), []) as l from k, r)
    select runs, runs < 2 or len(l) >= 2 as stable, l as consistent_top3 from r, c""",
)
def driver_stability(study):
    return explain.driver_stability(_importance(study))


MODEL_RECIPE = Recipe(
    feature_groups=("demographic", "rfm", "basket", "points"),
    temporal_policy="safe_history_until_reference",
    reference_date=PINNED,
)
def _features(study, cohort):
    ids = facts.cohort_ids(study.train, study.scoring, cohort)
    return features.feature_table(MODEL_RECIPE, ids, study.clients, study.purchases)


def _tables(study):
    return {
        "clients": study.clients, "train": study.train, "scoring": study.scoring,
        "purchases": study.purchases, "products": study.products,
    }


def _labelled(study):
    """Labelled features of the model recipe, written once for the query."""
    path = f"{artifacts.scratch_folder(study.spark)}/features"
    ids = facts.cohort_ids(study.train, study.scoring, "train")
    return features.labelled_features(artifacts.written_features(_features(study, "train"), ids, path), study.train)


def _spec(family, estimator="logistic_regression", run_id=None):
    return TrialSpec(run_id or f"{family}_{estimator}", family, estimator)


def _learner_query(family, estimator):
    def build(study):
        parts = cut_lineage(split.stratified_split(_labelled(study)))
        model = learners.fit_uplift(parts.filter("split = 'train'"), family, estimator)
        return learners.scored(model, parts.filter("split = 'validation'"))

    return build


# The registered learner and estimator pairs.
LEARNERS = (
    ("random", "logistic_regression"),
    ("response_model", "logistic_regression"),
    ("two_model", "logistic_regression"),
    ("solo_model", "logistic_regression"),
    ("class_transformation", "logistic_regression"),
    ("response_model", "gradient_boosting"),
    ("two_model", "gradient_boosting"),
    ("solo_model", "gradient_boosting"),
    ("class_transformation", "gradient_boosting"),
    ("two_model", "random_forest"),
    ("solo_model", "random_forest"),
    ("class_transformation", "random_forest"),
)
# The random learner is a hash of the customer, so SQL can say all of it.
RANDOM_SQL = (
    SPLIT_SQL
    + """ select client_id, target, treatment_flg, cast(('0x' || substr(md5(client_id || ':42'), 1, 13)) as bigint) / 4503599627370496.0::double as uplift
      from split where split = 'validation'"""
)
for _family, _estimator in LEARNERS:
    _known = ("train", RANDOM_SQL) if _family == "random" else ("", None)
    AREA.query(f"learner_scores_{_family}_{_estimator}", *_known)(_learner_query(_family, _estimator))


@AREA.query("baseline_ladder")
def baseline_ladder(study):
    batch = learners.run_trials(_labelled(study), learners.baseline_specs(), score_held_out=True)
    return learners.trial_results(batch, study.spark)


LINEAR_FAMILIES = ("response_model", "two_model", "solo_model", "class_transformation")


@AREA.query("cv_audit")
def cv_audit(study):
    """Every linear family over five folds, fitted in shared passes."""
    scores = crossval.fold_scores(_labelled(study), [_spec(family) for family in LINEAR_FAMILIES], 5)
    return crossval.cv_summary(crossval.fold_metrics(scores))


MEDIAN_COLUMNS = ["age", "redeem_delay", "spent", "points"]
PLAIN_SQL = """
    f as (select client_id, treatment_flg, target, (row_number() over (partition by treatment_flg, target order by md5(concat(client_id, ':20260501')), client_id) - 1) % 5 + 1 as fold from train),
    s as (select client_id, round(sum(purchase_sum), 2) as spent, round(sum(regular_points_received), 2) as points from purchases group by client_id),
    x as (select f.*, age::double as age, datediff('day', first_issue_date::date, first_redeem_date::date)::double as redeem_delay, spent, points
      from f join clients using (client_id) left join s using (client_id))"""


def _plain_features(study):
    """Labelled rows with four columns, some of them null."""
    spent = study.purchases.groupBy("client_id").agg(
        F.round(F.sum("purchase_sum"), 2).alias("spent"), F.round(F.sum("regular_points_received"), 2).alias("points")
    )
    delay = F.date_diff(F.col("first_redeem_date"), F.col("first_issue_date")).alias("redeem_delay")
    rows = study.clients.select("client_id", "age", delay).join(spent, "client_id", "left")
    return study.train.join(rows, "client_id")


@AREA.query(
    "imputed_medians",
    "clients train purchases",
    f"""with {PLAIN_SQL},
    l as ("""
    + " union all ".join(f"select treatment_flg, fold, '{c}' as feature, {c}::double as v from x" for c in MEDIAN_COLUMNS)
    + """), g as (select arms, left_out from (values ('all'), ('control'), ('treated')) a(arms), range(0, 6) r(left_out))
    select arms, cast(left_out as int) as left_out, feature, count(v) as n_known, median(v) as median from g join l on fold <> left_out
      and (arms = 'all' or (arms = 'treated') = (treatment_flg = 1)) group by arms, left_out, feature""",
)
def imputed_medians(study):
    return crossval.fold_medians(_plain_features(study), MEDIAN_COLUMNS)


@AREA.query(
    "score_equations",
    "train",
    SPLIT_SQL
    + """, t as (select treatment_flg, target, case when treatment_flg = target then 1 else 0 end as z from split where split = 'train'),
    m as (select 'response_model' as run_id, 'model' as model, target as y from t union all select 'solo_model', 'model', target from t
      union all select 'class_transformation', 'model', z from t union all select 'two_model', 'treated', target from t where treatment_flg = 1
      union all select 'two_model', 'control', target from t where treatment_flg = 0)
    select run_id, model, count(*) as n_rows, round(avg(y), 6) as mean_label, round(avg(y), 6) as mean_probability from m group by run_id, model""",
)
def score_equations(study):
    """Mean label and mean probability of every logistic model on its training rows; all families fitted together."""
    train = cut_lineage(split.stratified_split(_labelled(study)).filter("split = 'train'").drop("split"))
    names = features.feature_columns(train)
    settings = [(family, {}) for family in LINEAR_FAMILIES]
    fitted = learners.fit_linear(train.withColumn("__fold", F.lit(0)), settings, {0: [0]}, 42, learners.Columns(), names)
    return learners.score_equations({family: models[0] for family, models in zip(LINEAR_FAMILIES, fitted)}, train)


@AREA.query("topk_cv_rerank")
def topk_cv_rerank(study):
    labelled = _labelled(study)
    specs = [_spec("two_model"), _spec("class_transformation")]
    results = learners.trial_results(learners.run_trials(labelled, specs), study.spark)
    return crossval.rerank_by_cv(labelled, specs, results, n_folds=5)


@AREA.query("champion_test_once")
def champion_test_once(study):
    specs = [_spec("random"), _spec("response_model"), _spec("class_transformation")]
    return crossval.select_and_open_test(_labelled(study), specs, top_k=3, n_folds=5)["test"]


def _selection(study):
    """The stages of a selection over all linear families, kept by the labelled rows and settings: a second query resumes the first."""
    labelled = _labelled(study)
    specs = [_spec("random"), *[_spec(family) for family in LINEAR_FAMILIES]]
    data = artifacts.dataset_fingerprint({"labelled": labelled})
    folder = f"{shared_folder(study.spark)}/selection-{crossval.selection_settings(specs, data)}"
    return crossval.staged_selection(labelled, specs, folder, data)


@AREA.query("clean_selection")
def clean_selection(study):
    """Screened runs, finalists over folds, their tuned settings, the champion and its one test row."""
    return _selection(study)


@AREA.query(
    "selection_stages",
    "train",
    SPLIT_SQL
    + """, n as (select count(*) filter (where split = 'validation') as va, count(*) filter (where split = 'test') as te, count(*) as n from split)
    select stage, cast(runs as bigint) as n_runs, cast(case stage when 'screen' then va when 'test' then te else n - te end as bigint) as n_customers
    from n, (values ('screen', 5), ('folds', 3), ('tuned', 3), ('champion', 1), ('test', 1)) v(stage, runs)""",
)
def selection_stages(study):
    """Runs and judged customers of every stage; each run of a stage is judged on the same customers."""
    rows = _selection(study).filter("status = 'success'").groupBy("stage", "n").agg(F.count(F.lit(1)).alias("n_runs"))
    return rows.select("stage", "n_runs", F.col("n").alias("n_customers"))


TRIAL_ROWS = (("random", "logistic_regression"), *[(family, "logistic_regression") for family in LINEAR_FAMILIES],
              ("two_model", "random_forest"), ("response_model", "gradient_boosting"))
TRIAL_NAMES_SQL = ", ".join(f"('{family}_{estimator}')" for family, estimator in TRIAL_ROWS)


@AREA.query(
    "trial_rows",
    "train",
    SPLIT_SQL
    + f""" select run_id, 'success' as status, count(*) as n_rows, sum(treatment_flg) as treated, sum(target) as responders, count(*) as in_range
    from split, (values {TRIAL_NAMES_SQL}) v(run_id) where split = 'validation' group by run_id""",
)
def trial_rows(study):
    """The validation rows every learner scores: each customer once, scores within their range."""
    batch = learners.run_trials(_labelled(study), [_spec(family, estimator) for family, estimator in TRIAL_ROWS])
    states = study.spark.createDataFrame([(r["run_id"], r["status"]) for r in batch.records], "run_id string, status string")
    rows = batch.scores.groupBy("run_id").agg(
        F.count_distinct("client_id").alias("n_rows"), F.sum("treatment_flg").alias("treated"),
        F.sum("target").alias("responders"), F.count_if(F.col("uplift").between(-1, 1)).alias("in_range"),
    )
    return states.join(rows, "run_id", "left")


@AREA.query("submission_rows", "scoring", "select client_id, true as in_range from scoring")
def submission_rows(study):
    """The rows of a written submission: every scoring customer once, with a score within its range."""
    return submission(study).select("client_id", F.col("uplift").between(-1, 1).alias("in_range"))


def _fitted(study, family="two_model", estimator="logistic_regression"):
    parts = cut_lineage(split.stratified_split(_labelled(study)))
    model = learners.fit_uplift(parts.filter("split = 'train'"), family, estimator)
    return model, parts.filter("split = 'validation'").drop("split")


@AREA.query("permutation_sensitivity")
def permutation_sensitivity(study):
    return explain.permutation_sensitivity(*_fitted(study))


@AREA.query("permutation_importance")
def permutation_importance(study):
    return explain.permutation_importance(*_fitted(study))


# Stated coefficients, so that SQL can follow a learner: feature, weight and filling value for each arm.
STATED = (("age", 0.02, 40.0, -0.01, 38.0), ("redeem_delay", -0.004, 60.0, 0.002, 75.0), ("spent", 0.00001, 3000.0, 0.00002, 2500.0))
INTERCEPTS = (-0.7, 0.1)


def _stated_model():
    names = tuple(row[0] for row in STATED)

    def arm(k):
        weights, medians = tuple(r[1 + 2 * k] for r in STATED), tuple(r[2 + 2 * k] for r in STATED)
        return learners.ProbabilityModel(names, None, 0.0, LinearModel(names, medians, weights, INTERCEPTS[k], weights))

    return learners.UpliftModel("two_model", "logistic_regression", names, 42, treated=arm(0), control=arm(1))


def _stated_sql(swap: bool):
    value = lambda c, fill: f"coalesce({'case when feature = ' + chr(39) + c + chr(39) + ' then donor else ' + c + ' end' if swap else c}, {fill})"
    arms = []
    for k in (0, 1):
        terms = "".join(f" + {r[1 + 2 * k]}::double * {value(r[0], r[2 + 2 * k])}" for r in STATED)
        arms.append(f"1 / (1 + exp(-({INTERCEPTS[k]}::double{terms})))")
    return f"{arms[0]} - {arms[1]}"


PERMUTED_SQL = (
    f"with {PLAIN_SQL}, l as ("
    + " union all ".join(f"select client_id, '{r[0]}' as feature, {r[0]} as v from x" for r in STATED)
    + f"""), r as (select client_id, feature, row_number() over (partition by feature order by client_id) as i from l),
    d as (select feature, v as donor, row_number() over (partition by feature order by md5(concat(feature, ':42:', client_id)), client_id) as i from l),
    w as (select x.*, feature, donor, {_stated_sql(False)} as base, {_stated_sql(True)} as uplift from r join d using (feature, i) join x using (client_id))"""
)


@AREA.query(
    "permutation_changes",
    "clients train purchases",
    PERMUTED_SQL + " select feature, count(*) as n_rows, round(avg(abs(uplift - base)), 6) as mean_abs_uplift_change, round(avg(uplift - base), 6) as mean_uplift_change from w group by feature",
)
def permutation_changes(study):
    """Score changes of a learner with stated coefficients when a feature is shuffled."""
    moved = explain.moved_scores(_stated_model(), _plain_features(study), [r[0] for r in STATED])
    change = F.col("uplift") - F.col("base")
    return moved.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.abs(change)), 6).alias("mean_abs_uplift_change"),
        F.round(F.avg(change), 6).alias("mean_uplift_change"),
    )


@AREA.query("native_importance")
def native_importance(study):
    model, _ = _fitted(study, "two_model", "random_forest")
    return learners.importance_table(model, study.spark)


@AREA.query("model_segments")
def model_segments(study):
    model, frame = _fitted(study)
    scored = model.arm_probabilities(frame).withColumn("uplift", F.col("p_treated") - F.col("p_control"))
    scored = cut_lineage(scored.select("client_id", "uplift", "p_treated", "p_control"))
    return policy.segment_means(policy.five_way_segments(scored))


@AREA.query("submission")
def submission(study):
    scoring = cut_lineage(_features(study, "scoring"))
    spec = _spec("two_model")
    scores = learners.refit_and_score(_labelled(study), scoring, spec)
    path = artifacts.write_submission(scores, f"{artifacts.scratch_folder(study.spark)}/submission")
    return study.spark.read.schema("client_id string, uplift double").option("header", True).csv(path)


STUDY_COLUMNS = {
    "clients": "age client_id first_issue_date first_redeem_date gender",
    "products": "brand_id is_alcohol is_own_trademark level_1 product_id segment_id",
    "purchases": "client_id express_points_received express_points_spent product_id product_quantity purchase_sum "
    "regular_points_received regular_points_spent store_id transaction_datetime transaction_id",
    "scoring": "client_id",
    "train": "client_id target treatment_flg",
}


def _fingerprint_select(table, columns):
    text = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns.split())
    parts = [f"coalesce(sum(cast(('0x' || substr(h, {1 + 8 * q}, 8)) as bigint)), 0)::varchar" for q in range(4)]
    return f"select '{table}' as table_name, count(*) as n_rows, concat_ws('-', {', '.join(parts)}) as row_hash_sum from (select md5({text}) as h from {table})"


STUDY_VIEWS = "clients train scoring products purchases"
FINGERPRINT_SQL = " union all ".join(_fingerprint_select(*item) for item in STUDY_COLUMNS.items())


@AREA.query("dataset_fingerprint", STUDY_VIEWS, FINGERPRINT_SQL)
def dataset_fingerprint(study):
    return artifacts.content_fingerprint(_tables(study))


# Family, builder version, feature groups, semantic name, source tables, policy, windows.
_GROUPS = '"basket","demographic","points","rfm"'
_LONG = '"account_lifecycle","age_buckets","basket","demographic","points","redeem_behavior","rfm"'
FAMILY_ROWS = (
    ("base", "v1", '"demographic"', "null", '"clients"', "pre_issue_only", ""),
    ("rfm", "v1", '"demographic","rfm"', "null", '"clients","purchases"', "pre_issue_only", ""),
    ("engagement", "v1", '"demographic","points"', "null", '"clients","purchases"', "pre_issue_only", "30"),
    ("windowed", "v1", _GROUPS, "null", '"clients","purchases"', "pre_issue_only", "30"),
    ("rfm_baseline", "v1", _GROUPS, '"rfm_baseline"', '"clients","purchases"', "pre_issue_only", "30,60,90"),
    ("human_semantic_v1", "v2", _LONG, '"human_semantic_v1"', '"clients","purchases"', "post_issue_history", "30,60,90"),
    ("hybrid_safe_semantic_v1", "v2", _LONG, '"hybrid_safe_semantic_v1"', '"clients","purchases"', "safe_history_until_reference", "30,60,90"),
    ("product_category", "v1", '"basket","demographic","points","product_category","rfm"', "null",
     '"clients","products","purchases"', "pre_issue_only", "30"),
    ("diversity", "v1", '"basket","demographic","diversity","points","product_category","rfm"', "null",
     '"clients","products","purchases"', "pre_issue_only", "30"),
)
REGISTRY_SQL = f"""
    with t as ({FINGERPRINT_SQL}),
    p as (select substr(sha256('[' || string_agg('["' || table_name || '",' || n_rows || ',"' || row_hash_sum || '"]', ',' order by table_name) || ']'), 1, 12) as fp from t),
    f as (select family, version, substr(sha256('{{"builder_version":"' || version || '","feature_groups":[' || feature_groups
        || '],"interactions":[],"reference_date":null,"semantic_name":' || semantic || ',"source_tables":[' || sources
        || '],"temporal_policy":"' || policy || '","windows_days":[' || windows || ']}}'), 1, 12) as feature_recipe_id
      from (values {", ".join(str(row) for row in FAMILY_ROWS)}) v(family, version, feature_groups, semantic, sources, policy, windows))
    select family, feature_recipe_id, substr(sha256('{{"builder_version":"' || version || '","dataset_fingerprint":"' || fp
        || '","feature_recipe_id":"' || feature_recipe_id || '"}}'), 1, 12) as feature_artifact_id from f, p"""


@AREA.query("recipe_registry", STUDY_VIEWS, REGISTRY_SQL)
def recipe_registry(study):
    """The id of each recipe family and of its artifact over these tables."""
    fingerprint = artifacts.dataset_fingerprint(_tables(study))
    recipes = {name: recipe_family(name) for name in RECIPE_FAMILIES}
    rows = [(name, recipe.recipe_id, recipe.artifact_id(fingerprint)) for name, recipe in recipes.items()]
    return study.spark.createDataFrame(rows, "family string, feature_recipe_id string, feature_artifact_id string")


@AREA.query(
    "artifact_roundtrip",
    "clients train",
    f"with {client_sql()} select demo.*, age_le25, age_26_35, age_36_45, age_46_55, age_56_65, age_gt65 from demo join ages using (client_id)",
)
def artifact_roundtrip(study):
    tables = _tables(study)
    recipe = Recipe(feature_groups=("demographic", "age_buckets"))
    folder = artifacts.scratch_folder(study.spark)
    fingerprint = artifacts.dataset_fingerprint(tables)
    first = artifacts.build_artifacts([recipe], tables, folder, fingerprint)[0]
    again = artifacts.build_artifacts([recipe], tables, folder, fingerprint)[0]  # reused, not rebuilt
    if first["artifact_path"] != again["artifact_path"]:
        raise ValueError("the artifact was not reused")
    return study.spark.read.parquet(again["artifact_path"])


@AREA.query("artifacts_many_recipes")
def artifacts_many_recipes(study):
    tables = _tables(study)
    folder = artifacts.scratch_folder(study.spark)
    fingerprint = artifacts.dataset_fingerprint(tables)
    recipes = [recipe_family(name, PINNED) for name in RECIPE_FAMILIES]
    artifacts.build_artifacts(recipes, tables, folder, fingerprint)
    return artifacts.read_metadata(study.spark, folder).select(
        "feature_groups", "feature_recipe_id", "temporal_policy", "row_count", F.size("columns").alias("n_columns")
    )


LEDGER_COLUMNS = ("experiment_id", "seq", "run_id", "hypothesis_id", "status", "qini_auc", "split_seed")


def _ledger(study, folder):
    half = F.col("seq") % 2 == 0
    for part in (study.trials.filter(half), study.trials.filter(~half)):
        ledger.append(part, f"{folder}/ledger")
    return ledger.load(study.spark, f"{folder}/ledger")


@AREA.query("ledger_roundtrip", "gains", f"select {', '.join(LEDGER_COLUMNS)}, (select sum(gain) from gains g where g.run_id = trials.run_id and pos < 2) as zero_cost_gain from trials")
def ledger_roundtrip(study):
    gain = F.col("policy_gain")
    total = gain["top_10pct_zero_cost"] + gain["top_20pct_zero_cost"]
    return _ledger(study, artifacts.scratch_folder(study.spark)).select(*LEDGER_COLUMNS, total.alias("zero_cost_gain"))


@AREA.query(
    "ledger_patch",
    "trials",
    """select run_id, case when seq % 10 = 0 then 'supported' end as verdict, case when seq % 10 = 0 and seq % 20 <> 0 then 0.5::double else qini_auc end as qini_auc,
      status from trials""",
)
def ledger_patch(study):
    folder = artifacts.scratch_folder(study.spark)
    records = _ledger(study, folder)
    patches = records.filter("seq % 10 = 0").select(
        "run_id", F.lit("supported").alias("verdict"), F.when(F.col("seq") % 20 != 0, 0.5).alias("qini_auc")
    )
    return ledger.rewrite(ledger.patched(records, patches), f"{folder}/ledger_v2").select("run_id", "verdict", "qini_auc", "status")


@AREA.query(
    "plan_specs",
    "trials",
    """select experiment_id as plan_id, run_id as spec_id, hypothesis_id, template_name, uplift_learner_family as learner_family, base_estimator,
      feature_recipe_id, split_seed, 'depth' as name, cast(seq % 4 + 1 as varchar) as value from trials""",
)
def plan_specs(study):
    specs = F.struct(
        F.col("run_id").alias("spec_id"), "hypothesis_id", "template_name",
        F.col("uplift_learner_family").alias("learner_family"), "base_estimator", "feature_recipe_id", "split_seed",
        F.create_map(F.lit("depth"), (F.col("seq") % 4 + 1).cast("string")).alias("params"),
    )
    # One plan document per trial, with a single spec.
    path = f"{artifacts.scratch_folder(study.spark)}/plans"
    study.trials.select(F.col("experiment_id").alias("plan_id"), F.array(specs).alias("trial_specs")).write.json(path)
    found = ledger.plan_specs(study.spark, path, one_per_file=False)
    return found.drop("params").join(ledger.spec_params(found), "spec_id")


@AREA.query(
    "split_roundtrip",
    "train",
    SPLIT_SQL + " select split, count(*) as n_rows from split group by split",
)
def split_roundtrip(study):
    path = artifacts.write_split(split.stratified_split(study.train), f"{artifacts.scratch_folder(study.spark)}/split")
    return study.spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@AREA.query(
    "modeling_parts",
    "clients train purchases",
    SPLIT_SQL
    + """, sums as (select client_id, round(sum(purchase_sum), 2) as spent, round(sum(regular_points_received), 2) as points from purchases group by client_id)
    select split, client_id, treatment_flg, target, age::double as age, datediff('day', first_issue_date::date, first_redeem_date::date)::double as redeem_delay,
      spent, points from split join clients using (client_id) left join sums using (client_id)""",
)
def modeling_parts(study):
    """The modeling table of every part, as read back after its manifest was written."""
    folder = artifacts.scratch_folder(study.spark)
    labelled = _plain_features(study).withColumn("redeem_delay", F.col("redeem_delay").cast("double"))
    artifacts.write_modeling_parts(labelled, folder)
    parts = [artifacts.read_modeling_part(study.spark, folder, p).withColumn("split", F.lit(p)) for p in artifacts.SPLIT_PARTS]
    return quality.union(parts)


CSV_COLUMNS = ("client_id", "age", "first_issue_date", "gender")
CSV_KINDS = {"age": "number", "first_issue_date": "timestamp"}
CSV_SQL = """
    k as (select client_id, cast(client_id as bigint) as k, case when k % 23 = 7 then '' else client_id end as id,
      case when k % 13 = 2 then 'unknown' else coalesce(cast(cast(age as bigint) as varchar), '') end as age,
      case when k % 11 = 4 then 'never' else coalesce(strftime(first_issue_date, '%Y-%m-%d'), '') end as issued, coalesce(gender, '') as gender from clients),
    l as (select *, case when k % 19 = 5 then client_id when k % 17 = 3 then concat_ws(',', id, age, issued, gender, 'moved') end as line from k),
    p as (select 'wrong_number_of_fields' as problem, line as example from l where line is not null
      union all select 'missing_key', null from l where line is null and id = ''
      union all select 'unreadable_age', nullif(id, '') from l where line is null and age = 'unknown'
      union all select 'unreadable_first_issue_date', nullif(id, '') from l where line is null and issued = 'never'
      union all select 'readable', null from l where line is null and id <> '' and age <> 'unknown' and issued <> 'never')"""


@AREA.query(
    "csv_read_problems",
    "clients",
    f"with {CSV_SQL} select 'clients' as table_name, problem, count(*) as n_rows, min(example) as example from p group by problem",
)
def csv_read_problems(study):
    """Clients written as CSV, some lines of them broken, and what reading finds."""
    key = F.col("client_id").cast("long")
    fields = [
        F.when(key % 23 == 7, "").otherwise(F.col("client_id")),
        F.when(key % 13 == 2, "unknown").otherwise(F.coalesce(F.col("age").cast("long").cast("string"), F.lit(""))),
        F.when(key % 11 == 4, "never").otherwise(F.coalesce(F.date_format("first_issue_date", "yyyy-MM-dd"), F.lit(""))),
        F.coalesce("gender", F.lit("")),
    ]
    line = F.when(key % 19 == 5, F.col("client_id")).when(key % 17 == 3, F.concat_ws(",", *fields, F.lit("moved")))
    lines = study.clients.select(line.otherwise(F.concat_ws(",", *fields)).alias(",".join(CSV_COLUMNS)))
    path = f"{artifacts.scratch_folder(study.spark)}/clients"
    lines.write.options(header=True, sep="\u0001").csv(path)  # whole lines: nothing is quoted
    rows = source_tables.read_csv_lines(study.spark, path, CSV_COLUMNS)
    found = source_tables.csv_problems(rows, "clients", "client_id", CSV_KINDS).drop("n_files")
    kept = source_tables.readable_rows(rows, "client_id", CSV_KINDS).agg(
        F.lit("clients").alias("table_name"), F.lit("readable").alias("problem"),
        F.count("client_id").alias("n_rows"), F.lit(None).cast("string").alias("example"),
    )
    return found.unionByName(kept)


OUTPUT_TOTALS = {
    "scores": ("uplift", 4), "diagnostics": ("treated", 0), "metrics": ("n", 0), "uplift_at_k": ("uplift_at_k", 4),
    "policy_gain": ("gain", 4), "decile_table": ("n", 0), "qini_curve": ("qini", 3), "uplift_curve": ("uplift", 3),
}
OUTPUTS_SQL = f"""{SPLIT_SQL},
    ms as (select s.split as surface, m.* from model_scores m join (select client_id, split from split where split <> 'train') s using (client_id)),
    runs as (select surface, run_id, count(*) as n, sum(treatment_flg) as nt from ms group by all),
    ok as (select ms.* from ms join runs using (surface, run_id) where nt between 1 and runs.n - 1),
    {ranked_sql("ok", "surface, run_id").strip().removeprefix("with")},
    k as (select surface, run_id, cutoff, max(n) as n, {rate_sql(top_sql("cutoff"))} as r from rk, {CUTOFFS_SQL} group by all)
    select surface, 'scores' as table_name, run_id, count(*) as n_rows, round(sum(uplift)::double, 4) as total from ms group by all
    union all select surface, 'diagnostics', run_id, 1, nt::double from runs
    union all select surface, 'metrics', run_id, 1, case when nt between 1 and n - 1 then n end::double from runs
    union all select surface, 'uplift_at_k', run_id, count(*), round(sum(r), 4) from k group by all
    union all select surface, 'policy_gain', run_id, count(*), round(sum(round(r * ceil(n * cutoff) - ceil(n * cutoff) * cost, 6)), 4)
      from k, (values (0.0::double), (0.05::double), (0.2::double)) c(cost) group by all
    union all select surface, 'decile_table', run_id, least(10, max(n)), max(n)::double from rk group by all
    union all select surface, 'qini_curve', run_id, count(*), round(sum(qini), 3) from pts group by all
    union all select surface, 'uplift_curve', run_id, count(*), round(sum(uplift_rate), 3) from pts group by all"""


@AREA.query("trial_outputs", "train model_scores", OUTPUTS_SQL)
def trial_outputs(study):
    """Every table of the validation and the held-out surface, as read back: rows and a total per run."""
    folder = artifacts.scratch_folder(study.spark)
    parts = split.stratified_split(study.train).select("client_id", "split")
    found = []
    for surface in ("validation", "test"):
        scores = study.model_scores.join(parts.filter(F.col("split") == surface).select("client_id"), "client_id")
        artifacts.write_trial_outputs(scores, folder, surface)
        tables = artifacts.read_trial_outputs(study.spark, folder, surface)
        for name, (column, digits) in OUTPUT_TOTALS.items():
            total = F.round(F.sum(F.col(column).cast("double")), digits).alias("total")
            sums = tables[name].groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), total)
            found.append(sums.select(F.lit(surface).alias("surface"), F.lit(name).alias("table_name"), "run_id", "n_rows", "total"))
    return quality.union(found)
