"""Uplift learners (batched logistic fits, Spark ML trees) and batches of trials.

Every learner scores by plain DataFrame expressions over fitted pipelines, so a
scoring pass is one distributed transform. Feature tables should be written (or
checkpointed) before fitting: the optimisers read their input many times.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import product
from math import ceil, log2

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nudgeframe.config import Columns, EvalPolicy, SplitPolicy, stable_hash
from nudgeframe.functions import clean
from nudgeframe.operators import metrics
from nudgeframe.operators.features import feature_columns
from nudgeframe.operators.logistic import ARM as _ARM
from nudgeframe.operators.logistic import Job, LinearModel, fit_jobs
from nudgeframe.operators.quality import union
from nudgeframe.operators.split import stratified_split
from nudgeframe.plans.selection import medians
from nudgeframe.session import cut_lineage, over_all_cores

FAMILIES = ("random", "response_model", "two_model", "solo_model", "class_transformation")

# Default settings of every base estimator.
DEFAULTS = {
    "logistic_regression": {"max_iter": 500, "C": 1.0},
    "gradient_boosting": {"n_estimators": 50, "learning_rate": 0.05, "max_depth": 2},
    "random_forest": {"n_estimators": 200, "max_depth": 6, "min_samples_leaf": 50, "max_features": "sqrt"},
    "xgboost": {
        "n_estimators": 300, "max_depth": 4, "learning_rate": 0.05,
        "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 10,
    },
    "lightgbm": {
        "n_estimators": 300, "num_leaves": 15, "min_child_samples": 50,
        "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8,
    },
    "catboost": {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1},
}
# Regularised settings tried when tuning.
TUNING_GRIDS = {
    "logistic_regression": (
        {"C": 0.3, "max_iter": 1000},
        {"C": 1.0, "max_iter": 1000},
        {"C": 3.0, "max_iter": 1000},
    ),
    "gradient_boosting": (
        {"n_estimators": 200, "learning_rate": 0.03, "max_depth": 2, "min_samples_leaf": 50, "subsample": 0.7},
        {"n_estimators": 120, "learning_rate": 0.03, "max_depth": 2, "min_samples_leaf": 100, "subsample": 0.7},
    ),
    "random_forest": (
        {"n_estimators": 200, "max_depth": 6, "min_samples_leaf": 50, "max_features": "sqrt"},
        {"n_estimators": 300, "max_depth": 4, "min_samples_leaf": 100, "max_features": "sqrt"},
    ),
    "xgboost": (
        {"n_estimators": 300, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8,
         "colsample_bytree": 0.8, "min_child_weight": 10, "reg_lambda": 10.0},
        {"n_estimators": 400, "max_depth": 2, "learning_rate": 0.03, "subsample": 0.7,
         "colsample_bytree": 0.7, "min_child_weight": 20, "reg_lambda": 10.0},
    ),
    "lightgbm": (
        {"n_estimators": 300, "max_depth": 4, "learning_rate": 0.05, "num_leaves": 15, "min_child_samples": 50,
         "subsample": 0.8, "colsample_bytree": 0.8, "reg_lambda": 10.0},
        {"n_estimators": 400, "max_depth": 3, "learning_rate": 0.03, "num_leaves": 15, "min_child_samples": 100,
         "subsample": 0.7, "colsample_bytree": 0.7, "reg_lambda": 10.0},
    ),
}


@dataclass(frozen=True)
class TrialSpec:
    """One learner configuration to fit and judge."""

    run_id: str
    family: str
    estimator: str = "logistic_regression"
    params: dict = field(default_factory=dict)
    split_seed: int = 42

    @property
    def params_hash(self) -> str:
        return stable_hash(self.params)


def tuning_specs(base: TrialSpec, seeds=(42, 7, 99, 123)) -> list[TrialSpec]:
    """Every parameter set of the estimator under every seed, the base's own seed included.

    A spec is named by its base, the place of its parameter set (from 1) and its seed.
    """
    sets = dict(enumerate(TUNING_GRIDS.get(base.estimator) or (base.params,), start=1))
    own = [] if base.split_seed in seeds else [base.split_seed]
    grid = product(sets, dict.fromkeys([*own, *seeds]))
    return [replace(base, run_id=f"{base.run_id}__tune_p{n}_s{seed}", params=dict(sets[n]), split_seed=seed) for n, seed in grid]


def make_classifier(estimator: str, params: dict, seed: int, n_rows: int):
    """Spark ML tree classifier with the estimator's defaults and overrides.

    The three external boosters run as gradient-boosted trees with their presets.
    """
    if estimator not in DEFAULTS or estimator == "logistic_regression":
        raise ValueError(f"unsupported base estimator: {estimator}")
    p = DEFAULTS[estimator] | params
    common = {"featuresCol": "features", "labelCol": "label"}
    if estimator == "random_forest":
        return RandomForestClassifier(
            numTrees=int(p["n_estimators"]),
            maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]),
            featureSubsetStrategy=str(p["max_features"]),
            seed=seed,
            **common,
        )
    leaves = p.get("num_leaves")
    depth = int(p.get("max_depth") or ceil(log2(leaves)))
    smallest = next((p[k] for k in ("min_samples_leaf", "min_child_samples", "min_child_weight") if k in p), 1)
    share = float(p.get("colsample_bytree", 1.0))
    return GBTClassifier(
        maxIter=int(p["n_estimators"]),
        stepSize=float(p["learning_rate"]),
        maxDepth=depth,
        minInstancesPerNode=int(smallest),
        subsamplingRate=float(p.get("subsample", 1.0)),
        featureSubsetStrategy="all" if share >= 1.0 else str(share),
        seed=seed,
        **common,
    )


@dataclass(frozen=True)
class ProbabilityModel:
    """A fitted linear model or pipeline, or a constant when training saw a single class."""

    inputs: tuple
    pipeline: PipelineModel | None
    constant: float = 0.0
    linear: LinearModel | None = None

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        if self.linear is not None:
            return df.withColumn(name, self.linear.probability())
        if self.pipeline is None:
            return df.withColumn(name, F.lit(float(self.constant)))
        out = self.pipeline.transform(df).withColumn(name, vector_to_array("probability")[1])
        return out.select(*df.columns, name)

    def importance(self) -> dict[str, float]:
        if self.linear is not None:
            return {name: abs(value) for name, value in zip(self.inputs, self.linear.scaled)}
        if self.pipeline is None:
            return {}
        values = self.pipeline.stages[-1].featureImportances.toArray()
        return {name: float(value) for name, value in zip(self.inputs, values)}


def _numeric(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: clean.number_or_null(F.col(c)) for c in columns})


def fit_probability(df: DataFrame, columns: list[str], label, estimator: str, params: dict, seed: int) -> ProbabilityModel:
    """Imputation by exact medians, and a tree classifier.

    One aggregate tells the class balance and which columns hold any value. The
    projected training rows are persisted for the fit, since every round of the
    medians and every tree level rereads them.
    """
    data = _numeric(df, columns).select(*columns, label.cast("double").alias("label"), F.lit(0).alias("cell"))
    data = over_all_cores(data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_pipeline(data, columns, estimator, params, seed)
    finally:
        data.unpersist()


def _fit_pipeline(data: DataFrame, columns: list[str], estimator: str, params: dict, seed: int) -> ProbabilityModel:
    facts = data.agg(
        F.count("label").alias("n"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.avg("label").alias("rate"),
        *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)],
    ).first()
    counts = {c: facts[f"c{i}"] for i, c in enumerate(columns)}
    used = tuple(c for c in columns if counts[c])
    if facts["n"] == 0 or facts["low"] == facts["high"] or not used:
        return ProbabilityModel(used, None, facts["rate"] or 0.0)
    middle = medians(data, list(used), {"all": [0]}, {("all", c): counts[c] for c in used})
    filled = [f"__in_{c}" for c in used]
    values = ", ".join(f"coalesce(`{c}`, {middle['all', c]!r}D) as `__in_{c}`" for c in used)
    stages = [
        SQLTransformer(statement=f"select *, {values} from __THIS__"),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
        make_classifier(estimator, params, seed, facts["n"]),
    ]
    return ProbabilityModel(used, Pipeline(stages=stages).fit(data))


@dataclass(frozen=True)
class UpliftModel:
    """A fitted learner; ``score`` needs no label columns."""

    family: str
    estimator: str
    feature_columns: tuple
    seed: int
    columns: Columns = Columns()
    model: ProbabilityModel | None = None
    treated: ProbabilityModel | None = None
    control: ProbabilityModel | None = None

    def arm_probabilities(self, df: DataFrame) -> DataFrame:
        """Adds p_treated and p_control (families without two arms use the
        score itself against zero, or the same response twice)."""
        frame = _numeric(df, self.feature_columns)
        if self.family == "two_model":
            return self.control.probability(self.treated.probability(frame, "p_treated"), "p_control")
        if self.family == "solo_model":
            frame = self.model.probability(frame.withColumn(_ARM, F.lit(1.0)), "p_treated")
            frame = self.model.probability(frame.withColumn(_ARM, F.lit(0.0)), "p_control")
            return frame.drop(_ARM)
        if self.family == "response_model":
            return self.model.probability(frame, "p_treated").withColumn("p_control", F.col("p_treated"))
        return self.score(df).withColumn("p_treated", F.col(self.columns.score)).withColumn("p_control", F.lit(0.0))

    def score(self, df: DataFrame) -> DataFrame:
        score = self.columns.score
        if self.family == "random":
            return df.withColumn(score, clean.hash_uniform(F.col(self.columns.entity), self.seed, 13))
        frame = _numeric(df, self.feature_columns)
        if self.family == "response_model":
            return self.model.probability(frame, score)
        if self.family == "class_transformation":
            return self.model.probability(frame, score).withColumn(score, 2 * F.col(score) - 1)
        both = self.arm_probabilities(frame)
        return both.withColumn(score, F.col("p_treated") - F.col("p_control")).drop("p_treated", "p_control")

    def linear_score(self) -> Column:
        """Score of a linear learner as one column over its cleaned inputs."""
        p = lambda m, arm=None: m.linear.probability(arm) if m.linear is not None else F.lit(float(m.constant))
        if self.family == "two_model":
            return p(self.treated) - p(self.control)
        if self.family == "solo_model":
            return p(self.model, 1.0) - p(self.model, 0.0)
        return 2 * p(self.model) - 1 if self.family == "class_transformation" else p(self.model)

    def native_importance(self) -> dict[str, float]:
        """Tree importances or absolute coefficients, of the treated arm if any."""
        source = self.treated if self.family == "two_model" else self.model
        return {} if source is None else source.importance()


def fit_uplift(
    train: DataFrame,
    family: str,
    estimator: str = "logistic_regression",
    params: dict | None = None,
    seed: int = 42,
    columns: Columns = Columns(),
    ignore=("split", "fold"),
) -> UpliftModel:
    """Fit one learner on labelled rows; every other column is a feature."""
    if family not in FAMILIES:
        raise ValueError(f"unsupported learner family: {family}")
    if family != "random" and estimator not in DEFAULTS:
        raise ValueError(f"unsupported base estimator: {estimator}")
    names = feature_columns(train, columns, ignore)
    treatment, target = F.col(columns.treatment), F.col(columns.target)
    base = UpliftModel(family, estimator, tuple(names), seed, columns)
    params = params or {}

    if family == "random":
        return base
    if estimator == "logistic_regression":
        return fit_linear(train.withColumn("__fold", F.lit(0)), [(family, params)], {0: [0]}, seed, columns, names)[0][0]

    def fit(rows, inputs, label):
        return fit_probability(rows, inputs, label, estimator, params, seed)

    if family == "two_model":
        return replace(
            base,
            treated=fit(train.filter(treatment == 1), names, target),
            control=fit(train.filter(treatment == 0), names, target),
        )
    if family == "solo_model":
        return replace(base, model=fit(train.withColumn(_ARM, treatment.cast("double")), [*names, _ARM], target))
    if family == "class_transformation":
        return replace(base, model=fit(train, names, clean.class_transform(target, treatment)))
    return replace(base, model=fit(train, names, target))


def fit_linear(
    train: DataFrame, settings: list[tuple[str, dict]], parts: dict, seed: int, columns: Columns, names: list[str]
) -> list[dict]:
    """Logistic learners of every (family, params) on every part, all in shared passes.

    ``train`` has ``__fold``; a part is a list of the folds it trains on. The result holds, for
    each setting, {part: UpliftModel}.
    """
    # Fixed by the families: label, arms and inputs of each model of a family.
    plans = {
        "response_model": {"model": ("target", (0, 1), False)},
        "two_model": {"treated": ("target", (1,), False), "control": ("target", (0,), False)},
        "solo_model": {"model": ("target", (0, 1), True)},
        "class_transformation": {"model": ("transformed", (0, 1), False)},
    }
    treatment, target = F.col(columns.treatment), F.col(columns.target)
    rows = _numeric(train, names).select(
        treatment.cast("int").alias("arm"), F.col("__fold").alias("fold"), target.cast("double").alias("target"),
        clean.class_transform(target, treatment).cast("double").alias("transformed"), *names,
    )
    jobs, places = [], []
    for n, (family, params) in enumerate(settings):
        p = DEFAULTS["logistic_regression"] | params
        for part, folds in parts.items():
            for role, (label, arms, with_arm) in plans[family].items():
                cells = frozenset((arm, fold) for arm in arms for fold in folds)
                jobs.append(Job(label, cells, with_arm, float(p["C"]), int(p["max_iter"])))
                places.append((n, part, role))
    models = [{part: UpliftModel(family, "logistic_regression", tuple(names), seed, columns) for part in parts} for family, _ in settings]
    for (n, part, role), fitted in zip(places, fit_jobs(rows, names, jobs)):
        own = ProbabilityModel(fitted.inputs, None, fitted.constant or 0.0, None if fitted.constant is not None else fitted)
        models[n][part] = replace(models[n][part], **{role: own})
    return models


def score_equations(models: dict[str, UpliftModel], train: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """(run_id, model, n_rows, mean_label, mean_probability) of linear learners on their training rows.

    The free intercept of a fitted logistic model makes the two means equal.
    """
    treatment, target = F.col(columns.treatment), F.col(columns.target)
    names = sorted({c for m in models.values() for c in m.feature_columns})
    rows = _numeric(train, names).filter(target.isNotNull() & treatment.isNotNull())
    entries = []
    for run_id, model in models.items():
        for role in ("treated", "control", "model"):
            own = getattr(model, role)
            if own is None:
                continue
            label = clean.class_transform(target, treatment) if model.family == "class_transformation" else target
            among = {"treated": treatment == 1, "control": treatment == 0}.get(role, F.lit(True))
            p = own.linear.probability() if own.linear is not None else F.lit(float(own.constant))
            entries.append(F.when(among, F.struct(F.lit(run_id).alias("run_id"), F.lit(role).alias("model"), label.cast("double").alias("y"), p.alias("p"))))
    each = rows.withColumn(_ARM, treatment.cast("double")).select(F.explode(F.array(*entries)).alias("e")).filter("e is not null")
    means = [F.round(F.avg(f"e.{c}"), 6).alias(name) for c, name in (("y", "mean_label"), ("p", "mean_probability"))]
    return each.groupBy("e.run_id", "e.model").agg(F.count(F.lit(1)).alias("n_rows"), *means)


def importance_table(model: UpliftModel, spark, run_id: str = "model") -> DataFrame:
    rows = [(run_id, name, value) for name, value in model.native_importance().items()]
    return spark.createDataFrame(rows, "run_id string, feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def scored(model: UpliftModel, frame: DataFrame, columns: Columns = Columns()) -> DataFrame:
    """(entity, target, treatment, uplift) rows of a labelled frame."""
    return model.score(frame).select(columns.entity, columns.target, columns.treatment, columns.score)


@dataclass(frozen=True)
class TrialBatch:
    """Fitted models, validation scores of all runs in one frame, failures."""

    models: dict
    scores: DataFrame | None
    held_out: DataFrame | None
    records: list


def _fit_together(train: DataFrame, specs: list[TrialSpec], columns: Columns) -> dict[str, UpliftModel]:
    """{run_id: model} of the logistic specs among those of one seed, or nothing where they are to be fitted alone.

    A setting that cannot be fitted ends the passes of all, so each is then fitted, or fails, alone.
    """
    linear = [s for s in specs if s.family in FAMILIES[1:] and s.estimator == "logistic_regression"]
    if len(linear) < 2 or len({s.run_id for s in linear}) < len(linear):
        return {}
    names = feature_columns(train, columns, ("split", "fold"))
    rows = train.withColumn("__fold", F.lit(0))
    try:
        fitted = fit_linear(rows, [(s.family, s.params) for s in linear], {0: [0]}, linear[0].split_seed, columns, names)
    except Exception:
        return {}
    return {s.run_id: models[0] for s, models in zip(linear, fitted)}


def run_trials(
    labelled: DataFrame,
    specs: list[TrialSpec],
    policy: SplitPolicy = SplitPolicy(),
    score_held_out: bool = False,
    columns: Columns = Columns(),
    splits: dict[int, DataFrame] | None = None,
) -> TrialBatch:
    """Fit every spec on its seed's train part and score its validation part.

    Logistic specs of a seed are fitted together, in as many passes as one of them takes.
    ``splits`` passes on written splits by seed. Only the loop over a few specs runs on the driver; a spec that fails, in fitting or
    in scoring, is recorded and the batch goes on. Where a policy leaves the validation
    part empty, the test part takes its place. The test part is otherwise scored only
    on request.
    """
    splits, judged, models, records, scores, held_out = dict(splits or {}), {}, {}, [], [], []
    together = {}
    for spec in specs:
        record = {
            "run_id": spec.run_id, "uplift_learner_family": spec.family, "base_estimator": spec.estimator,
            "params_hash": spec.params_hash, "split_seed": spec.split_seed, "status": "success", "error": None,
        }
        try:
            if spec.split_seed not in splits:
                chosen = replace(policy, seed=spec.split_seed)
                splits[spec.split_seed] = cut_lineage(stratified_split(labelled, chosen, columns))
            parts = splits[spec.split_seed]
            train = parts.filter("split = 'train'")
            if spec.split_seed not in together:
                together[spec.split_seed] = _fit_together(train, [s for s in specs if s.split_seed == spec.split_seed], columns)
            model = together[spec.split_seed].get(spec.run_id)
            if model is None:
                model = fit_uplift(train, spec.family, spec.estimator, spec.params, spec.split_seed, columns)
            run = F.lit(spec.run_id).alias("run_id")
            if spec.split_seed not in judged:
                judged[spec.split_seed] = "validation" if parts.filter("split = 'validation'").head(1) else "test"
            part = parts.filter(F.col("split") == judged[spec.split_seed])
            own = cut_lineage(scored(model, part, columns).select(run, "*"))
            held = cut_lineage(scored(model, parts.filter("split = 'test'"), columns).select(run, "*")) if score_held_out else None
            models[spec.run_id] = model
            scores.append(own)
            held_out.extend([held] if score_held_out else [])
        except Exception as error:  # one broken trial must not end the batch
            record |= {"status": "failed", "error": str(error)}
        records.append(record)
    # Scores are read by several metrics: they are kept, not the models' plans.
    return TrialBatch(models, union(scores) if scores else None, union(held_out) if held_out else None, records)


def trial_results(batch: TrialBatch, spark, policy: EvalPolicy = EvalPolicy()) -> DataFrame:
    """Ledger-shaped rows: configuration, status and validation metrics."""
    schema = (
        "run_id string, uplift_learner_family string, base_estimator string, params_hash string, "
        "split_seed int, status string, error string"
    )
    rows = spark.createDataFrame([tuple(r.values()) for r in batch.records], schema)
    if batch.scores is None:
        return rows
    judged = metrics.metric_bundle_with_problems(batch.scores, ["run_id"], policy.cutoffs)
    results = rows.join(judged, "run_id", "left")
    # Scores that cannot be judged fail their run only.
    bad = F.col("problem").isNotNull()
    results = results.withColumns(
        {"status": F.when(bad, F.lit("failed")).otherwise(F.col("status")), "error": F.coalesce("error", "problem")}
    ).drop("problem")
    if batch.held_out is None:
        return results
    held = metrics.metric_bundle_with_problems(batch.held_out, ["run_id"], policy.cutoffs).drop("problem")
    return results.join(
        held.select("run_id", *[F.col(c).alias(f"held_out_{c}") for c in held.columns if c != "run_id"]), "run_id", "left"
    )


def baseline_specs(seed: int = 42, params: dict | None = None) -> list[TrialSpec]:
    """The ladder every study starts from."""
    return [
        TrialSpec("random_baseline", "random", split_seed=seed),
        *[
            TrialSpec(f"{family}_baseline", family, "logistic_regression", params or {}, seed)
            for family in ("response_model", "two_model", "solo_model")
        ],
    ]


def champion_spec(results: DataFrame, specs: list[TrialSpec], metric: str = "normalized_qini_auc") -> TrialSpec:
    """Best successful spec by a validation metric; the first wins ties."""
    order = {spec.run_id: i for i, spec in enumerate(specs)}
    rows = results.filter("status = 'success'").select("run_id", metric).collect()
    if not rows:
        raise ValueError("no successful trial to choose from")
    best = max(rows, key=lambda r: (float("-inf") if r[metric] is None else r[metric], -order[r["run_id"]]))
    return next(spec for spec in specs if spec.run_id == best["run_id"])


def refit_and_score(
    labelled: DataFrame, scoring: DataFrame, spec: TrialSpec, columns: Columns = Columns()
) -> DataFrame:
    """Refit the champion (same estimator and settings) on all labels and score
    the scoring cohort: exactly (entity, uplift)."""
    model = fit_uplift(labelled, spec.family, spec.estimator, spec.params, spec.split_seed, columns)
    return model.score(scoring).select(columns.entity, columns.score)
