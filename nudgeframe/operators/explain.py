"""Which features move with a score, representative cases and driver checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nudgeframe.functions import clean
from nudgeframe.operators import metrics
from nudgeframe.operators.metrics import ENTITY, SCORE, TARGET, TREATMENT
from nudgeframe.operators.quality import melted
from nudgeframe.plans.prefix import running
from nudgeframe.plans.rank_correlation import spearman
from nudgeframe.session import cut_lineage

# Name prefixes of behavioural features and leakage keywords.
BEHAVIOUR_PREFIXES = ("purchase_", "txn_", "recency_", "basket_", "points_", "avg_transaction_", "product_")
LEAKAGE_KEYWORDS = ("post", "after", "response", "outcome", "target", "redeem")


def direction(association: Column) -> Column:
    return (
        F.when(association >= 0, "higher_feature_higher_uplift")
        .when(association < 0, "higher_feature_lower_uplift")
        .otherwise("unknown")
    )


def usable_features(long: DataFrame) -> DataFrame:
    """Features with at least two known and two distinct values.

    Different extremes show two distinct values without counting distincts.
    """
    stats = long.groupBy("feature").agg(
        F.count("value").alias("known"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return stats.filter((F.col("known") >= 2) & (F.col("low") < F.col("high"))).select("feature")


def feature_association(features: DataFrame, scores: DataFrame, columns: list[str], top_n: int = 10) -> DataFrame:
    """Spearman correlation of every feature with the score, strongest first."""
    joined = scores.select(ENTITY, F.col(SCORE).cast("double").alias(SCORE)).join(
        features.select(ENTITY, *columns), ENTITY
    )
    long = melted(joined, [SCORE], columns).filter(F.col("value").isNotNull())
    result = spearman(long, ["feature"], "value", SCORE).filter("n >= 2 and correlation is not null")
    table = result.select(
        "feature",
        F.round("correlation", 4).alias("spearman_with_uplift"),
        direction(F.col("correlation")).alias("direction"),
    )
    return table.orderBy(F.abs("spearman_with_uplift").desc(), "feature").limit(top_n)


def representative_cases(scores: DataFrame, size: int = 3) -> DataFrame:
    """Best, worst and middle customers of the ranking."""
    placed = running(
        scores.select(ENTITY, F.col(SCORE).cast("double").alias(SCORE)),
        [],
        [(SCORE, True), (ENTITY, False)],
        {"rank": F.lit(1).cast("long")},
        totals=True,
    ).withColumnRenamed("total_rank", "n")
    rank, n = F.col("rank"), F.col("n")
    middle = F.floor(n / 2)
    groups = {
        "highest_uplift": rank <= size,
        "lowest_uplift": rank > n - size,
        "near_boundary": (rank >= middle) & (rank <= middle + 2),
    }
    named = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in groups.items()]))
    return placed.withColumn("case_group", F.explode(named)).select("case_group", "rank", ENTITY, SCORE)


def case_context(cases: DataFrame, features: DataFrame, drivers: list[str]) -> DataFrame:
    """Driver values of the cases with z-scores inside the (nine-row) case set."""
    joined = cases.select("case_group", ENTITY).join(features.select(ENTITY, *drivers), ENTITY)
    long = melted(joined, ["case_group", ENTITY], drivers)
    whole = Window.partitionBy("feature")
    spread = F.stddev_pop("value").over(whole)
    z = (F.col("value") - F.avg("value").over(whole)) / F.when(spread == 0, 1.0).otherwise(spread)
    return long.select("case_group", ENTITY, "feature", "value", F.round(F.coalesce(z, F.lit(0.0)), 6).alias("z"))


def _ranked_drivers(importance: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.abs("importance").desc(), "feature")
    return importance.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)


def driver_semantics(importance: DataFrame) -> DataFrame:
    """Per run: does age lead, and is a behavioural feature in the first five?"""
    top = _ranked_drivers(importance, 5)
    behavioural = F.lit(False)
    for prefix in BEHAVIOUR_PREFIXES:
        behavioural = behavioural | F.col("feature").startswith(prefix)
    first = F.max(F.when(F.col("position") == 1, F.col("feature")))
    return top.groupBy("run_id").agg(
        first.alias("top_feature"),
        (first == "age_clean").alias("age_dominance_warning"),
        F.bool_or(behavioural).alias("behavioral_top5_present"),
    )


def leakage_flags(importance: DataFrame, keywords=LEAKAGE_KEYWORDS) -> DataFrame:
    """Per run: does a leakage-like name appear among the five strongest?"""
    suspicious = F.lower("feature").rlike("|".join(keywords))
    return _ranked_drivers(importance, 5).groupBy("run_id").agg(
        F.bool_or(suspicious).alias("leakage_suspected"), F.count_if(suspicious).alias("suspicious_features")
    )


def driver_stability(importance: DataFrame) -> DataFrame:
    """One row: features in every run's top three; two or more mean stable.

    Fewer than two runs count as stable with nothing in common.
    """
    top = _ranked_drivers(importance, 3).select("run_id", "feature").distinct()
    runs = importance.agg(F.count_distinct("run_id"))
    per = top.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn("runs", runs.scalar())
    common = F.collect_list(F.when((F.col("n") == F.col("runs")) & (F.col("runs") >= 2), F.col("feature")))
    return per.agg(F.max("runs").alias("runs"), F.sort_array(common).alias("consistent_top3")).select(
        "runs",
        ((F.coalesce("runs", F.lit(0).cast("long")) < 2) | (F.size("consistent_top3") >= 2)).alias("stable"),
        "consistent_top3",
    )


def sample_rows(df: DataFrame, n: int | None, seed=42) -> DataFrame:
    """A repeatable uniform sample of ``n`` rows, or all rows where none is asked for."""
    if n is None:
        return df
    return df.orderBy(clean.hash_order(F.col(ENTITY), seed), ENTITY).limit(n)


def swapped(sample: DataFrame, columns: list[str], seed=42) -> DataFrame:
    """(id, feature, own, donor): every row once per feature, with another row's value of it.

    Receivers and donors are numbered by ``running``, which never puts a feature's
    rows into one task; only narrow rows travel.
    """
    shuffled = F.md5(F.concat("feature", F.lit(f":{seed}:"), ENTITY)).alias("__shuffle")
    long = melted(sample, [ENTITY], columns).select("*", shuffled)
    one = {"i": F.lit(1).cast("long")}
    receivers = running(long, ["feature"], [(ENTITY, False)], one).select(ENTITY, "feature", F.col("value").alias("own"), "i")
    donors = running(long, ["feature"], [("__shuffle", False), (ENTITY, False)], one).select("feature", F.col("value").alias("donor"), "i")
    return receivers.join(donors, ["feature", "i"]).select(ENTITY, "feature", "own", "donor")


def permuted_copies(sample: DataFrame, columns: list[str], seed=42) -> DataFrame:
    """Whole rows for learners that need them: each row once per feature, that feature's value swapped."""
    return swapped(sample, columns, seed).join(sample, ENTITY).select(
        "feature",
        *[c for c in sample.columns if c not in columns],
        *[F.when(F.col("feature") == c, F.col("donor")).otherwise(clean.number_or_null(F.col(c))).alias(c) for c in columns],
    )


def _linear_parts(model) -> list | None:
    """(fitted model, arm) of a linear learner's probabilities, or None for other learners."""
    if model.family == "two_model":
        parts = [(model.treated, None), (model.control, None)]
    elif model.family == "solo_model":
        parts = [(model.model, 1.0), (model.model, 0.0)]
    else:
        parts = [(model.model, None)]
    fitted = [p is not None and (p.linear is not None or p.pipeline is None) for p, _ in parts]
    return parts if all(fitted) else None


def _score_of(model, probabilities: list[Column]) -> Column:
    if len(probabilities) == 2:
        return probabilities[0] - probabilities[1]
    return 2 * probabilities[0] - 1 if model.family == "class_transformation" else probabilities[0]


def moved_scores(model, frame: DataFrame, columns: list[str], keep: tuple | list = (), seed=42) -> DataFrame:
    """(feature, id, keep..., base, uplift): the score with one feature's values shuffled.

    In a linear learner a swapped value changes one term of the margin, so rows
    carry their margins and the two values only. Other learners score whole copies.
    """
    parts = _linear_parts(model)
    if parts is None:
        scored = cut_lineage(model.score(frame.select(ENTITY, *keep, *columns)))
        sample, base = scored.drop(SCORE), scored.select(ENTITY, F.col(SCORE).alias("base"))
        moved = model.score(permuted_copies(sample, columns, seed)).select("feature", ENTITY, *keep, SCORE)
        return moved.join(base, ENTITY).select("feature", ENTITY, *keep, "base", SCORE)
    cleaned = frame.select(ENTITY, *keep, *[clean.number_or_null(F.col(c)).alias(c) for c in columns])
    names = [f"__m{k}" for k in range(len(parts))]
    margins = [p.linear.margin(arm) if p.linear else F.lit(0.0) for p, arm in parts]
    rows = cut_lineage(cleaned.select("*", *[m.alias(n) for m, n in zip(margins, names)]))

    def of(part, margin):
        return 1 / (1 + F.exp(-margin)) if part.linear else F.lit(float(part.constant))

    def term(part, feature):
        if part.linear is None or feature not in part.linear.inputs:
            return 0.0, 0.0
        place = part.linear.inputs.index(feature)
        return float(part.linear.weights[place]), float(part.linear.medians[place])

    # A row a feature.
    table = [(c, *[x for p, _ in parts for x in term(p, c)]) for c in columns]
    schema = "feature string, " + ", ".join(f"__w{k} double, __f{k} double" for k in range(len(parts)))
    terms = frame.sparkSession.createDataFrame(table, schema)
    pairs = swapped(rows.select(ENTITY, *columns), columns, seed).join(rows.select(ENTITY, *keep, *names), ENTITY).join(terms, "feature")
    shifted = [
        F.col(n) + F.col(f"__w{k}") * (F.coalesce("donor", f"__f{k}") - F.coalesce("own", f"__f{k}")) for k, n in enumerate(names)
    ]
    base = _score_of(model, [of(p, F.col(n)) for (p, _), n in zip(parts, names)])
    after = _score_of(model, [of(p, m) for (p, _), m in zip(parts, shifted)])
    return pairs.select("feature", ENTITY, *keep, base.alias("base"), after.alias(SCORE))


def permutation_sensitivity(model, frame: DataFrame, top_n: int = 10, max_samples: int | None = None, seed=42) -> DataFrame:
    """Mean absolute score change when a feature's values are shuffled.

    All features are scored in one pass of narrow rows (whole rows for tree learners).
    """
    columns = [c for c in model.feature_columns if c in frame.columns]
    sample = cut_lineage(sample_rows(frame.select(ENTITY, *columns), max_samples, seed))
    usable = usable_features(melted(sample, [], columns))
    change = (
        moved_scores(model, sample, columns, seed=seed)
        .join(usable, "feature", "left_semi")
        .groupBy("feature")
        .agg(F.round(F.avg(F.abs(F.col(SCORE) - F.col("base"))), 6).alias("mean_abs_uplift_change"))
    )
    scored = model.score(sample)
    long = melted(scored.withColumnRenamed(SCORE, "base"), ["base"], columns).filter(F.col("value").isNotNull())
    association = spearman(long, ["feature"], "value", "base").select("feature", "correlation")
    return (
        change.join(association, "feature", "left")
        .select(
            "feature",
            "mean_abs_uplift_change",
            F.round("correlation", 4).alias("spearman_with_uplift"),
            direction(F.col("correlation")).alias("direction"),
        )
        .orderBy(F.col("mean_abs_uplift_change").desc(), "feature")
        .limit(top_n)
    )


def permutation_importance(model, labelled: DataFrame, max_samples: int | None = None, seed=42) -> DataFrame:
    """Drop in normalised Qini when a feature's values are shuffled."""
    columns = [c for c in model.feature_columns if c in labelled.columns]
    picked = sample_rows(labelled.select(ENTITY, TREATMENT, TARGET, *columns), max_samples, seed)
    moved = cut_lineage(moved_scores(model, picked, columns, [TREATMENT, TARGET], seed))
    base = metrics.normalized_qini(model.score(picked).select(ENTITY, TREATMENT, TARGET, SCORE))
    moved = metrics.normalized_qini(moved.drop("base"), ["feature"])
    drop = base.scalar() - F.col("normalized_qini_auc")
    return moved.select("feature", F.round(drop, 6).alias("normalized_qini_drop")).orderBy(
        F.col("normalized_qini_drop").desc(), "feature"
    )
