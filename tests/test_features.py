"""Temporal policies, lenient cleaning, blocks and contract checks."""

import pytest
from pyspark.sql import functions as F

from nudgeframe.config import Columns, Recipe, SplitPolicy, recipe_family
from nudgeframe.functions import clean
from nudgeframe.operators import facts, feature_modes, features, quality
from nudgeframe.sources.tables import TableReadError, read_table

PURCHASE = (
    "client_id string, transaction_id string, transaction_datetime string, regular_points_received string, "
    "express_points_received string, regular_points_spent string, express_points_spent string, purchase_sum string, "
    "store_id string, product_id string, product_quantity string"
)
CLIENT = "client_id string, first_issue_date string, first_redeem_date string, age string, gender string"


def purchase(client, tx, at, total, qty="1", product="p1", points="0"):
    return (client, tx, at, points, "0", "0", "0", total, "s1", product, qty)


@pytest.fixture(scope="module")
def micro(spark):
    clients = spark.createDataFrame(
        [("c001", "2019-01-03 00:00:00", None, "30", "F"), ("c002", "2019-01-05 00:00:00", "2019-01-09", "bad", None)], CLIENT
    )
    purchases = spark.createDataFrame(
        [
            purchase("c001", "t1", "2019-01-02 10:00:00", "100"),
            purchase("c001", "t2", "2019-01-04 10:00:00", "900"),
            purchase("c002", "t3", "2019-01-04 12:00:00", "200"),
            purchase("c003", "t4", "2019-01-04 12:00:00", "200"),
        ],
        PURCHASE,
    )
    cohort = spark.createDataFrame([("c001",), ("c002",)], "client_id string")
    return cohort, clients, purchases


def build(micro, policy, **changes):
    cohort, clients, purchases = micro
    recipe = Recipe(feature_groups=("demographic", "rfm"), temporal_policy=policy, **changes)
    table = features.feature_table(recipe, cohort, clients, purchases)
    return {row["client_id"]: row.asDict() for row in table.collect()}


def test_pre_issue_policy(micro):
    rows = build(micro, "pre_issue_only", windows_days=(30,))
    assert rows["c001"]["purchase_txn_count_lifetime"] == 1
    assert rows["c001"]["purchase_sum_lifetime"] == 100.0
    assert rows["c002"]["purchase_txn_count_lifetime"] == 1
    assert rows["c001"]["recency_days_lifetime"] == pytest.approx(2.083)
    assert rows["c001"]["purchase_txn_count_30d"] == 1


def test_post_issue_policy(micro):
    rows = build(micro, "post_issue_history")
    assert (rows["c001"]["purchase_txn_count_lifetime"], rows["c001"]["purchase_sum_lifetime"]) == (1, 900.0)
    assert rows["c002"]["purchase_txn_count_lifetime"] == 0
    assert rows["c002"]["recency_days_lifetime"] == -1.0


def test_reference_date_bounds_history(micro):
    rows = build(micro, "post_issue_history", reference_date="2019-01-04T09:00:00")
    assert rows["c001"]["purchase_txn_count_lifetime"] == 0


@pytest.mark.parametrize("policy", ["pre_issue_only", "post_issue_history"])
def test_join_first_and_collapse_first_agree(micro, policy, request, spark):
    before = build(micro, policy, windows_days=(1, 30))
    request.getfixturevalue("split_small_inputs")
    assert build(micro, policy, windows_days=(1, 30)) == before


def test_lenient_cleaning(spark):
    clients = spark.createDataFrame(
        [("a", "not a date", "2019-01-01", "13", "f"), ("b", None, None, "100", "x"), ("c", "2019-02-30", None, None, "U")], CLIENT
    )
    rows = {r["client_id"]: r for r in features.client_features(clients, clients, ("age_buckets", "redeem_behavior")).collect()}
    assert rows["a"]["age_clean"] == -1 and rows["a"]["age_invalid_flag"] == 1 and rows["a"]["age_le25"] == 1
    assert rows["a"]["issue_year"] == -1 and rows["a"]["gender_F"] == 1
    assert rows["a"]["has_redeemed"] == 1 and rows["a"]["days_to_first_redeem"] == -1
    assert rows["b"]["age_clean"] == 100 and rows["b"]["gender_other"] == 1 and rows["b"]["age_gt65"] == 1
    assert rows["c"]["age_invalid_flag"] == 1 and rows["c"]["issue_date_missing_flag"] == 1


def test_collapse_takes_max_sum_and_keeps_null_keys(spark):
    lines = spark.createDataFrame(
        [
            purchase("a", "t", "2019-01-01", "10", "2", points="5"),
            purchase("a", "t", "2019-01-01", "10", "3", points="5"),
            purchase("a", None, "bad", "oops", "1"),
        ],
        PURCHASE,
    )
    rows = facts.collapse(facts.purchase_lines(lines)).orderBy(F.col("transaction_id").desc_nulls_last()).collect()
    assert (rows[0]["purchase_sum"], rows[0]["product_quantity"], rows[0]["regular_points_received"]) == (10, 5, 5)
    assert rows[1]["transaction_datetime"] is None and rows[1]["purchase_sum"] == 0


def test_transaction_at_two_times_counts_once(spark):
    lines = spark.createDataFrame(
        [purchase("a", "t", "2019-01-01", "10"), purchase("a", "t", "2019-03-01", "20")], PURCHASE
    )
    tx = facts.collapse(facts.purchase_lines(lines))
    row = features.purchase_aggregates(tx, (30,), "2019-03-02T00:00:00").first()
    assert (row["purchase_txn_count_lifetime"], row["purchase_sum_lifetime"]) == (1, 30)
    assert (row["purchase_txn_count_30d"], row["purchase_sum_30d"]) == (1, 20)


def test_no_history_gives_defaults(spark):
    cohort = spark.createDataFrame([("z",)], "client_id string")
    empty = facts.collapse(facts.purchase_lines(spark.createDataFrame([], PURCHASE)))
    row = features.purchase_features(cohort, empty, (30,), None).first()
    assert row["purchase_txn_count_30d"] == 0 and row["recency_days_lifetime"] == -1.0


def test_entropy_of_equal_and_single_categories(spark):
    lines = spark.createDataFrame(
        [purchase("a", "t1", "2019-01-01", "1", "2", "p1"), purchase("a", "t2", "2019-01-02", "1", "2", "p2"),
         purchase("b", "t3", "2019-01-02", "1", "4", "p1")],
        PURCHASE,
    )
    products = spark.createDataFrame(
        [("p1", "food", 1, "b1", 1, 0), ("p2", None, 1, "b1", 0, 1)],
        "product_id string, level_1 string, segment_id int, brand_id string, is_own_trademark int, is_alcohol int",
    )
    rows = {r["client_id"]: r for r in features.product_aggregates(facts.product_lines(lines), products, True).collect()}
    assert rows["a"]["product_level_1_entropy_lifetime"] == pytest.approx(0.693147)
    assert rows["a"]["product_level_1_unique_count_lifetime"] == 1  # null is a class, not a counted value
    assert rows["a"]["product_brand_entropy_lifetime"] == 0
    assert rows["a"]["own_trademark_quantity_share_lifetime"] == 0.5
    assert rows["b"]["product_unique_count_lifetime"] == 1


def test_feature_table_contract(spark, micro):
    cohort, clients, _ = micro
    table = features.client_features(cohort, clients)
    quality.require_feature_table(table, cohort)
    with pytest.raises(ValueError, match="duplicate_keys"):
        quality.require_feature_table(table.unionByName(table), cohort)
    with pytest.raises(ValueError, match="forbidden_columns"):
        quality.require_feature_table(table.withColumn("target", F.lit(1)), cohort)
    with pytest.raises(ValueError, match="missing_ids"):
        quality.require_feature_table(table.limit(1), cohort)


def test_shared_transactions_equal_direct_build(micro):
    cohort, clients, purchases = micro
    recipe = recipe_family("human_semantic_v1")
    shared = features.shared_transactions(cohort, purchases)
    direct = features.feature_table(recipe, cohort, clients, purchases).collect()
    assert sorted(features.feature_table(recipe, cohort, clients, purchases, collapsed=shared).collect()) == sorted(direct)


def test_tokens_skip_unknown_parts(spark, micro):
    assert feature_modes.parse_tokens("rfm + mystery + purchase_frequency") == ([("rfm", None), ("frequency", 90)], ["mystery"])
    _, clients, purchases = micro
    row = feature_modes.token_features("basket", clients, purchases).filter("customer_id = 'c001'").first()
    assert row["avg_basket_size"] == 500.0


def test_recipe_identity():
    a = Recipe(feature_groups=("rfm", "demographic", "rfm"), windows_days=(90, 30))
    b = Recipe(feature_groups=("demographic", "rfm"), windows_days=(30, 90, 30))
    assert a == b and a.recipe_id == b.recipe_id and len(a.recipe_id) == 12
    assert a.artifact_id("x") != a.artifact_id("y")
    assert Recipe(reference_date="2019-03-18").reference_date == "2019-03-18T00:00:00"
    with pytest.raises(ValueError):
        Columns(entity="target")
    with pytest.raises(ValueError):
        SplitPolicy(0.7, 0.2, 0.2)


def test_missing_table_is_named(spark, tmp_path):
    with pytest.raises(TableReadError, match="missing required table"):
        read_table(spark, str(tmp_path / "nowhere"), "csv")


def test_csv_table_and_head(spark, tmp_path):
    (tmp_path / "clients.csv").write_text("client_id,age\nb,5\na,x\n")
    table = read_table(spark, str(tmp_path / "clients.csv"), "csv")
    assert dict(table.dtypes)["age"] == "string"


def test_dataset_report_finds_problems(spark):
    train = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("s", 0, 1)], "client_id string, treatment_flg int, target int")
    scoring = spark.createDataFrame([("s", 1)], "client_id string, target int")
    clients = spark.createDataFrame([("a", None, None, None, None)], CLIENT)
    purchases = spark.createDataFrame([purchase("a", "t", "nonsense", "1")], PURCHASE)
    tables = {"clients": clients, "train": train, "scoring": scoring, "purchases": purchases}
    checks = {(r["check"], r["column_name"]): r for r in quality.dataset_checks(tables).filter("severity != 'ok'").collect()}
    assert checks["label_in_scoring", "target"]["severity"] == "error"
    assert checks["non_binary_label", "treatment_flg"]["value"] == 1
    assert checks["train_scoring_overlap", "client_id"]["value"] == 1
    assert checks["duplicate_keys", "client_id"]["value"] == 1
    assert checks["unparseable_dates", "transaction_datetime"]["value"] == 1.0
    assert checks["null_rate", "age"]["severity"] == "warning"
    assert not quality.report_verdict(quality.dataset_checks(tables)).first()["valid"]


def test_balance_flags_age(spark):
    labels = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)], "client_id string, treatment_flg int, target int")
    table = spark.createDataFrame([("a", 20.0, 1.0), ("b", 22.0, 1.0), ("c", 70.0, 1.0), ("d", 72.0, 1.0)], "client_id string, age double, flat double")
    rows = {r["feature"]: r for r in quality.balance_smd(labels, table, ["age", "flat"]).collect()}
    assert rows["age"]["smd"] == 50.0 and rows["age"]["imbalanced"]
    assert rows["flat"]["smd"] == 0.0 and not rows["flat"]["imbalanced"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_day_differences_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        start, end = (clean.timestamp_literal(t) for t in ("2019-03-09 23:30:00.25", "2019-03-10 12:00:00"))
        row = spark.range(1).select(
            clean.days_between(start, end).alias("a"),
            clean.whole_days_between(end, start).alias("b"),
            clean.days_between(start, start).alias("c"),
        ).first()
        assert row["a"] == pytest.approx(44999.75 / 86400, abs=1e-12)
        assert (row["b"], row["c"]) == (-1.0, 0.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_client_listed_twice_keeps_the_earliest_issue_date(spark):
    rows = [("a", "2019-03-01", None, "50", "F"), ("a", "2019-01-01", None, "30", "M"), ("b", None, None, "40", "F")]
    clients = spark.createDataFrame(rows, CLIENT)
    out = {r["client_id"]: r for r in features.client_features(clients.select("client_id").distinct(), clients).collect()}
    assert len(out) == 2 and out["a"]["age_clean"] == 30.0 and out["a"]["issue_month"] == 1
    assert feature_modes.token_features("demographic", clients, spark.createDataFrame([], PURCHASE), "gender").count() == 2


def test_tasks_stated_for_much_input_keep_the_rows(spark):
    key = F.col("id")
    numbers = {name: (key % 7).cast("double") for name in (*facts.POINTS, "purchase_sum", "product_quantity")}
    lines = spark.range(2000).select(
        (key % 13).cast("string").alias("client_id"), (key % 130).cast("string").alias("transaction_id"),
        F.timestamp_seconds(key % 130).alias("transaction_datetime"), *[v.alias(k) for k, v in numbers.items()],
    )
    want = sorted(map(str, features.purchase_aggregates(facts.collapse(lines)).collect()))
    spark.conf.set("spark.nudgeframe.taskBytes", "1000")
    try:
        dealt = features.purchase_aggregates(facts.collapse(lines))
        assert dealt._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
        assert sorted(map(str, dealt.collect())) == want
    finally:
        spark.conf.unset("spark.nudgeframe.taskBytes")
