"""Artifacts, ledger and plan documents on disk."""

import json

import pytest
from pyspark.sql import functions as F

from nudgeframe.catalog.inputs import Study
from nudgeframe.config import Recipe
from nudgeframe.operators import split
from nudgeframe.session import shared_folder
from nudgeframe.sources import artifacts, ledger
from nudgeframe.sources import tables as source_tables
from nudgeframe.sources.stages import StageRecord
from tests.conftest import SMALL_DIR


@pytest.fixture(scope="module")
def tables(spark):
    study = Study(spark, SMALL_DIR)
    return {name: getattr(study, name) for name in ("clients", "train", "scoring", "purchases", "products")}


def test_artifacts_are_reused_until_the_data_changes(spark, tables, tmp_path):
    recipes = [Recipe(feature_groups=("demographic",)), Recipe(feature_groups=("rfm",)), Recipe(feature_groups=("basket",), windows_days=(30,))]
    folder = str(tmp_path)
    built = artifacts.build_artifacts(recipes, tables, folder, "v1")
    assert [r["row_count"] for r in built] == [120] * 3
    stamp = spark.read.parquet(built[1]["artifact_path"]).select("_metadata.file_modification_time").first()
    again = artifacts.build_artifacts(recipes, tables, folder, "v1")
    assert again == [dict(r) for r in built]
    assert spark.read.parquet(built[1]["artifact_path"]).select("_metadata.file_modification_time").first() == stamp
    changed = artifacts.build_artifacts(recipes[:1], tables, folder, "v2")
    assert changed[0]["feature_artifact_id"] != built[0]["feature_artifact_id"]
    scoring = artifacts.build_artifacts(recipes[:1], tables, folder, "v1", cohort="scoring")
    assert scoring[0]["row_count"] == 30
    assert artifacts.read_metadata(spark, folder).count() == 5


def test_fingerprint_sees_one_changed_cell(tables):
    base = artifacts.dataset_fingerprint({"train": tables["train"]})
    assert base == artifacts.dataset_fingerprint({"train": tables["train"].repartition(3)})
    edited = tables["train"].withColumn("target", F.when(F.col("client_id") == "1", 1 - F.col("target")).otherwise(F.col("target")))
    assert artifacts.dataset_fingerprint({"train": edited}) != base


def test_ledger_append_load_and_patch(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("r1", 1, "success", 0.2)], "run_id string, seq long, status string, qini_auc double")
    two = spark.createDataFrame([("r2", 2, "failed", "boom")], "run_id string, seq long, status string, error string")
    ledger.append(one, path)
    ledger.append(two, path)
    loaded = ledger.load(spark, path)
    assert [r["error"] for r in loaded.orderBy("seq").collect()] == [None, "boom"]
    patches = spark.createDataFrame([("r1", "supported", None)], "run_id string, verdict string, qini_auc double")
    second = ledger.rewrite(ledger.patched(loaded, patches), str(tmp_path / "ledger_v2"))
    rows = {r["run_id"]: r for r in second.collect()}
    assert rows["r1"]["verdict"] == "supported" and rows["r1"]["qini_auc"] == 0.2 and rows["r2"]["verdict"] is None
    with pytest.raises(ValueError, match="unknown ledger fields"):
        ledger.patched(loaded, patches.withColumnRenamed("verdict", "mood"))


def test_ledger_bytes_written_stay_below_the_records_text(spark, tmp_path):
    rows = [(f"e{i % 50}", i, f"r{i}", "two_model_logistic_regression", {"top_10pct_zero_cost": float(i % 101)}) for i in range(2000)]
    records = spark.createDataFrame(rows, "experiment_id string, seq long, run_id string, template_name string, policy_gain map<string,double>").coalesce(1)
    ledger.conform(records).write.json(str(tmp_path / "ledger"))  # a ledger begun as plain text
    text = sum(p.stat().st_size for p in (tmp_path / "ledger").glob("part-*"))
    ledger.append(records.withColumn("seq", F.col("seq") + 2000), str(tmp_path / "ledger"))
    loaded = ledger.load(spark, str(tmp_path / "ledger"))
    assert sum(p.stat().st_size for p in (tmp_path / "ledger").glob("part-*")) < 1.25 * text
    assert loaded.agg(F.count_distinct("seq")).first()[0] == 4000
    ledger.rewrite(loaded.coalesce(1), str(tmp_path / "ledger_v2"))
    assert sum(p.stat().st_size for p in (tmp_path / "ledger_v2").glob("part-*")) < 0.5 * text


def test_plan_documents(spark, tmp_path):
    plan = {"plan_id": "p", "trial_specs": [{"spec_id": "s1", "params": {"max_depth": 3, "lr": 0.1}}, {"spec_id": "s2", "params": {}}]}
    (tmp_path / "plan.json").write_text(json.dumps(plan, indent=2))
    specs = ledger.plan_specs(spark, str(tmp_path / "*.json"))
    assert specs.count() == 2
    assert {(r["spec_id"], r["name"], r["value"]) for r in ledger.spec_params(specs).collect()} == {("s1", "max_depth", "3"), ("s1", "lr", "0.1")}


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_split_sink(spark, tables, tmp_path, file_format):
    parts = split.stratified_split(tables["train"])
    path = artifacts.write_split(parts, str(tmp_path / "split"), file_format)
    back = spark.read.option("header", True).format(file_format).load(path)
    assert back.count() == 120 and back.filter("split = 'test'").count() == 18
    with pytest.raises(ValueError):
        artifacts.write_split(parts, path, "xlsx")


def test_recipe_ids_match_spark_hash(spark):
    rows = artifacts.recipe_ids({"a": Recipe(), "b": Recipe(windows_days=(30,))}, spark).collect()
    assert all(r["recipe_id"] == r["recomputed_id"] for r in rows)


def test_fingerprint_follows_every_table(spark, tables):
    """One changed purchase row, or a null against an empty text, gives other fingerprints."""
    before = artifacts.dataset_fingerprint(tables)
    assert before == artifacts.dataset_fingerprint(dict(reversed(tables.items())))
    lines = tables["purchases"]
    first = lines.agg(F.min(F.struct("transaction_id", "product_id"))).first()[0]
    hit = (F.col("transaction_id") == first[0]) & (F.col("product_id") == first[1])
    changed = lines.withColumn("purchase_sum", F.when(hit, F.col("purchase_sum") + 1).otherwise(F.col("purchase_sum")))
    assert artifacts.dataset_fingerprint(tables | {"purchases": changed}) != before
    texts = [spark.createDataFrame([row], "a string, b string") for row in (("x", None), ("x", ""), ("x|", ""), (None, "x"))]
    assert len({artifacts.dataset_fingerprint({"t": t}) for t in texts}) == 4


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_trial_outputs_count_their_rows_and_isolate_bad_runs(spark, tmp_path):
    rows = [(run, f"c{i}", i % 2, i % 3 % 2, float(i % 7)) for run in ("1", "02") for i in range(40)]
    rows += [("one_arm", f"c{i}", 1, 0, 0.5) for i in range(5)]
    scores = spark.createDataFrame(rows, "run_id string, client_id string, treatment_flg int, target int, uplift double")
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="unfinished"):
        artifacts.read_trial_outputs(spark, folder)
    artifacts.write_trial_outputs(scores, folder)
    found = artifacts.read_trial_outputs(spark, folder)
    listed = {r["table_name"]: r["n_rows"] for r in found.pop("manifest").collect()}
    assert listed == {name: table.count() for name, table in found.items()}
    assert sorted(map(tuple, found["scores"].collect())) == sorted(rows)
    problems = {r["run_id"]: (r["problem"], r["n"]) for r in found["metrics"].collect()}
    assert problems == {"1": (None, 40), "02": (None, 40), "one_arm": ("both arms are required", None)}
    assert listed["decile_table"] == 20 and listed["qini_curve"] == 80 and listed["diagnostics"] == 3


def test_modeling_parts_are_complete_or_refused(spark, tmp_path):
    rows = [(f"c{i}", i % 2, i // 2 % 2, float(i)) for i in range(40)]
    schema = "client_id string, treatment_flg int, target int, x double"
    folder = str(tmp_path / "good")
    with pytest.raises(ValueError, match="unfinished"):
        artifacts.read_modeling_part(spark, folder, "train")
    manifest = artifacts.write_modeling_parts(spark.createDataFrame(rows, schema), folder)
    listed = {r["table_name"]: r["n_rows"] for r in manifest.collect()}
    parts = {p: artifacts.read_modeling_part(spark, folder, p) for p in artifacts.SPLIT_PARTS}
    assert listed == {p: t.count() for p, t in parts.items()} and sum(listed.values()) == 40
    assert sorted(map(tuple, artifacts.quality.union(parts.values()).collect())) == sorted(rows)
    with pytest.raises(ValueError, match="no such part"):
        artifacts.read_modeling_part(spark, folder, "holdout")
    bad = str(tmp_path / "bad")
    with pytest.raises(ValueError, match="without an id: 1, with bad labels: 2"):
        artifacts.write_modeling_parts(spark.createDataFrame([*rows, (None, 1, None, 0.0), ("z", 1, 2, 0.0)], schema), bad)
    with pytest.raises(ValueError, match="unfinished"):
        artifacts.read_modeling_part(spark, bad, "train")


def test_broken_csv_lines_become_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('client_id,age,day,city\n1,2,,M\n3\n4,5,,F,x\n,5,,\n\n6,"a b",2020-01-01,"F,G"\n')
    (tmp_path / "b.csv").write_text("client_id,age,day,city\n7,nan,soon,\n8\n")
    rows = source_tables.read_csv_lines(spark, str(tmp_path), ("client_id", "age", "day", "city"))
    assert rows.count() == 7
    kinds = {"age": "number", "day": "timestamp"}
    found = {r["problem"]: tuple(r)[2:] for r in source_tables.csv_problems(rows, "t", "client_id", kinds).collect()}
    assert found == {
        "wrong_number_of_fields": (3, 2, "3"), "missing_key": (1, 1, None),
        "unreadable_age": (2, 2, "6"), "unreadable_day": (1, 1, "7"),
    }
    assert [tuple(r) for r in source_tables.readable_rows(rows, "client_id", kinds).collect()] == [("1", "2", None, "M")]
    assert source_tables.csv_problems(rows, "t", "client_id").count() == 2
    assert source_tables.csv_problems(rows.limit(0), "t", "client_id", kinds).count() == 0
    with pytest.raises(source_tables.TableReadError, match="missing"):
        source_tables.read_csv_lines(spark, str(tmp_path / "none"), ("a",))


def test_stages_are_written_once_in_order(spark, tmp_path):
    record = StageRecord(spark, str(tmp_path), "s1", ("first", "second", "last"))
    built = []

    def build(n):
        def table():
            built.append(n)
            return spark.range(n)

        return table

    with pytest.raises(ValueError, match=r"second comes after \['first'\]"):
        record.run("second", build(2))
    assert record.run("first", build(1)).count() == 1
    assert record.run("first", build(9)).count() == 1 and built == [1]
    again = StageRecord(spark, str(tmp_path), "s1", ("first", "second", "last"))
    again.run("second", build(2))
    again.run("last", build(3))
    assert again.finished() == {"first": 1, "second": 2, "last": 3} and built == [1, 2, 3]
    with pytest.raises(ValueError, match="other settings"):
        StageRecord(spark, str(tmp_path), "s2", ("first", "second", "last")).finished()
    (tmp_path / "record" / "second").rename(tmp_path / "gone")
    with pytest.raises(ValueError, match=r"sealed since \['last'\]"):
        again.run("second", build(2))


def test_fingerprint_adds_digests_as_longs(spark, tables):
    """Decimals meet once a task, not once a row; the sums are those of the decimals."""
    df = artifacts.content_fingerprint({"train": tables["train"]})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(20,0)" in plan and not any("conv(" in line and "decimal" in line for line in plan.splitlines())
    empty = artifacts.content_fingerprint({"t": tables["train"].filter("false")}).first()
    assert tuple(empty) == ("t", 0, "0-0-0-0")
