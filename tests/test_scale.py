"""What a task holds, and what is shuffled or broadcast, stays in bounds as tables grow."""

import re

import pytest
from pyspark.sql import functions as F

from ratersight.functions import text as X
from ratersight.operators import features, ratings, tables
from ratersight.plans import catalog
from ratersight.sources import files, panels, sinks

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_partitions_follow_sessions(spark, monkeypatch):
    monkeypatch.setattr(panels, "GRID_SESSIONS", 10)
    assert panels.grid(spark, SF).rdd.getNumPartitions() == 15  # 150 sessions


@pytest.mark.parametrize("name", ["item_f1", "icc_family", "evaluator_by_item", "wide_by_run", "wide_sheet", "total_direct_metrics"])
def test_code_is_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its code only when it has run
    try:
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan(catalog.QUERIES[name](spark, SF), "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000  # larger methods are interpreted by the JVM


@pytest.mark.parametrize("name", ["expected_grid_gaps", "first_bad_item_failures", "progress_counts"])
def test_cells_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF))


def test_against(spark):
    keys = "session long, item int, model int, run int"
    expected = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 0, 0), (None, 1, 0, 0)], keys)
    rated = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 2, 0, 0, 1), (1, 2, 0, 0, 1), (None, 1, 0, 0, 0), (9, 1, 0, 0, 0)], keys + ", failure int")
    assert [tuple(r) for r in ratings.progress(expected, rated).collect()] == [(0, 1, 2, 2)]
    assert sorted(map(tuple, ratings.gaps(expected, rated).collect())) == [(0, 0, 1, 1), (0, 0, 3, 1)]
    assert [tuple(r) for r in ratings.first_bad(expected, rated).collect()] == [(0, 0, 2, 1)]


def test_years_past_9999(spark):
    row = spark.range(1).select(X.epoch_text(F.lit(500_000_000_000)).alias("a"), X.epoch_text(F.lit(0)).alias("b")).first()
    assert tuple(row) == ("17814-05-16 00:53:20", "1970-01-01 00:00:00")


def test_pauses_with_lists(spark):
    assert "long" in catalog.QUERIES["pause_stats"](spark, SF).columns
    own = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 0.5)], "k string, gap double")
    assert {r.k: r.long for r in tables.pauses(own, ["k"], "gap", 1.5, lists=True).collect()} == {"a": [3.0, 2.0], "b": []}


def test_sheets_are_numbered_without_sorting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 7)
    own = spark.range(100).select((F.col("id") % 2).cast("int").alias("item"), F.lit("x").alias("item_name"), F.lit(0).alias("model"), (100 - F.col("id")).alias("session"))
    sinks.write_sheets(own, str(tmp_path / "book"))
    back = files.sheet_rows(spark, str(tmp_path / "book"))
    assert "Window" not in plan(back.select("session", "place")).split("BroadcastExchange")[0]
    got = sorted((int(r.item), r.place, int(r.session)) for r in back.collect())
    assert got == [(i, k + 1, v) for i in (0, 1) for k, v in enumerate(sorted(100 - x for x in range(100) if x % 2 == i))]
    assert len(list((tmp_path / "book").glob("*/*.csv.gz"))) >= 15


def test_seeds_are_summed_without_sorting(spark):
    seeds = features.seed_means(panels.error_cells(spark, SF))
    assert "SortAggregate" not in plan(seeds)


def test_annotated_cells_are_summed_without_sorting(spark):
    seeds = features.seed_means(panels.annotated(panels.panel(spark, SF).withColumn("failure", F.col("rating").isNull().cast("int")), spark))
    assert "SortAggregate" not in plan(seeds) and "HashAggregate" in plan(seeds)
    assert {"total_params", "architecture"} <= set(panels.with_texts(seeds, spark).columns)


def test_cells_of_lines_are_shuffled_by_order_and_patient_alone(spark):
    own = plan(features.seed_means(panels.error_cells(spark, SF), ("patient", "piece", "num_trans_tokens")), "extended")
    assert own.count("REPARTITION_BY_NUM") == 3 and set(re.findall(r"hashpartitioning\((\w+)#[^)]*\), ENSURE", own)) <= {"model"}


def test_patients_in_pieces(spark, monkeypatch):
    keys = ["session", "item", "model"]
    whole = catalog.QUERIES["seed_features_with_totals"](spark, SF).toPandas().sort_values(keys).reset_index(drop=True)
    monkeypatch.setattr(panels, "SESSIONS_OF_PIECE", 3)
    cells = panels.error_cells(spark, SF)
    assert cells.filter("piece >= 0").select("patient", "piece").distinct().count() > 10
    cut = catalog.QUERIES["seed_features_with_totals"](spark, SF).toPandas().sort_values(keys).reset_index(drop=True)
    assert whole.drop(columns="architecture").sub(cut.drop(columns="architecture")).abs().max().max() < 2e-5 and len(whole) > 5000
