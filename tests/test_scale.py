"""How rows are dealt out, on rows of one's own: tasks stay small whatever the size of the panel."""

from datetime import date
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from checks import queries
from stockloom.operators import boosting, features, forest, ingest, trees
from stockloom.session import write_and_read
from stockloom.settings import FeatureSpec
from stockloom.sources import order_lines
from stockloom.sources.order_lines import OrderLinePanel
from stockloom.sources.tables import Tables


def panel_of(spark, series: int, weeks: int) -> OrderLinePanel:
    """A panel whose weekly rows are given: one for every series and week."""
    panel = OrderLinePanel(spark, "nowhere")
    panel.__dict__["weekly"] = spark.range(series * weeks).selectExpr(
        "'CA' AS state_id",
        "concat('S', id div 1000000) AS store_id",
        f"concat('I', id div {weeks}) AS item_id",
        f"cast(2000 + id % {weeks} AS int) AS week",
        *[f"CAST(1 AS bigint) AS u{i}" for i in range(1, 8)],
        "CAST(7 AS bigint) AS units",
        "CAST(700 AS bigint) AS cents",
        f"date_from_unix_date(cast(2000 + id % {weeks} AS int) * 7 - 5) AS lo",
        f"date_from_unix_date(cast(2000 + id % {weeks} AS int) * 7 + 1) AS hi",
    )
    return panel


def test_the_panel_has_as_many_tasks_as_its_days_need(spark, monkeypatch):
    monkeypatch.setattr(order_lines, "DAYS_PER_TASK", 70)
    small, large = panel_of(spark, 10, 4), panel_of(spark, 40, 4)
    assert (small.partitions, large.partitions) == (4, 16)
    assert large.daily_sales.rdd.getNumPartitions() == 16
    assert large.daily_sales.count() == 40 * 4 * 7


def test_blocks_are_not_put_together_by_the_size_of_narrow_rows(spark):
    spec = FeatureSpec(lags=(1,), windows=(2,), aggregations=("sum",))
    rows = [("S", "I", date(2022, 1, d), d, 1.0) for d in range(1, 11)]
    sales = spark.createDataFrame(rows, "store_id string, sku_id string, date date, units_sold int, sell_price double")
    cut = features.history_features(sales, spec, block_days=3, partitions=7)
    assert "_block" in (plan := cut._jdf.queryExecution().executedPlan().toString()) and "7), REPARTITION_BY_NUM" in plan
    assert sorted(cut.collect()) == sorted(features.history_features(sales, spec).collect())


def test_a_copy_of_a_clustered_table_has_one_file_for_each_bucket(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    rows = spark.range(0, 1000, 1, 6).selectExpr("id % 97 AS k", "id")
    tables.replace("a", rows, ("k",), 5)
    tables.replace("b", tables.require("a"), ("k",), 5)
    for name in ("a", "b"):
        files = [f.name for f in Path(tmp_path, name).rglob("part-*.parquet")]
        assert len(files) == 5
        assert sorted(r.id for r in tables.require(name).collect()) == list(range(1000))


def test_horizons_are_assembled_from_rounded_rows(spark, monkeypatch):
    rows = [("S", "I", date(2022, 1, d), d, 1.00000049) for d in range(1, 29)]
    sales = spark.createDataFrame(rows, "store_id string, sku_id string, date date, units_sold int, sell_price double")
    monkeypatch.setattr(queries.Star, "assembled_from", lambda self, with_features: (sales, None))
    found = queries.horizon_dataset(spark, "nowhere")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("round(")
    assert {r.sell_price for r in found.collect()} == {1.0}


def test_the_wide_file_is_packed_into_one_column(spark):
    rows = [("a_S", "a", "d", "c", "S", "CA", 1, None, 3), ("b_S", "b", "d", "c", "S", "CA", None, None, 0)]
    names = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string"
    wide = spark.createDataFrame(rows, f"{names}, d_9 int, d_10 int, d_11 int")
    packed = ingest.packed_days(wide)
    assert packed.columns == [*wide.columns[:6], "units"]
    long = ingest.long_packed(packed, ingest.day_columns(wide))
    assert sorted(long.collect()) == sorted(ingest.long_sales(wide).collect())
    assert sorted(long.collect()) == [("S", "a", "d_11", 3), ("S", "a", "d_9", 1), ("S", "b", "d_11", 0)]


def test_category_means_are_known_to_be_small(spark):
    """Rows to describe are not shuffled towards the means, whatever Spark would find out on the way."""
    days = [("S", f"I{i}", date(2022, 1, d), d) for i in range(50) for d in range(1, 9)]
    train = spark.createDataFrame(days, "store_id string, sku_id string, origin_date date, target int")
    means = forest.TargetMeans.fit(train, ["store_id", "sku_id"], ("store_id", "sku_id", "origin_date"))
    for training in (True, False):
        plan = means.apply(train, training)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("store", [lambda rows: boosting._Stored(rows).rows, lambda rows: write_and_read(rows, "blocks")])
def test_readers_of_stored_blocks_hold_a_few_at_a_time(spark, store):
    """A task reads a group of rows of a file at once; blocks are large, and a file holds any number of them."""
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        rows = spark.range(0, 1000, 1, 1).selectExpr("cast(id AS double) AS a", "cast(id % 7 AS double) AS target")
        kept = store(trees.blocks(rows, ["a"], [[float(i) for i in range(0, 1000, 40)]]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    (file,) = [pq.ParquetFile(f.removeprefix("file:")) for f in kept.inputFiles()]
    groups = [file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)]
    assert sum(groups) == 100 and max(groups) <= 16
    found = [c for row in kept.collect() for c in trees.unpacked([trees.block({"target": np.frombuffer(row.target), "bins": np.frombuffer(row.bins, np.uint8)})])]
    assert [t for c in found for t in c["target"]] == [i % 7 for i in range(1000)]
    assert [b for c in found for b in c["bins"][:, 0]] == [-(-i // 40) for i in range(961)] + [25] * 39
