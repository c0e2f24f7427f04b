import math
import random
import re
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stockloom.operators import features, horizon
from stockloom.plans import jobs
from stockloom.settings import FeatureSpec
from stockloom.sources import snapshots
from stockloom.sources.tables import Tables
from tests.conftest import kept_sales

N = len(kept_sales())
FIVE = FeatureSpec(lags=(1, 3), windows=(2, 5), aggregations=("mean", "std", "min", "max", "sum"))


def panel(spark, seed=1):
    """Series of unequal length, with gaps between days."""
    draw = random.Random(seed)
    rows = []
    for series, length in (("a", 90), ("b", 31), ("c", 1), ("d", 6)):
        day = date(2020, 1, 1)
        for _ in range(length):
            rows.append(("S", series, day, draw.randrange(20), 1.0))
            day += timedelta(days=draw.choice([1, 1, 1, 2, 9]))
    schema = "store_id string, sku_id string, date date, units_sold int, sell_price double"
    return rows, spark.createDataFrame(rows, schema)


def expected_features(rows, spec):
    out = {}
    for key in {r[1] for r in rows}:
        series = sorted(r for r in rows if r[1] == key)
        units = [r[3] for r in series]
        for i, r in enumerate(series):
            values = {f"units_sold_lag_{n}": units[i - n] if i >= n else None for n in spec.lags}
            for w in spec.windows:
                seen = units[max(0, i - w) : i]
                values[f"units_sold_roll_mean_{w}"] = statistics.fmean(seen) if seen else None
                values[f"units_sold_roll_std_{w}"] = (
                    statistics.stdev(seen) if len(seen) > 1 else None
                )
                values[f"units_sold_roll_min_{w}"] = min(seen, default=None)
                values[f"units_sold_roll_max_{w}"] = max(seen, default=None)
                values[f"units_sold_roll_sum_{w}"] = sum(seen) if seen else None
            out[key, r[2]] = values
    return out


def assert_features(frame, expected):
    rows = frame.collect()
    assert len(rows) == len(expected)
    for row in rows:
        for name, value in expected[row.sku_id, row.date].items():
            if isinstance(value, float):
                assert math.isclose(row[name], value, rel_tol=1e-9, abs_tol=1e-9), name
            else:
                assert row[name] == value, name


def test_features_count_rows_and_never_see_the_current_day(spark):
    rows, sales = panel(spark)
    assert_features(features.history_features(sales, FIVE), expected_features(rows, FIVE))


@pytest.mark.parametrize("block_days", [1, 7, 20, 64, 500])
def test_blocks_give_the_same_features(spark, block_days):
    rows, sales = panel(spark, seed=block_days)
    blocked = features.history_features(sales, FIVE, block_days)
    assert_features(blocked, expected_features(rows, FIVE))
    assert blocked.columns == features.history_features(sales, FIVE).columns


@pytest.mark.parametrize("block_days", [3, 10, 10_000, None])
def test_null_keys_and_repeated_days(spark, block_days):
    """NULL keys form a series, a NULL date comes first, rows of one day go by their values."""
    rows, _ = panel(spark, seed=9)
    messy = [(None if k == "b" else s, k, d, u, p) for s, k, d, u, p in rows]
    messy += [("S", "a", None, 4, 1.0), ("S", "a", None, 2, 1.0), (None, None, None, 1, None)]
    messy += [("S", "a", rows[i][2], rows[i][3] + 1, 2.0) for i in (5, 6, 40)]
    schema = "store_id string, sku_id string, date date, units_sold int, sell_price double"
    found = features.history_features(spark.createDataFrame(messy, schema), FIVE, block_days).collect()
    assert len(found) == len(messy)
    last = date(1, 1, 1)
    for key in {(r[0], r[1]) for r in messy}:
        series = sorted(
            (r for r in messy if r[:2] == key),
            key=lambda r: (r[2] is not None, r[2] or last, r[3], r[4] is not None, r[4] or 0),
        )
        units = [r[3] for r in series]
        expected = [
            (str(r), units[i - 3] if i >= 3 else None, sum(units[max(0, i - 5) : i]) if i else None)
            for i, r in enumerate(series)
        ]
        own = [r for r in found if (r.store_id, r.sku_id) == key]
        got = sorted(
            ((str(tuple(r)[:5]), r.units_sold_lag_3, r.units_sold_roll_sum_5) for r in own), key=str
        )
        assert got == sorted(expected, key=str)


def test_no_task_gets_a_whole_long_series(spark, tmp_path):
    """One scan and one shuffle deal out (series, block); besides, only block ends travel again."""
    start = date(2000, 1, 1)
    rows = [("S", "long", start + timedelta(days=i), i % 9, 1.0) for i in range(4000)]
    schema = "store_id string, sku_id string, date date, units_sold int, sell_price double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sales")
    sales = spark.read.parquet(f"{tmp_path}/sales")
    spec = FeatureSpec(lags=(1, 7), windows=(7,))
    blocked = features.history_features(sales, spec, block_days=500)
    whole = features.history_features(sales, spec)
    assert blocked.exceptAll(whole).isEmpty() and blocked.count() == 4000
    blocked = features.history_features(sales, spec, block_days=500)
    blocked.collect()
    plan = blocked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
    by_block, by_series = (re.findall(rf"Exchange hashpartitioning\(store_id#\d+, sku_id#\d+{x}, \d+\)", plan) for x in (r", _block#\d+L", ""))
    assert len(by_block) == 2 and len(by_series) == 1  # one is what the other reuses


def test_one_shuffle_and_one_sort_for_all_windows(spark):
    _, sales = panel(spark)
    frame = features.history_features(sales, FeatureSpec())
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_change_at_a_day_moves_no_feature_up_to_that_day(spark):
    _, sales = panel(spark)
    day = date(2020, 2, 20)
    changed = sales.withColumn(
        "units_sold", F.when(F.col("date") == day, 999).otherwise(F.col("units_sold"))
    )
    before, after = (
        features.history_features(s, FIVE).where(F.col("date") <= day).select("sku_id", "date", *FIVE.history_names)
        for s in (sales, changed)
    )
    assert before.exceptAll(after).isEmpty()


def test_store_rows_equal_sales_rows_and_snap_follows_the_state(project):
    store = snapshots.read_snapshot(project)
    assert store.count() == N
    calendar = project.require("calendar")
    wrong = store.join(calendar.select("date", "snap_ca", "snap_wi"), "date").where(
        "snap_flag != CASE state_id WHEN 'CA' THEN snap_ca WHEN 'WI' THEN snap_wi ELSE false END"
    )
    assert wrong.isEmpty()


def test_snap_flag_is_false_elsewhere(spark):
    frame = spark.createDataFrame(
        [("NY", True, True, True), ("WI", False, False, True)],
        "state_id string, snap_ca boolean, snap_tx boolean, snap_wi boolean",
    )
    flags = frame.select(features.snap_flag(F.col("state_id"))).collect()
    assert [f[0] for f in flags] == [False, True]


def test_view_join_agrees_with_the_single_pass(project):
    tables = [project.require(n) for n in ("skus", "stores", "calendar")]
    sales = project.require("sales")
    single = features.feature_store(sales, *tables)
    joined = features.feature_store_from_view(
        sales, features.history_features(sales, FeatureSpec()), *tables
    )
    assert single.columns == joined.columns
    assert single.exceptAll(joined).isEmpty() and joined.exceptAll(single).isEmpty()


def test_snapshots_count_up_and_keep_lineage(spark, raw_dir, tmp_path):
    tables = Tables(spark, str(tmp_path))
    with pytest.raises(snapshots.SnapshotError, match="no feature snapshots"):
        snapshots.read_snapshot(tables)
    jobs.ingest_raw(tables, str(raw_dir))
    first = jobs.build_features(tables, git_commit="one")
    second = jobs.build_features(tables, FeatureSpec(lags=(1,)), git_commit=None)
    assert (first.version, second.version) == (1, 2)
    assert second.table_name == "feature_store_v2"
    assert first.config_hash != second.config_hash
    assert first.row_count == N and first.min_date == min(d for _, _, d in kept_sales())
    assert snapshots.latest_snapshot(tables).first().version == 2
    assert snapshots.snapshot_lineage(tables, "feature_store_v1").first().git_commit == "one"
    assert "units_sold_lag_7" in snapshots.read_snapshot(tables, "feature_store_v1").columns
    assert "units_sold_lag_7" not in snapshots.read_snapshot(tables).columns
    with pytest.raises(snapshots.SnapshotError, match="feature_store_v9"):
        snapshots.snapshot_name(tables, "feature_store_v9")


def test_unlisted_data_is_ignored_and_replaced(project, spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    store = snapshots.read_snapshot(project)
    tables.replace("feature_store_v1", store.limit(3))  # a build that died before its listing
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read_snapshot(tables)
    assert snapshots.build_snapshot(tables, store, FeatureSpec()).version == 1
    assert snapshots.read_snapshot(tables).count() == N


def test_horizons_of_a_snapshot_need_no_shuffle(project, spark):
    """Snapshots are clustered by series, for every session that reads them."""
    sales = "store_id string, sku_id string, date date, units_sold int"
    for tables in (project, Tables(spark.newSession(), project.root)):
        store = snapshots.read_snapshot(tables)
        rows = horizon.assemble_horizons(store, FeatureSpec(), 5)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert rows.count() > 0
        again = features.history_features(store.select(*[c.split()[0] for c in sales.split(", ")]), FIVE)
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()


def test_a_clustered_table_is_replaced_like_others(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    for n in range(4):
        rows = spark.range(10 * (n + 1)).selectExpr("id % 7 AS `the key`", "id", "named_struct('a b', array(id)) AS s")
        written = tables.replace("t", rows, ["the key"] if n != 2 else ())
        assert written.count() == tables.require("t").count() == 10 * (n + 1)
        assert tables.require("t").select("s.`a b`").first()[0] is not None
    assert len(list((tmp_path / "t").iterdir())) == 2
