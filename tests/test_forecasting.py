import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stockloom.functions import metrics
from stockloom.functions.quantiles import quantile_column, rearrange_quantiles
from stockloom.operators import backtest, horizon, split
from stockloom.operators import forest as forests
from stockloom.operators.forest import ForestQuantiles
from stockloom.operators.seasonal import SeasonalQuantiles
from stockloom.plans import jobs
from stockloom.settings import CostSpec, FeatureSpec
from stockloom.sources import run_log, snapshots
from tests.conftest import SMALL_FOREST, SMALL_FORECAST, project_dataset

SPEC = FeatureSpec()
KEY = ["store_id", "sku_id", "origin_date", "horizon"]


@pytest.fixture(scope="module")
def store(project):
    return snapshots.read_snapshot(project)


def test_columns_come_from_the_right_day(store):
    rows = horizon.assemble_horizons(store, SPEC, 3)
    assert rows.columns[:5] == ["store_id", "sku_id", "origin_date", "target_date", "horizon"]
    assert rows.columns[-1] == "target" and len(rows.columns) == 5 + 16 + 11 + 1
    by_key = {(r.store_id, r.sku_id, r.date): r for r in store.collect()}
    for row in rows.collect():
        origin = by_key[row.store_id, row.sku_id, row.origin_date]
        target = by_key[row.store_id, row.sku_id, row.target_date]
        assert (row.target_date - row.origin_date).days == row.horizon
        assert row.target == target.units_sold
        assert all(row[c] == origin[c] for c in SPEC.history_names)
        assert all(row[c] == target[c] for c in SPEC.future_names)


@pytest.mark.parametrize(("longest", "stride"), [(5, 1), (3, 7), (9, 7), (9, 2), (14, 5)])
def test_one_join_equals_the_union_of_single_horizons(store, longest, stride):
    together = horizon.assemble_horizons(store, SPEC, longest, stride)
    single = horizon.assemble_horizon(store, SPEC, 1, stride)
    for h in range(2, longest + 1):
        single = single.unionAll(horizon.assemble_horizon(store, SPEC, h, stride))
    assert together.columns == single.columns
    assert together.exceptAll(single).isEmpty() and single.exceptAll(together).isEmpty()


def test_a_missing_target_day_gives_no_row(store):
    gapped = store.where("date != DATE '2020-04-02'")
    rows = horizon.assemble_horizon(gapped, SPEC, 2)
    assert rows.where("origin_date = DATE '2020-03-31'").isEmpty()
    assert rows.where("target_date = DATE '2020-04-04'").isEmpty()


def test_stride_samples_epoch_aligned_origins(store):
    full, sampled = (horizon.assemble_horizon(store, SPEC, 1, s) for s in (1, 7))
    assert 0 < sampled.count() < full.count()
    days = [r.origin_date for r in split.origin_dates(sampled).collect()]
    assert all((d - date(1970, 1, 1)).days % 7 == 0 for d in days)


def days_frame(spark, n):
    start = date(2020, 1, 1)
    rows = [(start + timedelta(days=3 * i),) for i in range(n) for _ in range(2)]
    return start, spark.createDataFrame(rows, "origin_date date")


def test_split_counts_dates_that_occur(spark):
    start, rows = days_frame(spark, 20)
    bounds = split.chronological_bounds(rows, 3, 2)
    assert bounds.validation_start == start + timedelta(days=3 * 15)
    assert bounds.test_start == start + timedelta(days=3 * 17)
    counts = {r.split: (r.n_rows, r.n_origin_dates) for r in backtest.split_counts(rows, bounds).collect()}
    assert counts == {"train": (30, 15), "validation": (4, 2), "test": (6, 3)}
    two_way = split.two_way_bounds(rows, 5)
    assert rows.where(two_way.is_validation).count() == 10
    assert rows.where(two_way.is_test).isEmpty()


@pytest.mark.parametrize(("days", "test", "validation"), [(4, 3, 2), (5, 3, 2), (5, 0, 5)])
def test_too_few_dates(spark, days, test, validation):
    with pytest.raises(split.SplitError, match="not enough distinct origin dates"):
        split.chronological_bounds(days_frame(spark, days)[1], test, validation)


def measure(spark, actual, predicted, build):
    frame = spark.createDataFrame(list(zip(actual, predicted, strict=True)), "y double, p double")
    return frame.agg(build(F.col("y"), F.col("p"))).first()[0]


NAN = float("nan")


@pytest.mark.parametrize(
    ("build", "actual", "predicted", "expected"),
    [
        (lambda y, p: metrics.pinball_loss(y, p, 0.1), [10.0], [8.0], 0.2),
        (lambda y, p: metrics.pinball_loss(y, p, 0.9), [10.0], [8.0], 1.8),
        (lambda y, p: metrics.pinball_loss(y, p, 0.1), [8.0], [10.0], 1.8),
        (metrics.coverage, [1.0, 2.0, 3.0, 4.0], [5.0, 5.0, 0.0, 0.0], 0.5),
        (metrics.coverage, [1.0, NAN, 1.0], [NAN, 2.0, 1.0], 1 / 3),
        (metrics.wape, [10.0, 10.0], [8.0, 12.0], 0.2),
        (metrics.wape, [0.0, 0.0], [1.0, 2.0], NAN),
        (metrics.bias, [10.0, 10.0], [12.0, 14.0], 3.0),
        (metrics.rmse, [0.0, 0.0], [3.0, 4.0], math.sqrt(12.5)),
    ],
)
def test_metrics(spark, build, actual, predicted, expected):
    assert measure(spark, actual, predicted, build) == pytest.approx(expected, nan_ok=True)


def test_rearrangement_sorts_within_the_row(spark):
    frame = spark.createDataFrame([(9.0, 5.0, 1.0), (1.0, 2.0, 3.0)], "q_0_1 double, q_0_5 double, q_0_9 double")
    rows = rearrange_quantiles(frame, [0.9, 0.1, 0.5]).collect()
    assert [tuple(r) for r in rows] == [(1.0, 5.0, 9.0), (1.0, 2.0, 3.0)]


def demand(spark, seed=3):
    draw = random.Random(seed)
    rows = []
    for sku, days in (("a", 60), ("b", 4)):
        for i in range(days):
            target = date(2021, 1, 1) + timedelta(days=i)
            rows.append(("S", sku, target - timedelta(days=2), target, 2, draw.randrange(30)))
    schema = "store_id string, sku_id string, origin_date date, target_date date, horizon int, target int"
    return rows, spark.createDataFrame(rows, schema)


def test_seasonal_quantiles_against_numpy(spark):
    rows, frame = demand(spark)
    levels = [0.1, 0.5, 0.58441558]
    model = SeasonalQuantiles(levels).fit(frame)
    ahead = spark.createDataFrame(
        [("S", "a", date(2021, 5, 3)), ("S", "b", date(2021, 5, 3)), ("S", "new", date(2021, 5, 3)),
         ("S", "b", date(2021, 5, 7))],
        "store_id string, sku_id string, target_date date",
    )

    def values(keep):
        return np.quantile([r[5] for r in rows if keep(r)], levels)

    expected = {
        ("a", date(2021, 5, 3)): values(lambda r: r[1] == "a" and r[3].weekday() == 0),
        ("b", date(2021, 5, 3)): values(lambda r: r[1] == "b" and r[3].weekday() == 0),
        ("b", date(2021, 5, 7)): values(lambda r: r[1] == "b" and r[3].weekday() == 4),
        ("new", date(2021, 5, 3)): values(lambda r: True),
    }
    found = model.predict(ahead).collect()
    assert len(found) == 4
    for row in found:
        got = [row[quantile_column(q)] for q in levels]
        assert got == pytest.approx(list(expected[row.sku_id, row.target_date]))
    thursday = spark.createDataFrame([("S", "b", date(2021, 5, 6))], ahead.schema)
    row = model.predict(thursday).first()  # no Thursday in b's training days: all its days
    assert row.q_0_5 == pytest.approx(np.median([r[5] for r in rows if r[1] == "b"]))


def test_forest_quantiles_against_a_direct_computation(spark, project):
    dataset = project_dataset(project)
    bounds = split.chronological_bounds(dataset, 3, 3)
    levels = [0.1, 0.5, 0.9]
    train, test = dataset.where(bounds.is_train), dataset.where(bounds.is_test)
    model = ForestQuantiles(levels, trees=5, depths=(3,), min_leaf_rows=5).fit(train, train)
    predicted = {tuple(r[k] for k in KEY): r for r in model.predict(test).collect()}

    def leaves(rows, training=False):
        reached = model.forest.transform(forests.assembled_features(rows, SPEC, model.means, training))
        return reached.withColumn("leaves", vector_to_array("_leaf")).collect()

    per_leaf = {}
    for row in leaves(train, training=True):
        for tree, leaf in enumerate(row.leaves):
            per_leaf.setdefault((tree, leaf), []).append(row.target)
    scored = leaves(test)
    assert len(scored) == len(predicted) > 0
    for row in scored:
        own = [np.quantile(per_leaf[t, leaf], levels) for t, leaf in enumerate(row.leaves)]
        got = predicted[tuple(row[k] for k in KEY)]
        assert [got[quantile_column(q)] for q in levels] == pytest.approx(list(np.mean(own, axis=0)))


def test_a_training_row_is_not_described_by_its_own_target(spark):
    rows = [("s", "a", date(2021, 1, 1) + timedelta(days=i), i) for i in range(40)] + [("s", None, date(2021, 1, 1), 7)]
    train = spark.createDataFrame(rows, "store_id string, sku_id string, origin_date date, target int")
    keys = ("store_id", "sku_id", "origin_date")
    means = forests.TargetMeans.fit(train, ["sku_id"], keys)
    folds = {r.origin_date: r.f for r in train.where("sku_id = 'a'").select("origin_date", forests._fold(keys).alias("f")).collect()}
    found = means.apply(train, training=True).collect()
    assert len(found) == 41
    for r in found:
        others = [t for _, k, d, t in rows if k == r.sku_id and (k is None or folds[d] != folds[r.origin_date])]
        expected = np.mean([t for *_, t in rows]) if r.sku_id is None else np.mean(others)
        assert r.sku_id_mean == pytest.approx(expected)
    scored = means.apply(train).collect()
    assert {round(r.sku_id_mean, 6) for r in scored} == {19.5, 7.0}


def test_forest_picks_a_depth_by_validation_loss(project):
    dataset = project_dataset(project)
    bounds = split.chronological_bounds(dataset, 3, 3)
    train, validation = dataset.where(bounds.is_train), dataset.where(bounds.is_validation)
    losses = {}
    for depths in ((1,), (4,), (1, 4)):
        maker = ForestQuantiles([0.5], trees=3, depths=depths, min_leaf_rows=5)
        losses[depths] = maker._loss(maker.fit(train, validation), validation)
    assert losses[1, 4] == pytest.approx(min(losses[(1,)], losses[(4,)]))


def test_backtest_job_logs_a_run(project):
    metrics_of = {
        (r.name, r.quantile): r.value
        for r in jobs.train(project, forecast=SMALL_FORECAST, forecaster=SMALL_FOREST, experiment="one").collect()
    }
    assert metrics_of["n_train_rows", None] > 0 and metrics_of["n_test_rows", None] > 0
    levels = SMALL_FORECAST.trained_quantiles(CostSpec())
    assert all(metrics_of["pinball", q] >= 0 for q in levels)
    assert all(0 <= metrics_of["coverage", q] <= 1 for q in levels)
    log = run_log.runs(project)
    run = run_log.latest_run(log, "one")
    params = {r.name: r.param for r in run.where("kind = 'param'").collect()}
    assert params["snapshot_table"] == "feature_store_v1" and params["horizon_days"] == "5"
    table = backtest.quantile_accuracy(run_log.run_metrics(run)).orderBy("quantile").collect()
    assert [r.quantile for r in table] == pytest.approx(levels)
    assert [r.pinball for r in table] == pytest.approx([metrics_of["pinball", q] for q in levels])
    jobs.train(project, forecast=SMALL_FORECAST, forecaster=SeasonalQuantiles, experiment="one")
    later = run_log.latest_run(run_log.runs(project), "one").first()
    assert later.run_id != run.first().run_id
    (named,) = run_log.run_identity(run).collect()
    assert named.run_id == run.first().run_id and named.started_at < later.started_at
    assert run_log.latest_run(log, "none").isEmpty()


def test_missing_measure_is_nan(spark):
    flat = spark.createDataFrame([("pinball", 0.5, 1.0), ("wape", None, 2.0)], "name string, quantile double, value double")
    (row,) = backtest.quantile_accuracy(flat).collect()
    assert row.quantile == 0.5 and row.pinball == 1.0 and math.isnan(row.coverage)
