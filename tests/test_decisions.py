import hashlib
import math
from collections import defaultdict
from dataclasses import replace
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.functions import newsvendor
from stockloom.operators import decisions, inventory, reports, split
from stockloom.operators.forest import ForestQuantiles
from stockloom.operators.seasonal import SeasonalQuantiles
from stockloom.plans import jobs
from stockloom.settings import CostSpec, ReplaySpec
from stockloom.sources import snapshots
from stockloom.sources.tables import Tables
from tests.conftest import SERIES, SMALL_FOREST, SMALL_FORECAST, SMALL_REPLAY, lead_pairs, project_dataset

COSTS = CostSpec()
PAIRS = lead_pairs()


def test_costs(spark):
    frame = spark.createDataFrame([(7.0, 4.0), (2.0, 6.5), (3.0, 3.0)], "q double, d double")
    q, d, price = F.col("q"), F.col("d"), F.lit(4.0)
    rows = frame.select(
        newsvendor.understock_cost(q, d, 0.25, price), newsvendor.overstock_cost(q, d, 0.4, price)
    ).collect()
    assert [c for r in rows for c in r] == pytest.approx([0.0, 4.8, 4.5, 0.0, 0.0, 0.0])


def test_critical_fractile_column(spark):
    def fractile(under, over):
        one = spark.createDataFrame([(under, over)], "u double, o double")
        return one.select(newsvendor.critical_fractile(F.col("u"), F.col("o"))).first()[0]

    assert fractile(0.45, 0.32) == pytest.approx(0.45 / 0.77)
    for bad in ((0.0, 1.0), (1.0, 0.0), (1.0, -1.0)):
        with pytest.raises(Exception, match="must be > 0"):
            fractile(*bad)


def history(spark, series):
    rows = [
        ("S", sku, date(2020, 1, 1) + timedelta(days=i), v)
        for sku, values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "store_id string, sku_id string, origin_date date, target int")


def levels_of(frame):
    return {r.sku_id: r.order_up_to for r in frame.collect()}


def test_normal_level(spark):
    series = {"a": [9, 0, 1, 6, 6, 2], "flat": [3, 3, 3], "one": [8]}
    rows = history(spark, series)
    assert levels_of(inventory.normal_levels(rows, 5, 0.5))["a"] == pytest.approx(20)
    found = levels_of(inventory.normal_levels(rows, 4, 0.95))
    z = NormalDist().inv_cdf(0.95)
    for sku, values in series.items():
        expected = np.mean(values) * 4 + z * np.std(values) * 2
        assert found[sku] == pytest.approx(expected)


def test_poisson_level(spark):
    means = [0, 1e-9, 0.3, 1, 5, 40.25, 177.75, 199.9, 200.0, 900.5, 3000, 250_000.5]
    frame = spark.createDataFrame([(float(m),) for m in means], "mean double")
    for level in (0.001, 0.05, 0.5, 0.95, 0.999, 1 - 1e-7):
        found = [r[0] for r in frame.select(inventory.poisson_quantile(F.col("mean"), level)).collect()]
        for mean, k in zip(means, found, strict=True):
            if mean == 0:
                assert k == 0
                continue
            terms = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(int(k) + 1)]
            assert math.fsum(map(math.exp, terms)) >= level - 1e-8
            assert math.fsum(map(math.exp, terms[:-1])) < level + 1e-8


def test_bootstrap_level_against_a_plain_loop(spark):
    series = {"a": [0, 0, 5, 7, 1, 0, 12], "b": [4], "c": list(range(100, 0, -1))}
    found = levels_of(inventory.bootstrap_levels(history(spark, series), 3, 0.9, 50, 7))
    for sku, values in series.items():
        ordered, totals = sorted(values), []
        for draw in range(50):
            picks = [
                int(hashlib.md5(f"7|{draw}|{day}".encode()).hexdigest()[:8], 16) % len(ordered)
                for day in range(3)
            ]
            totals.append(sum(ordered[p] for p in picks))
        assert found[sku] == pytest.approx(np.quantile(totals, 0.9))


def test_dispatch(spark):
    rows = history(spark, {"a": [1, 2, 3, 4]})
    for name in ("empirical", "normal", "poisson"):
        assert set(levels_of(inventory.order_up_to(rows, name, 2, 0.9, 20, 1))) == {"a"}
    with pytest.raises(ValueError, match="unknown distribution"):
        inventory.order_up_to(rows, "gamma", 2, 0.9)


def test_series_history_is_in_day_order(spark):
    rows = history(spark, {"a": [3, 1, 2]}).orderBy("target")
    assert inventory.series_history(rows).first().demand == [3, 1, 2]


@pytest.fixture(scope="module")
def dataset(project):
    return project_dataset(project)


LAST = max(d for _, _, d in PAIRS)
ADVISED = {(s, i) for s, i, d in PAIRS if d == LAST}


def test_recommendations(dataset):
    rows = decisions.recommend(dataset, 3, COSTS, SMALL_FORECAST, SeasonalQuantiles).collect()
    assert {(r.store_id, r.sku_id) for r in rows} == ADVISED and len(rows) == len(ADVISED)
    assert {r.origin_date for r in rows} == {LAST}
    for r in rows:
        assert r.target_date - r.origin_date == timedelta(days=3) and r.lead_time_days == 3
        assert r.safety_stock == pytest.approx(r.order_quantity - r.median_forecast)
        assert r.critical_fractile == pytest.approx(COSTS.critical_fractile)
        assert r.actual_demand == PAIRS[r.store_id, r.sku_id, LAST]


def test_recommendations_learn_nothing_from_later_days(dataset):
    plain = decisions.recommend(dataset, 3, COSTS, SMALL_FORECAST, SeasonalQuantiles)
    late = F.col("origin_date") >= F.lit(LAST - timedelta(days=3))
    other = dataset.withColumn("target", F.when(late, 999).otherwise(F.col("target")))
    changed = decisions.recommend(other, 3, COSTS, SMALL_FORECAST, SeasonalQuantiles)
    columns = ["store_id", "sku_id", "order_quantity"]
    assert plain.select(columns).exceptAll(changed.select(columns)).isEmpty()


@pytest.mark.parametrize("distribution", ["empirical", "normal", "poisson"])
def test_replay_pairs_and_grades(dataset, distribution):
    spec = replace(SMALL_REPLAY, demand_distribution=distribution)
    rows = decisions.replay(dataset, spec, COSTS, SMALL_FORECAST, SeasonalQuantiles).collect()
    pairs = defaultdict(dict)
    for r in rows:
        pairs[r.store_id, r.sku_id, r.origin_date][r.policy] = r
        short = max(r.actual_demand - r.order_quantity, 0)
        over = max(r.order_quantity - r.actual_demand, 0)
        assert r.understock_cost == pytest.approx(r.sell_price * COSTS.understock_ratio * short)
        assert r.overstock_cost == pytest.approx(r.sell_price * COSTS.overstock_ratio * over)
        assert r.cost == pytest.approx(r.understock_cost + r.overstock_cost)
        assert r.understock_cost == 0 or r.overstock_cost == 0
    tested = sorted({d for _, _, d in PAIRS})[-3:]
    assert pairs.keys() == {k for k in PAIRS if k[2] in tested}
    assert all(set(p) == {"ml_quantile", "classical_baseline"} for p in pairs.values())
    baseline = {(k[0], k[1], p["classical_baseline"].order_quantity) for k, p in pairs.items()}
    assert len(baseline) == len(SERIES)  # one quantity per series


def test_replay_baseline_uses_outcomes_before_the_test_and_embargo_drops_the_overlap(dataset):
    bounds = split.chronological_bounds(dataset, 3, 3)

    def quantities(spec):
        rows = decisions.replay(dataset, spec, COSTS, SMALL_FORECAST, SeasonalQuantiles)
        rows = rows.where("policy = 'classical_baseline'").collect()
        return {(r.store_id, r.sku_id): r.order_quantity for r in rows}

    def expected(end, window):
        known = dataset.where((F.col("origin_date") < F.lit(end))).collect()
        series = defaultdict(list)
        for r in known:
            series[r.store_id, r.sku_id].append(r.target)
        z = NormalDist().inv_cdf(0.9)
        return {
            k: np.mean(v) * window + z * np.std(v) * math.sqrt(window) for k, v in series.items()
        }

    spec = replace(SMALL_REPLAY, demand_distribution="normal")
    late = dataset.where(
        (F.col("origin_date") < F.lit(bounds.test_start))
        & (F.col("target_date") > F.lit(bounds.test_start))
    )
    assert not late.isEmpty()
    assert quantities(spec) == pytest.approx(expected(bounds.test_start, 3))
    known_by_then = replace(spec, embargo_days=2, baseline_window_days=1)
    end = bounds.test_start - timedelta(days=2)
    assert dataset.where(
        (F.col("origin_date") < F.lit(end)) & (F.col("target_date") > F.lit(bounds.test_start))
    ).isEmpty()
    assert quantities(known_by_then) == pytest.approx(expected(end, 1))


def test_series_without_history_are_left_out_of_both(dataset):
    bounds = split.chronological_bounds(dataset, 3, 3)
    known = F.col("origin_date") < F.lit(bounds.test_start)
    new = (F.col("store_id") == "market") & (F.col("sku_id") == "rye")
    rows = decisions.replay(
        dataset.where(~(known & new)), SMALL_REPLAY, COSTS, SMALL_FORECAST, SeasonalQuantiles
    )
    tested = sorted({d for _, _, d in PAIRS})[-3:]
    left = [k for k in PAIRS if k[2] in tested and k[:2] != ("market", "rye")]
    assert rows.where(new).isEmpty() and rows.count() == 2 * len(left)


def test_impossible_parameters_raise(project, dataset):
    with pytest.raises(decisions.DecisionError, match="no rows available"):
        jobs.simulate(project, replace(SMALL_REPLAY, lead_time_days=1000), forecaster=SMALL_FOREST, forecast=SMALL_FORECAST)
    with pytest.raises(decisions.DecisionError, match="no rows available"):
        jobs.recommend(project, 1000, forecaster=SMALL_FOREST, forecast=SMALL_FORECAST)
    with pytest.raises(decisions.DecisionError, match="no test rows survive"):
        spec = replace(SMALL_REPLAY, review_period_days=10_000)
        decisions.replay(dataset, spec, COSTS, SMALL_FORECAST, SeasonalQuantiles)
    with pytest.raises(split.SplitError):
        big = replace(SMALL_FORECAST, test_size_days=60)
        decisions.replay(dataset, SMALL_REPLAY, COSTS, big, SeasonalQuantiles)


def test_coarser_review_gives_fewer_decisions(dataset):
    counts = [
        decisions.replay(
            dataset, replace(SMALL_REPLAY, review_period_days=n), COSTS, SMALL_FORECAST, SeasonalQuantiles
        ).count()
        for n in (1, 2)
    ]
    assert counts[1] < counts[0]


def test_forest_can_drive_the_decisions(dataset):
    def forest(levels):
        return ForestQuantiles(levels, trees=3, depths=(3,), min_leaf_rows=5)

    assert decisions.recommend(dataset, 3, COSTS, SMALL_FORECAST, forest).count() == len(ADVISED)


def test_report_before_and_after_the_other_jobs(spark, raw_dir, tmp_path):
    tables = Tables(spark, str(tmp_path))
    jobs.ingest_raw(tables, str(raw_dir))
    jobs.build_features(tables)
    early = jobs.report(tables)
    assert early["snapshot"].first().table_name == "feature_store_v1"
    for name in ("forecast_metrics", "recommendation_summary", "top_misses", "policy_summary"):
        assert early[name] is None
    assert tuple(early["kpi_tiles"].first()) == (None, None, None, None)
    costs = early["cost_assumptions"].first()
    assert costs.currency == "USD" and costs.critical_fractile == pytest.approx(0.45 / 0.77)

    jobs.train(tables, forecaster=SMALL_FOREST, forecast=SMALL_FORECAST)
    for validation in (3, 4):  # the second run replaces the first
        forecast = replace(SMALL_FORECAST, validation_size_days=validation)
        advice = jobs.recommend(tables, 3, forecaster=SMALL_FOREST, forecast=forecast)
    results = jobs.simulate(tables, SMALL_REPLAY, forecaster=SMALL_FOREST, forecast=SMALL_FORECAST)
    tested = sorted({d for _, _, d in PAIRS})[-3:]
    assert advice.count() == len(ADVISED)
    assert results.count() == 2 * sum(d in tested for _, _, d in PAIRS)
    assert advice.select("snapshot_table").distinct().collect()[0][0] == "feature_store_v1"

    late = {k: v.collect() for k, v in jobs.report(tables).items()}
    assert late["skipped_decisions"] == [] and len(late["forecast_run"]) == 1
    summary, tiles = late["recommendation_summary"][0], late["kpi_tiles"][0]
    assert summary.n_recommendations == len(ADVISED) and summary.snapshot_table == "feature_store_v1"
    assert tiles.total_order_quantity == pytest.approx(summary.total_order_quantity)
    policies = {r.policy: r for r in late["policy_summary"]}
    assert [r.policy for r in late["policy_summary"]] == ["classical_baseline", "ml_quantile"]
    saved = policies["classical_baseline"].total_cost - policies["ml_quantile"].total_cost
    assert late["policy_savings"][0].savings == pytest.approx(saved) == tiles.savings
    for r in policies.values():
        assert r.total_cost == pytest.approx(r.total_understock_cost + r.total_overstock_cost)
        assert r.mean_cost == pytest.approx(r.total_cost / r.n_decisions)
    misses = [r.absolute_miss for r in late["top_misses"]]
    assert misses == sorted(misses, reverse=True) and len(misses) == len(ADVISED)
    assert len(late["quantile_accuracy"]) == 4
    wape = {r.name: r.value for r in late["forecast_metrics"]}["wape"]
    assert tiles.wape == pytest.approx(wape)


def test_jobs_leave_no_intermediate_tables(spark, project):
    from pathlib import Path

    from stockloom.session import shared_folder

    left = Path(shared_folder(spark)) / "stockloom"
    before = set(left.iterdir())
    jobs.recommend(project, 3, forecaster=SMALL_FOREST, forecast=SMALL_FORECAST)
    with pytest.raises(decisions.DecisionError):
        jobs.recommend(project, 1000, forecaster=SMALL_FOREST, forecast=SMALL_FORECAST)
    assert set(left.iterdir()) == before


def test_series_without_history_are_counted(dataset):
    bounds = split.chronological_bounds(dataset, 3, 3)
    known = F.col("origin_date") < F.lit(bounds.test_start)
    new = (F.col("store_id") == "market") & (F.col("sku_id") == "rye")
    skipped = decisions.skipped_decisions(dataset.where(~(known & new)), SMALL_REPLAY, SMALL_FORECAST)
    tested = sorted({d for _, _, d in PAIRS})[-3:]
    n = sum(k[:2] == ("market", "rye") and k[2] in tested for k in PAIRS)
    assert [tuple(r) for r in skipped.collect()] == [("market", "rye", n)]


def test_savings_need_both_policies(spark):
    rows = spark.createDataFrame([("ml_quantile", 3.0)], "policy string, cost double")
    assert reports.policy_savings(rows).first().savings is None


def test_no_recommendations_no_summary(project, dataset):
    none = decisions.recommend(dataset, 3, COSTS, SMALL_FORECAST, SeasonalQuantiles).where("false")
    none = none.withColumn("snapshot_table", F.lit("x"))
    assert reports.recommendation_summary(none).isEmpty()


def test_recommend_uses_the_named_or_newest_snapshot(spark, raw_dir, tmp_path):
    tables = Tables(spark, str(tmp_path))
    jobs.ingest_raw(tables, str(raw_dir))
    jobs.build_features(tables)
    jobs.build_features(tables)
    newest = jobs.recommend(tables, 3, forecaster=SMALL_FOREST, forecast=SMALL_FORECAST)
    assert newest.first().snapshot_table == "feature_store_v2"
    named = jobs.recommend(tables, 3, forecaster=SMALL_FOREST, forecast=SMALL_FORECAST, snapshot="feature_store_v1")
    assert named.first().snapshot_table == "feature_store_v1"
    with pytest.raises(snapshots.SnapshotError):
        jobs.simulate(tables, ReplaySpec(), snapshot="feature_store_v7")
