import pytest

from stockloom.settings import CostSpec, FeatureSpec, ForecastSpec, ReplaySpec, SettingsError


def test_default_critical_fractile():
    costs = CostSpec()
    assert costs.understock_ratio == pytest.approx(0.45)
    assert costs.overstock_ratio == pytest.approx(0.32)
    assert costs.critical_fractile == pytest.approx(0.45 / 0.77)


@pytest.mark.parametrize(
    ("spec", "arguments"),
    [
        (FeatureSpec, {"lags": (0, 1)}),
        (FeatureSpec, {"lags": ()}),
        (FeatureSpec, {"windows": (0,)}),
        (FeatureSpec, {"aggregations": ("median",)}),
        (FeatureSpec, {"group_columns": ()}),
        (CostSpec, {"salvage_ratio": 0.65}),
        (CostSpec, {"unit_cost_ratio": 1.0}),
        (CostSpec, {"stockout_penalty_ratio": -0.1}),
        (ForecastSpec, {"quantiles": (0.1, 0.9)}),
        (ForecastSpec, {"quantiles": (0.5, 0.1)}),
        (ForecastSpec, {"quantiles": (0.5, 1.0)}),
        (ForecastSpec, {"horizon_days": 0}),
        (ForecastSpec, {"origin_stride_days": 0}),
        (ReplaySpec, {"lead_time_days": 0}),
        (ReplaySpec, {"service_level": 1.0}),
        (ReplaySpec, {"demand_distribution": "gamma"}),
        (ReplaySpec, {"baseline_window_days": 0}),
        (ReplaySpec, {"embargo_days": -1}),
    ],
)
def test_out_of_range_parameters_are_rejected(spec, arguments):
    with pytest.raises(SettingsError):
        spec(**arguments)


def test_trained_quantiles_include_the_fractile_in_order():
    levels = ForecastSpec().trained_quantiles(CostSpec())
    assert levels == sorted(levels)
    assert CostSpec().critical_fractile in levels
    assert len(levels) == 4


def test_feature_names():
    spec = FeatureSpec(lags=(1, 7), windows=(3,), aggregations=("mean", "sum"))
    assert spec.history_names == [
        "units_sold_lag_1",
        "units_sold_lag_7",
        "units_sold_roll_mean_3",
        "units_sold_roll_sum_3",
    ]
    assert spec.reach == 7
    assert len(FeatureSpec().history_names) == 16


def test_fingerprint_follows_the_parameters():
    assert FeatureSpec().fingerprint() == FeatureSpec().fingerprint()
    assert FeatureSpec().fingerprint() != FeatureSpec(lags=(1,)).fingerprint()
    assert len(FeatureSpec().fingerprint()) == 16
