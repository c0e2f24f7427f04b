"""The registered queries as plain SQL over the raw tables."""

from __future__ import annotations

from statistics import NormalDist

from checks.sql_panel import panel
from stockloom.functions.quantiles import quantile_column
from stockloom.settings import CostSpec, ForecastSpec, ReplaySpec

COSTS, REPLAY, FORECAST = CostSpec(), ReplaySpec(), ForecastSpec()
FRACTILE = COSTS.critical_fractile
LEVELS = FORECAST.trained_quantiles(COSTS)
UNDER, OVER = COSTS.understock_ratio, COSTS.overstock_ratio

EMBARGO = 2350
_SERIES_DATE = "store_id, sku_id, date"


def _lags(lags):
    return [f"lag(units_sold, {n}) OVER w AS units_sold_lag_{n}" for n in lags]


def _rolling(aggregations):
    call = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}
    out = []
    for w in (7, 14, 28):
        for a in aggregations:
            value = f"{call[a]}(units_sold) OVER (w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
            if a in ("mean", "std"):
                value = f"round({value}, 6)"
            elif a == "sum":
                value = f"CAST({value} AS BIGINT)"
            out.append(f"{value} AS units_sold_roll_{a}_{w}")
    return out


def _history(columns):
    return (
        f"SELECT {_SERIES_DATE}, {', '.join(columns)} FROM sales "
        "WINDOW w AS (PARTITION BY store_id, sku_id ORDER BY date)"
    )


def _custom(w):
    frame = f"(w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    seen, n = f"list(units_sold) OVER {frame}", f"count(*) OVER {frame}"
    ramp = f"CAST(range(1, {n} + 1) AS DOUBLE[])"
    weighted = f"list_inner_product(CAST({seen} AS DOUBLE[]), {ramp}) * 2 / ({n} * ({n} + 1))"
    return [
        f"round(avg(units_sold) OVER {frame}, 6) AS units_sold_roll_mean_{w}",
        f"round(avg(CAST(units_sold = 0 AS INTEGER)) OVER {frame}, 6) AS units_sold_roll_idle_share_{w}",
        f"max(units_sold) OVER {frame} - min(units_sold) OVER {frame} AS units_sold_roll_spread_{w}",
        f"round({weighted}, 6) AS units_sold_roll_recent_mean_{w}",
    ]


DEFAULT_HISTORY = _lags((1, 7, 14, 28)) + _rolling(("mean", "std", "min", "max"))

STORE = f"""
rolling AS ({_history(DEFAULT_HISTORY)}),
snap_days AS (
  SELECT date, 'CA' AS state_id FROM calendar WHERE snap_ca
  UNION ALL SELECT date, 'TX' FROM calendar WHERE snap_tx
  UNION ALL SELECT date, 'WI' FROM calendar WHERE snap_wi
),
store AS MATERIALIZED (
  SELECT sales.*, skus.dept_id, skus.cat_id, stores.state_id, calendar.day_of_week,
         calendar.week_of_year, calendar.month, calendar.is_weekend, calendar.is_event,
         calendar.is_holiday, snap_days.date IS NOT NULL AS snap_flag,
         rolling.* EXCLUDE (store_id, sku_id, date)
  FROM sales
  JOIN rolling ON rolling.store_id = sales.store_id AND rolling.sku_id = sales.sku_id
              AND rolling.date = sales.date
  JOIN calendar ON calendar.date = sales.date
  JOIN stores ON stores.store_id = sales.store_id
  JOIN skus ON skus.sku_id = sales.sku_id
  LEFT JOIN snap_days ON snap_days.date = sales.date AND snap_days.state_id = stores.state_id
)
"""

QUALITY = """
SELECT check_name, mode, value, (value > 0) = (mode = 'positive') AS passed,
       CASE mode || (value > 0) WHEN 'positivetrue' THEN value || ' rows'
            WHEN 'positivefalse' THEN 'table is empty' WHEN 'zerofalse' THEN 'ok'
            ELSE value || ' violating rows' END AS detail
FROM checked
"""


def quality_values(sales, prices, calendar):
    """CTE ``checked`` (check_name, mode, value): sizes, surplus keys, bad values, lost references."""
    sizes = {"stores": "stores", "skus": "skus", "calendar": calendar, "prices": prices, "sales": sales}
    parts = [f"SELECT '{n}_non_empty', 'positive', count(*) FROM {t}" for n, t in sizes.items()]
    keys = {"sales": (sales, "store_id, sku_id, date"), "prices": (prices, "store_id, sku_id, wm_yr_wk")}
    for name, (table, key) in keys.items():
        parts.append(
            f"SELECT '{name}_key_unique', 'zero', count(*) FROM "
            f"(SELECT {key}, count(*) AS n FROM {table} GROUP BY ALL) WHERE n > 1"
        )
    tests = {"no_negative_units": "units_sold < 0", "positive_prices": "NOT coalesce(sell_price > 0, FALSE)"}
    for name, test in tests.items():
        parts.append(f"SELECT '{name}', 'zero', count(*) FILTER (WHERE {test}) FROM {sales}")
    ends = {"sales_stores_exist": ("stores", "store_id"), "sales_skus_exist": ("skus", "sku_id"),
            "sales_dates_in_calendar": (calendar, "date")}
    for name, (table, key) in ends.items():
        parts.append(
            f"SELECT '{name}', 'zero', count(*) FROM {sales} f "
            f"WHERE NOT EXISTS (SELECT 1 FROM {table} d WHERE d.{key} = f.{key})"
        )
    parts.append(
        f"SELECT 'calendar_contiguous', 'zero', max(date) - min(date) + 1 - count(*) FROM {calendar}"
    )
    return f"checked(check_name, mode, value) AS ({' UNION ALL '.join(parts)})"


DAMAGED = """
sunday AS (SELECT * FROM sales WHERE dayofweek(date) = 0),
bad_sales AS (
  SELECT store_id, sku_id, date, CASE dayofweek(date) WHEN 1 THEN -units_sold ELSE units_sold END
           AS units_sold, sell_price FROM sales
  UNION ALL SELECT * FROM sunday
  UNION ALL SELECT store_id || '?', sku_id, date, units_sold, sell_price FROM sunday
  UNION ALL SELECT store_id, 'NONE', date, units_sold, 0 FROM sunday
  UNION ALL SELECT store_id, sku_id, CAST(date + INTERVAL 100 YEAR AS DATE), units_sold, NULL FROM sunday
),
bad_prices AS (SELECT * FROM prices UNION ALL SELECT * FROM prices WHERE wm_yr_wk % 3 = 0),
bad_calendar AS (SELECT * FROM calendar WHERE month != 6 OR is_weekend)
"""

_FIVE = ("mean", "std", "min", "max", "sum")

ORACLES: dict[str, str] = {
    "stores": panel("SELECT * FROM stores"),
    "skus": panel("SELECT * FROM skus"),
    "calendar_dim": panel("SELECT * FROM calendar"),
    "prices": panel("SELECT store_id, sku_id, wm_yr_wk, sell_price FROM prices"),
    "unpivot_sales": panel("SELECT store_id, sku_id, d, units_sold FROM long_sales"),
    "sales_fact": panel("SELECT * FROM sales"),
    "sales_panel": panel("SELECT * FROM sales"),
    "ingest_stats": panel(
        """
        SELECT (SELECT count(*) FROM stores) AS stores, (SELECT count(*) FROM skus) AS skus,
               (SELECT count(*) FROM calendar) AS calendar_days,
               (SELECT count(*) FROM sales) AS sales_rows,
               (SELECT count(*) FROM long_sales) - (SELECT count(*) FROM sales) AS dropped_rows
        """
    ),
    "table_counts": panel(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
            for t in ("stores", "skus", "calendar", "prices", "sales")
        )
    ),
    "quality_checks": panel(QUALITY, quality_values("sales", "prices", "calendar")),
    "quality_checks_damaged": panel(
        QUALITY, DAMAGED, quality_values("bad_sales", "bad_prices", "bad_calendar")
    ),
    "sales_summary": panel(
        """
        SELECT state_id, cat_id, date, CAST(sum(units_sold) AS BIGINT) AS units_sold,
               round(sum(units_sold * sell_price), 6) AS revenue
        FROM sales JOIN skus USING (sku_id) JOIN stores USING (store_id)
        GROUP BY state_id, cat_id, date
        """
    ),
    "series_coverage": panel(
        """
        SELECT store_id, sku_id, min(date) AS first_date, max(date) AS last_date,
               count(*) AS n_days
        FROM sales GROUP BY store_id, sku_id
        """
    ),
    "duplicate_keys": panel(
        """
        SELECT store_id, sku_id, CAST(l_shipdate AS DATE) AS date, count(*) AS n
        FROM lineitem JOIN store_of ON s_suppkey = l_suppkey JOIN items ON p_partkey = l_partkey
        GROUP BY ALL HAVING count(*) > 1
        """
    ),
    "orphan_rows": """
        SELECT doc_id AS key, count(*) AS n FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
        GROUP BY doc_id
        """,
    "feature_store": panel("SELECT * FROM store", STORE),
    "feature_store_from_view": panel("SELECT * FROM store", STORE),
    "lag_features": panel(_history(_lags((1, 2, 7, 14, 28, 364)))),
    "rolling_features": panel(_history(_rolling(_FIVE))),
    "custom_aggregates": panel(_history(_custom(7) + _custom(28))),
    "rolling_features_in_blocks": panel(_history(_rolling(_FIVE))),
}


# --- assembly and splits -------------------------------------------------------------------

_ROWS = """
SELECT o.store_id, o.sku_id, o.date AS origin_date, t.date AS target_date,
       t.date - o.date AS horizon, t.sell_price, t.units_sold AS target
FROM sales o JOIN sales t ON o.store_id = t.store_id AND o.sku_id = t.sku_id
"""
LEAD_ROWS = f"rows AS ({_ROWS} AND t.date = o.date + 7)"
MULTI_ROWS = f"""
rows AS ({_ROWS} AND t.date BETWEEN o.date + 1 AND o.date + 28
         WHERE (o.date - DATE '1970-01-01') % 7 = 0)
"""
BOUNDS = """
bounds AS (
  SELECT max(CASE WHEN rn = 28 THEN origin_date END) AS test_start,
         max(CASE WHEN rn = 56 THEN origin_date END) AS validation_start
  FROM (SELECT origin_date, row_number() OVER (ORDER BY origin_date DESC) AS rn
        FROM (SELECT DISTINCT origin_date FROM rows))
)
"""
TRAIN = "train AS (SELECT rows.* FROM rows, bounds WHERE origin_date < validation_start)"
TEST = "test AS (SELECT rows.* FROM rows, bounds WHERE origin_date >= test_start)"
KNOWN = "known AS (SELECT rows.* FROM rows, bounds WHERE origin_date < test_start)"


def _assembled(on, where=""):
    origin = ", ".join(f"o.{c.split(' AS ')[-1]}" for c in DEFAULT_HISTORY)
    return f"""
    SELECT o.store_id, o.sku_id, o.date AS origin_date, t.date AS target_date,
           CAST(t.date - o.date AS INTEGER) AS horizon, {origin},
           t.day_of_week, t.week_of_year, t.month, t.is_weekend, t.is_event, t.is_holiday,
           t.snap_flag, t.sell_price, t.dept_id, t.cat_id, t.state_id, t.units_sold AS target
    FROM store o JOIN store t ON o.store_id = t.store_id AND o.sku_id = t.sku_id AND {on} {where}
    """


# --- seasonal model: exact percentiles per series and target day of week ---------------------


def _levels(levels):
    return ", ".join(
        f"quantile_cont(CAST(target AS DOUBLE), {q!r}::DOUBLE) AS {quantile_column(q)}"
        for q in levels
    )


def _model(levels, source="train"):
    return f"""
    by_day AS (SELECT store_id, sku_id, dayofweek(target_date) AS dow, {_levels(levels)}
               FROM {source} GROUP BY ALL),
    by_series AS (SELECT store_id, sku_id, {_levels(levels)} FROM {source} GROUP BY ALL),
    overall AS (SELECT {_levels(levels)} FROM {source})
    """


def _scored(levels, source="test", name="scored"):
    raw = ", ".join(f"coalesce(d.{c}, s.{c}, a.{c})" for c in map(quantile_column, levels))
    out = ", ".join(f"lv[{i + 1}] AS {quantile_column(q)}" for i, q in enumerate(levels))
    return f"""
    {name} AS (
      SELECT * EXCLUDE (lv), {out} FROM (
        SELECT r.*, list_sort([{raw}]) AS lv
        FROM {source} r CROSS JOIN overall a
             LEFT JOIN by_day d ON d.store_id = r.store_id AND d.sku_id = r.sku_id
                                AND d.dow = dayofweek(r.target_date)
             LEFT JOIN by_series s ON s.store_id = r.store_id AND s.sku_id = r.sku_id)
    )
    """


def _pinball(c, q):
    return f"round(avg(greatest((target - {c}) * {q!r}::DOUBLE, (target - {c}) * {q - 1!r}::DOUBLE)), 6)"


def _coverage(c):
    return f"round(avg(CASE WHEN target <= {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)"


def _accuracy():
    """(name, quantile, value)"""
    values = [
        ("wape", None, "round(CASE WHEN sum(abs(target)) = 0 THEN 'NaN'::DOUBLE ELSE "
                       "sum(abs(target - q_0_5)) / sum(abs(target)) END, 6)"),
        ("bias", None, "round(avg(q_0_5 - target), 6)"),
        ("rmse", None, "round(sqrt(avg((target - q_0_5) * (target - q_0_5))), 6)"),
    ]
    for q in LEVELS:
        values.append(("pinball", q, _pinball(quantile_column(q), q)))
        values.append(("coverage", q, _coverage(quantile_column(q))))
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, {'NULL::DOUBLE' if q is None else f'round({q!r}::DOUBLE, 6)'} AS quantile, "
        f"{value} AS value FROM scored"
        for name, q, value in values
    )


_BACKTEST = (MULTI_ROWS, BOUNDS, TRAIN, TEST, _model(LEVELS), _scored(LEVELS))
_rounded_levels = ", ".join(
    f"round({quantile_column(q)}, 6) AS {quantile_column(q)}" for q in LEVELS
)

ORACLES |= {
    "series_history": panel(
        """
        SELECT store_id, sku_id,
               string_agg(CAST(target AS VARCHAR), ',' ORDER BY origin_date) AS days
        FROM known GROUP BY ALL
        """,
        LEAD_ROWS, BOUNDS, KNOWN,
    ),
    "origin_stride": panel("SELECT * FROM sales WHERE (date - DATE '1970-01-01') % 7 = 0"),
    "lead_time_dataset": panel(_assembled("t.date = o.date + 7"), STORE),
    "horizon_dataset": panel(
        " UNION ALL ".join(
            _assembled(f"t.date = o.date + {h}", "WHERE (o.date - DATE '1970-01-01') % 7 = 0")
            for h in range(1, FORECAST.horizon_days + 1)
        ),
        STORE,
    ),
    "origin_dates": panel("SELECT DISTINCT origin_date FROM rows", LEAD_ROWS),
    "split_counts": panel(
        """
        SELECT CASE WHEN origin_date < validation_start THEN 'train'
                    WHEN origin_date < test_start THEN 'validation' ELSE 'test' END AS split,
               count(*) AS n_rows, count(DISTINCT origin_date) AS n_origin_dates
        FROM rows, bounds GROUP BY ALL
        """,
        MULTI_ROWS, BOUNDS,
    ),
    "two_way_split": panel(
        """
        SELECT CASE WHEN origin_date < test_start THEN 'train' ELSE 'validation' END AS split,
               count(*) AS n_rows, count(DISTINCT origin_date) AS n_origin_dates
        FROM rows, bounds GROUP BY ALL
        """,
        LEAD_ROWS, BOUNDS,
    ),
    "seasonal_quantiles": panel(
        f"SELECT store_id, sku_id, CAST(dow AS INTEGER) AS day_of_week, {_rounded_levels} "
        "FROM by_day",
        LEAD_ROWS, BOUNDS, TRAIN, _model(LEVELS),
    ),
    "seasonal_predictions": panel(
        f"SELECT store_id, sku_id, origin_date, target_date, target, {_rounded_levels} FROM scored",
        LEAD_ROWS, BOUNDS, TRAIN, TEST, _model(LEVELS), _scored(LEVELS),
    ),
    "monotone_rearrange": panel(
        """
        SELECT store_id, sku_id, date, lv[1] AS q_0_1, lv[2] AS q_0_5, lv[3] AS q_0_9 FROM (
          SELECT store_id, sku_id, date,
                 list_sort([coalesce(lag(units_sold, 1) OVER w, 0),
                            coalesce(lag(units_sold, 7) OVER w, 0),
                            coalesce(lag(units_sold, 14) OVER w, 0)]) AS lv
          FROM sales WINDOW w AS (PARTITION BY store_id, sku_id ORDER BY date))
        """
    ),
    "backtest_metrics": panel(
        _accuracy() + " UNION ALL SELECT 'n_train_rows', NULL, count(*)::DOUBLE FROM train"
        " UNION ALL SELECT 'n_validation_rows', NULL, count(*)::DOUBLE FROM rows, bounds"
        " WHERE origin_date >= validation_start AND origin_date < test_start"
        " UNION ALL SELECT 'n_test_rows', NULL, count(*)::DOUBLE FROM test",
        *_BACKTEST,
    ),
    "quantile_accuracy": panel(
        " UNION ALL ".join(
            f"SELECT round({q!r}::DOUBLE, 6) AS quantile, {_pinball(quantile_column(q), q)} AS pinball, "
            f"{_coverage(quantile_column(q))} AS coverage FROM scored"
            for q in LEVELS
        ),
        *_BACKTEST,
    ),
    "forest_quantiles": panel(
        "SELECT store_id, sku_id, origin_date, target_date, target, TRUE AS ordered, "
        "TRUE AS within_outcomes, TRUE AS as_by_tables FROM test",
        LEAD_ROWS, BOUNDS, TEST,
    ),
    "boosted_quantiles": panel(
        " UNION ALL ".join(
            f"SELECT round({q!r}::DOUBLE, 6) AS quantile, count(*) AS n_rows, "
            f"{_pinball(quantile_column(q), q)} AS seasonal_pinball, "
            f"{_pinball('c_' + quantile_column(q), q)} AS constant_pinball, "
            "TRUE AS boosted_no_worse_than_constant FROM scored CROSS JOIN start"
            for q in LEVELS
        ),
        LEAD_ROWS, BOUNDS, TRAIN, TEST, _model(LEVELS), _scored(LEVELS),
        "start AS (SELECT "
        + ", ".join(f"round({quantile_column(q)} * 64) / 64 AS c_{quantile_column(q)}" for q in LEVELS)
        + " FROM overall)",
    ),
    "report_cost_assumptions": panel(
        f"""
        SELECT '{COSTS.currency}' AS currency, round({COSTS.unit_cost_ratio!r}::DOUBLE, 6) AS unit_cost_ratio,
               round({COSTS.salvage_ratio!r}::DOUBLE, 6) AS salvage_ratio,
               round({COSTS.holding_cost_ratio!r}::DOUBLE, 6) AS holding_cost_ratio,
               round({COSTS.stockout_penalty_ratio!r}::DOUBLE, 6) AS stockout_penalty_ratio,
               round(1 - {COSTS.unit_cost_ratio!r}::DOUBLE + {COSTS.stockout_penalty_ratio!r}::DOUBLE, 6)
                 AS understock_cost_ratio,
               round({COSTS.unit_cost_ratio!r}::DOUBLE - {COSTS.salvage_ratio!r}::DOUBLE
                     + {COSTS.holding_cost_ratio!r}::DOUBLE, 6) AS overstock_cost_ratio,
               round({UNDER!r}::DOUBLE / ({UNDER!r}::DOUBLE + {OVER!r}::DOUBLE), 6) AS critical_fractile,
               round(sum(units_sold * sell_price), 4) AS revenue
        FROM sales
        """
    ),
    "run_metrics": panel(
        f"SELECT *, 'b' AS run_id, DATE '2024-05-02' AS started_at FROM ({_accuracy()})", *_BACKTEST
    ),
    "cost_assumptions": panel(
        f"""
        SELECT cat_id, round(p, 6) AS mean_price, round(p * {UNDER!r}::DOUBLE, 6) AS understock_cost,
               round(p * {OVER!r}::DOUBLE, 6) AS overstock_cost,
               round({FRACTILE!r}::DOUBLE, 6) AS critical_fractile
        FROM (SELECT cat_id, avg(sell_price) AS p FROM prices JOIN skus USING (sku_id)
              GROUP BY cat_id)
        """
    ),
}

# --- baselines and decisions ------------------------------------------------------------------


def _normal(days, level):
    z = NormalDist().inv_cdf(level)
    return f"""
    baseline AS (
      SELECT store_id, sku_id,
             avg(target) * {days} + {z!r}::DOUBLE * stddev_pop(target) * sqrt({days})
               AS order_up_to
      FROM known GROUP BY ALL
    )
    """


def _poisson(days, level, source="known"):
    return f"""
    means AS (SELECT store_id, sku_id, avg(target) * {days} AS mu FROM {source} GROUP BY ALL),
    terms AS (
      SELECT store_id, sku_id, k, sum(exp(k * ln(mu) - mu - lgamma(k + 1)))
               OVER (PARTITION BY store_id, sku_id ORDER BY k) AS cdf
      FROM (SELECT store_id, sku_id, mu,
                   unnest(range(0, CAST(ceil(2 * mu) + 60 AS BIGINT))) AS k
            FROM means WHERE mu > 0)
    ),
    baseline AS (
      SELECT store_id, sku_id, CAST(coalesce(min(k), 0) AS DOUBLE) AS order_up_to
      FROM means LEFT JOIN (SELECT * FROM terms WHERE cdf >= {level}) USING (store_id, sku_id)
      GROUP BY ALL
    )
    """


def _bootstrap(days, level, draws=1000, seed=42):
    return f"""
    ranked AS (
      SELECT store_id, sku_id, target,
             row_number() OVER (PARTITION BY store_id, sku_id ORDER BY target) - 1 AS position,
             count(*) OVER (PARTITION BY store_id, sku_id) AS n
      FROM known
    ),
    sizes AS (SELECT DISTINCT store_id, sku_id, n FROM ranked),
    numbers AS (
      SELECT draw, CAST('0x' || substr(md5('{seed}|' || draw || '|' || day), 1, 8) AS BIGINT) AS h
      FROM range({draws}) a(draw), range({days}) b(day)
    ),
    totals AS (
      SELECT store_id, sku_id, draw, sum(target) AS total
      FROM sizes CROSS JOIN numbers
           JOIN ranked USING (store_id, sku_id, n) WHERE position = h % n
      GROUP BY ALL
    ),
    baseline AS (
      SELECT store_id, sku_id, quantile_cont(CAST(total AS DOUBLE), {level}::DOUBLE) AS order_up_to
      FROM totals GROUP BY ALL
    )
    """


_BASELINE = "SELECT store_id, sku_id, round(order_up_to, 6) AS order_up_to FROM baseline"
_L, _SL = REPLAY.lead_time_days, REPLAY.service_level
_CF = quantile_column(FRACTILE)


def _replay(baseline, every=1, known=KNOWN):
    """CTEs ending in ``results``, one row per policy and decision."""
    return (
        LEAD_ROWS, BOUNDS, TRAIN, TEST, known, _model([FRACTILE]), _scored([FRACTILE]), baseline,
        f"""
        quantities AS (
          SELECT 'ml_quantile' AS policy, s.*, {_CF} AS q
          FROM scored s JOIN baseline USING (store_id, sku_id)
          UNION ALL
          SELECT 'classical_baseline', s.*, order_up_to
          FROM scored s JOIN baseline USING (store_id, sku_id)
        ),
        results AS (
          SELECT policy, store_id, sku_id, origin_date, target_date, q AS order_quantity,
                 CAST(target AS DOUBLE) AS actual_demand, sell_price,
                 sell_price * {UNDER!r}::DOUBLE * greatest(target - q, 0) AS understock_cost,
                 sell_price * {OVER!r}::DOUBLE * greatest(q - target, 0) AS overstock_cost,
                 sell_price * {UNDER!r}::DOUBLE * greatest(target - q, 0)
                   + sell_price * {OVER!r}::DOUBLE * greatest(q - target, 0) AS cost
          FROM quantities WHERE (origin_date - DATE '1970-01-01') % {every} = 0
        )
        """,
    )


_EMBARGO = f"known AS (SELECT rows.* FROM rows, bounds WHERE origin_date < test_start - {_L - 1})"

_ADVICE_CTES = f"""
current_day AS (SELECT max(origin_date) AS day FROM rows),
train AS (
  SELECT rows.* FROM rows WHERE origin_date < (
    SELECT min(origin_date) FROM (
      SELECT DISTINCT origin_date FROM rows, current_day WHERE origin_date < day
      ORDER BY origin_date DESC LIMIT 28))
),
test AS (SELECT rows.* FROM rows, current_day WHERE origin_date = day)
"""
_ADVICE_ROWS = f"""
advice AS (
  SELECT store_id, sku_id, origin_date, target_date, 7 AS lead_time_days,
         {_CF} AS order_quantity, q_0_5 AS median_forecast, {_CF} - q_0_5 AS safety_stock,
         {FRACTILE!r}::DOUBLE AS critical_fractile, {UNDER!r}::DOUBLE AS understock_cost_ratio,
         {OVER!r}::DOUBLE AS overstock_cost_ratio,
         CAST(target AS DOUBLE) AS actual_demand, 'feature_store_v1' AS snapshot_table
  FROM scored
)
"""
_PAIR = [0.5, FRACTILE]
_ADVICE = (LEAD_ROWS, _ADVICE_CTES, _model(_PAIR), _scored(_PAIR), _ADVICE_ROWS)

def _rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


_ADVICE_OUT = (
    "SELECT store_id, sku_id, origin_date, target_date, lead_time_days, actual_demand, snapshot_table, "
    + _rounded("order_quantity median_forecast safety_stock critical_fractile understock_cost_ratio "
               "overstock_cost_ratio")
    + " FROM advice"
)
_RESULTS = (
    "SELECT policy, store_id, sku_id, origin_date, target_date, actual_demand, "
    + _rounded("order_quantity sell_price understock_cost overstock_cost cost")
)
RESULTS = f"{_RESULTS} FROM results"

_SAVINGS = """
SELECT round(sum(CASE WHEN policy = 'classical_baseline' THEN cost END), 4) AS baseline_cost,
       round(sum(CASE WHEN policy = 'ml_quantile' THEN cost END), 4) AS ml_cost,
       round(sum(CASE WHEN policy = 'classical_baseline' THEN cost END)
             - sum(CASE WHEN policy = 'ml_quantile' THEN cost END), 4) AS savings
FROM results
"""

ORACLES |= {
    "baseline_normal": panel(_BASELINE, LEAD_ROWS, BOUNDS, KNOWN, _normal(_L, _SL)),
    "baseline_poisson": panel(_BASELINE, LEAD_ROWS, BOUNDS, KNOWN, _poisson(_L, _SL)),
    "baseline_bootstrap": panel(_BASELINE, LEAD_ROWS, BOUNDS, KNOWN, _bootstrap(_L, _SL)),
    "recommendations": panel(_ADVICE_OUT, *_ADVICE),
    "recommendation_summary": panel(
        """
        SELECT count(*) AS n_recommendations, min(origin_date) AS recommendation_date,
               max(lead_time_days) AS lead_time_days,
               round(sum(order_quantity), 6) AS total_order_quantity,
               round(sum(safety_stock), 6) AS total_safety_stock,
               round(min(critical_fractile), 6) AS critical_fractile,
               max(snapshot_table) AS snapshot_table
        FROM advice
        """,
        *_ADVICE,
    ),
    "top_misses": panel(
        """
        SELECT store_id, sku_id, origin_date, target_date, actual_demand,
               round(order_quantity, 6) AS order_quantity,
               round(median_forecast, 6) AS median_forecast, round(safety_stock, 6) AS safety_stock,
               round(abs(order_quantity - actual_demand), 6) AS absolute_miss
        FROM advice
        ORDER BY abs(order_quantity - actual_demand) DESC, store_id, sku_id, target_date LIMIT 20
        """,
        *_ADVICE,
    ),
    "policy_replay": panel(RESULTS, *_replay(_bootstrap(_L, _SL))),
    "policy_replay_normal": panel(RESULTS, *_replay(_normal(_L, _SL), every=7)),
    "policy_replay_poisson": panel(
        RESULTS, *_replay(_poisson(1, _SL), known=_EMBARGO)
    ),
    "policy_summary": panel(
        """
        SELECT policy, count(*) AS n_decisions, round(sum(cost), 4) AS total_cost,
               round(sum(understock_cost), 4) AS total_understock_cost,
               round(sum(overstock_cost), 4) AS total_overstock_cost,
               round(avg(cost), 6) AS mean_cost
        FROM results GROUP BY policy
        """,
        *_replay(_bootstrap(_L, _SL)),
    ),
    "policy_savings": panel(_SAVINGS, *_replay(_bootstrap(_L, _SL))),
    "snapshot_lineage": panel(
        """
        SELECT 2 AS version, 'feature_store_v2' AS table_name, 'second' AS git_commit,
               count(*) AS row_count, min(date) AS min_date, max(date) AS max_date
        FROM store
        """,
        STORE,
    ),
    "snapshot_by_name": panel(
        """
        SELECT 1 AS version, 'feature_store_v1' AS table_name, 'first' AS git_commit,
               count(*) AS row_count, min(date) AS min_date, max(date) AS max_date,
               count(*) AS stored_rows
        FROM sales
        """
    ),
    "stored_recommendations": panel(_ADVICE_OUT, *_ADVICE),
    "stored_replay": panel(
        f"{_RESULTS}, 'feature_store_v2' AS snapshot_table FROM results", *_replay(_normal(_L, _SL))
    ),
    "skipped_decisions": panel(
        f"""
        SELECT store_id, sku_id, count(*) AS n_skipped FROM test t
        WHERE NOT EXISTS (SELECT 1 FROM rows k, bounds WHERE k.store_id = t.store_id
                          AND k.sku_id = t.sku_id AND k.origin_date < test_start - {EMBARGO})
        GROUP BY ALL
        """,
        LEAD_ROWS, BOUNDS, TEST,
    ),
    "ingest_csv": panel("SELECT * FROM sales"),
}


def _kpi():
    advice = ", ".join(
        c.strip() for c in (
            _ADVICE_CTES.replace("train AS", "a_train AS").replace("test AS", "a_test AS"),
            _model(_PAIR, "a_train").replace("by_day AS", "a_by_day AS")
            .replace("by_series AS", "a_by_series AS").replace("overall AS", "a_overall AS"),
            _scored(_PAIR, "a_test", "a_scored").replace("overall a", "a_overall a")
            .replace("by_day d", "a_by_day d").replace("by_series s", "a_by_series s"),
            _ADVICE_ROWS.replace("FROM scored", "FROM a_scored"),
        )
    )
    errors = _model([0.5]).replace("by_day AS", "e_by_day AS").replace(
        "by_series AS", "e_by_series AS").replace("overall AS", "e_overall AS")
    scored = _scored([0.5], "test", "e_scored").replace("overall a", "e_overall a").replace(
        "by_day d", "e_by_day d").replace("by_series s", "e_by_series s")
    return panel(
        """
        SELECT (SELECT round(sum(order_quantity), 6) FROM advice) AS total_order_quantity,
               (SELECT round(sum(safety_stock), 6) FROM advice) AS total_safety_stock,
               (SELECT round(sum(CASE WHEN policy = 'classical_baseline' THEN cost ELSE -cost END),
                             4) FROM results) AS savings,
               (SELECT round(sum(abs(target - q_0_5)) / sum(abs(target)), 6) FROM e_scored) AS wape
        """,
        *_replay(_bootstrap(_L, _SL)), advice, errors, scored,
    )


ORACLES["kpi_tiles"] = _kpi()
