"""Common table expressions that rebuild the retail panel from the raw tables in plain SQL."""

from stockloom.sources.order_lines import RUN, SLOW_EVERY

PANEL = f"""
span AS (
  SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem
),
store_of AS (
  SELECT s_suppkey, r_name AS store_id,
         CASE r_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'WI' ELSE r_name END
           AS state_id
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
                JOIN region ON r_regionkey = n_regionkey
),
items AS (
  SELECT p_partkey, cat_id, dept_id,
         'ITEM_' || dept_id || '_' || CAST((p_partkey - 1) // {RUN} AS VARCHAR) || '_'
           || CASE WHEN p_partkey % {SLOW_EVERY} = 0 THEN 'S' ELSE 'F' END AS sku_id
  FROM (SELECT *, cat_id || CASE WHEN p_type < 'M' THEN '_1' ELSE '_2' END AS dept_id
        FROM (SELECT *, CASE WHEN p_size <= 25 THEN 'SMALL' ELSE 'LARGE' END AS cat_id FROM part))
),
cells AS MATERIALIZED (
  SELECT store_id, state_id, sku_id, CAST(l_shipdate AS DATE) AS date,
         CAST(floor((CAST(l_shipdate AS DATE) - DATE '1970-01-01' + 5) / 7) AS INTEGER) AS wk,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem JOIN store_of ON s_suppkey = l_suppkey JOIN items ON p_partkey = l_partkey
  GROUP BY ALL
),
series AS (SELECT DISTINCT store_id, state_id, sku_id FROM cells),
stores AS (SELECT DISTINCT store_id, state_id FROM series),
skus AS (SELECT DISTINCT sku_id, dept_id, cat_id FROM series JOIN items USING (sku_id)),
days AS (
  SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS date
  FROM span
),
calendar AS (
  SELECT date,
         'd_' || CAST(date - DATE '1970-01-01' AS VARCHAR) AS d,
         CAST(floor((date - DATE '1970-01-01' + 5) / 7) AS INTEGER) AS wm_yr_wk,
         CAST(dayofweek(date) AS TINYINT) AS day_of_week,
         CAST(weekofyear(date) AS TINYINT) AS week_of_year,
         CAST(month(date) AS TINYINT) AS month,
         CAST(year(date) AS SMALLINT) AS year,
         dayofweek(date) IN (0, 6) AS is_weekend,
         CASE strftime(date, '%m-%d') WHEN '02-14' THEN 'ValentinesDay'
              WHEN '07-04' THEN 'IndependenceDay' WHEN '12-25' THEN 'Christmas' END AS event_name_1,
         CASE strftime(date, '%m-%d') WHEN '02-14' THEN 'Cultural'
              WHEN '07-04' THEN 'National' WHEN '12-25' THEN 'National' END AS event_type_1,
         CASE strftime(date, '%m-%d') WHEN '11-01' THEN 'AllSaints' END AS event_name_2,
         CASE strftime(date, '%m-%d') WHEN '11-01' THEN 'Religious' END AS event_type_2,
         strftime(date, '%m-%d') IN ('02-14', '07-04', '11-01', '12-25') AS is_event,
         strftime(date, '%m-%d') IN ('07-04', '11-01', '12-25') AS is_holiday,
         day(date) % 3 = 1 AS snap_ca,
         (date - DATE '1970-01-01') % 14 < 5 AS snap_tx,
         month(date) % 2 = 0 AND day(date) > 12 AS snap_wi
  FROM days
),
weekly AS (
  SELECT store_id, sku_id, wk,
         (2 * sum(cents) + sum(units)) // (2 * sum(units)) / 100.0::DOUBLE AS price
  FROM cells GROUP BY ALL
),
prices AS (
  SELECT * FROM (
    SELECT store_id, sku_id, wm_yr_wk,
           last_value(price IGNORE NULLS) OVER (PARTITION BY store_id, sku_id ORDER BY wm_yr_wk)
             AS sell_price
    FROM (SELECT DISTINCT wm_yr_wk FROM calendar) CROSS JOIN
         (SELECT store_id, sku_id FROM series)
         LEFT JOIN (SELECT store_id, sku_id, wk AS wm_yr_wk, price FROM weekly)
           USING (store_id, sku_id, wm_yr_wk)
  ) WHERE sell_price IS NOT NULL
),
long_sales AS (
  SELECT s.store_id, s.sku_id, c.d, c.date, c.wm_yr_wk, CAST(coalesce(units, 0) AS INTEGER)
           AS units_sold
  FROM series s CROSS JOIN calendar c
       LEFT JOIN cells x ON x.store_id = s.store_id AND x.sku_id = s.sku_id AND x.date = c.date
),
sales AS (
  SELECT store_id, sku_id, date, units_sold, sell_price
  FROM long_sales JOIN prices USING (store_id, sku_id, wm_yr_wk)
)
"""


def panel(select: str, *ctes: str) -> str:
    """A query over the panel, with further CTEs after the panel's own."""
    return "WITH " + ",\n".join([PANEL.strip(), *[c.strip() for c in ctes]]) + "\n" + select.strip()
