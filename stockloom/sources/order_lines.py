"""Retail panel derived from order lines (lineitem, part, supplier, nation, region).

A store is a supplier region and units are ordered quantities per ship day. An item is a run of
``RUN`` part keys of one department (half of the sizes, half of the types), so every part carries
the attributes of its item; one part in ``SLOW_EVERY`` goes to a slow mover, often launched later.
The number of items, and with it the panel, grows with the part table; a series never has more rows
than the calendar has days.

Order lines are read once and summed per (store, item, week) with map-side combining, and these
weekly rows are stored: a store or item that owns a large share of all lines is down to one row per
week, and days, series, prices and sales are drawn from the weekly rows alone.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.session import write_and_read

RUN = 2000
SLOW_EVERY = 25  # every 25th part key is a slow mover
SERIES = ("store_id", "item_id")
DAYS_PER_TASK = 400_000  # daily rows, so that a task's memory does not grow with the panel
LEAST_DAYS_PER_TASK = 100_000  # below that, a task costs more to start than to run

# Month, day, event name, event type, event slot.
EVENTS = (
    (2, 14, "ValentinesDay", "Cultural", 1),
    (7, 4, "IndependenceDay", "National", 1),
    (11, 1, "AllSaints", "Religious", 2),
    (12, 25, "Christmas", "National", 1),
)

# Region key to state code; other regions keep their own name.
STATE_OF_REGION = {0: "CA", 1: "TX", 2: "WI"}


def _day_number(day: date) -> int:
    return (day - date(1970, 1, 1)).days


def week_of(day: Column) -> Column:
    """Week key; weeks run Saturday to Friday and are counted from the epoch."""
    return F.floor((F.unix_date(day) + 5) / 7).cast("int")


def day_in_week(week: Column, slot: int) -> Column:
    """The unix day number of the ``slot``-th day (1..7) of a week."""
    return week * 7 - 5 + (slot - 1)


CATEGORY = "if(p_size <= 25, 'SMALL', 'LARGE')"
DEPARTMENT = f"concat_ws('_', {CATEGORY}, if(p_type < 'M', '1', '2'))"
ITEM = (
    f"concat_ws('_', 'ITEM', {DEPARTMENT}, (p_partkey - 1) div {RUN},"
    f" if(p_partkey % {SLOW_EVERY} = 0, 'S', 'F'))"
)


def _state_of_region() -> Column:
    state = F.col("r_name")
    for key, code in STATE_OF_REGION.items():
        state = F.when(F.col("r_regionkey") == key, F.lit(code)).otherwise(state)
    return state


class OrderLinePanel:
    """The raw retail tables of one folder of order-line tables.

    The first use of the weekly rows stores them; everything else is lazy.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self._dir = sf_dir

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """store_id, state_id, item_id, day, units, cents: one row per order line.

        The lookups are joined one after the other, each a plain table scan, so Spark knows the
        size of every build side: nation and region are always broadcast, supplier and part while
        small.
        """
        items = self._table("part").selectExpr("p_partkey", f"{ITEM} AS item_id")
        return (
            self._table("lineitem")
            .select(
                "l_suppkey",
                "l_partkey",
                F.to_date("l_shipdate").alias("day"),
                F.expr("cast(l_quantity AS bigint)").alias("units"),
                F.expr("cast(round(l_extendedprice * 100) AS bigint)").alias("cents"),
            )
            .join(items, F.expr("l_partkey = p_partkey"))
            .join(self._table("supplier"), F.expr("l_suppkey = s_suppkey"))
            .join(self._table("nation"), F.expr("s_nationkey = n_nationkey"))
            .join(self._table("region"), F.expr("n_regionkey = r_regionkey"))
            .select(
                F.col("r_name").alias("store_id"),
                _state_of_region().alias("state_id"),
                "item_id",
                "day",
                "units",
                "cents",
            )
        )

    @cached_property
    def weekly(self) -> DataFrame:
        """One row per series and week with orders: units per day of the week, units, cents and
        the first and last day. Stored, so that the order lines are read once."""
        slot = "(unix_date(day) + 5) % 7 + 1"
        sums = self.lines.groupBy("state_id", *SERIES, week_of(F.col("day")).alias("week")).agg(
            *[F.expr(f"sum(if({slot} = {i}, units, NULL)) AS u{i}") for i in range(1, 8)],
            F.sum("units").alias("units"),
            F.sum("cents").alias("cents"),
            F.min("day").alias("lo"),
            F.max("day").alias("hi"),
        )
        return write_and_read(sums, "weekly")

    @cached_property
    def _extent(self) -> Row:
        """The first and the last ship day and the number of weekly rows."""
        return self.weekly.agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")
        ).first()

    @cached_property
    def days(self) -> tuple[date, date]:
        """The first and the last ship day."""
        return self._extent.lo, self._extent.hi

    @cached_property
    def partitions(self) -> int:
        """How many tasks the panel is dealt out to: as many as its daily rows need.

        Weekly rows are few and narrow, so adaptive execution would put a large part of the panel
        into one task, where a row then becomes seven and takes on its features.
        """
        rows = 7 * self._extent.n
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(usual, rows // LEAST_DAYS_PER_TASK), -(-rows // DAYS_PER_TASK))

    @cached_property
    def grid(self) -> DataFrame:
        """One row per series and calendar week: d_1..d_7 and the week's sell price.

        ``d_i`` is 0 on days without orders and NULL outside the calendar. The price is the
        week's revenue per unit in whole cents, carried forward through weeks without orders;
        weeks before a series' first order have no price.
        """
        order = Window.partitionBy(*SERIES).orderBy("week")
        first, last = map(_day_number, self.days)
        first_week, last_week = (week_of(F.lit(d)) for d in self.days)
        spans = self.weekly.repartition(self.partitions, *SERIES).select(
            "*",
            F.when(F.row_number().over(order) == 1, first_week).otherwise(F.col("week")).alias(
                "start"
            ),
            F.coalesce(F.lead("week").over(order) - 1, last_week).alias("stop"),
        )
        return spans.select("*", F.expr("explode(sequence(start, stop)) AS wm_yr_wk")).selectExpr(
            *SERIES,
            "wm_yr_wk",
            *[
                f"cast(if(wm_yr_wk * 7 - 5 + {i - 1} BETWEEN {first} AND {last},"
                f" if(wm_yr_wk = week, coalesce(u{i}, 0), 0), NULL) AS int) AS d_{i}"
                for i in range(1, 8)
            ],
            "if(wm_yr_wk >= week AND units > 0,"
            " ((2 * cents + units) div (2 * units)) / 100D, NULL) AS sell_price",
        )

    @cached_property
    def daily_sales(self) -> DataFrame:
        """The sales fact straight from the weekly grid.

        Equal to unpivoting the raw cells and joining calendar and prices, without those joins:
        the price already sits on the week's row. Rows stay clustered by series, so history
        windows on the result need no further shuffle.
        """
        cells = ", ".join(f"d_{i}" for i in range(1, 8))
        return (
            self.grid.where("sell_price IS NOT NULL")
            .selectExpr(
                "store_id",
                "item_id AS sku_id",
                "wm_yr_wk",
                "sell_price",
                f"posexplode(array({cells})) AS (slot, units_sold)",
            )
            .where("units_sold IS NOT NULL")
            .selectExpr(
                "store_id",
                "sku_id",
                "date_from_unix_date(wm_yr_wk * 7 - 5 + slot) AS date",
                "units_sold",
                "sell_price",
            )
        )

    @cached_property
    def store_master(self) -> DataFrame:
        """store_id, state_id of every region, with or without order lines."""
        return self._table("region").select(
            F.col("r_name").alias("store_id"), _state_of_region().alias("state_id")
        )

    @cached_property
    def raw_items(self) -> DataFrame:
        """item_id, dept_id, cat_id, one row per item of the part table."""
        return (
            self._table("part")
            .selectExpr(f"{ITEM} AS item_id", f"{DEPARTMENT} AS dept_id", f"{CATEGORY} AS cat_id")
            .distinct()
        )

    @cached_property
    def raw_series(self) -> DataFrame:
        """The identifier columns of the wide sales file: one row per series."""
        pairs = self.weekly.select("store_id", "state_id", "item_id").distinct()
        return pairs.join(self.raw_items, "item_id")

    @cached_property
    def raw_week_cells(self) -> DataFrame:
        """Wide cells, one row per series and week with day columns d_1..d_7."""
        return self.grid.drop("sell_price")

    @cached_property
    def raw_prices(self) -> DataFrame:
        """store_id, item_id, wm_yr_wk, sell_price; prices start in a series' launch week."""
        return self.grid.select(*SERIES, "wm_yr_wk", "sell_price").where("sell_price IS NOT NULL")

    @cached_property
    def raw_calendar(self) -> DataFrame:
        """One row per day from the first to the last ship day, like the raw calendar file."""

        def event(value: int, slot: int) -> str:
            cases = "".join(
                f" WHEN month = {e[0]} AND day = {e[1]} THEN '{e[value]}'"
                for e in EVENTS
                if e[4] == slot
            )
            return f"CASE{cases} END"

        first, last = map(_day_number, self.days)
        days = self.spark.range(first, last + 1, numPartitions=1).selectExpr(
            "cast(id AS int) AS number", "date_from_unix_date(cast(id AS int)) AS date"
        )
        return days.selectExpr("*", "month(date) AS month", "day(date) AS day").selectExpr(
            "cast(date AS string) AS date",
            "cast(cast(floor((number + 5) / 7) AS int) AS string) AS wm_yr_wk",
            "date_format(date, 'EEEE') AS weekday",
            "(number + 5) % 7 + 1 AS wday",
            "month",
            "year(date) AS year",
            "concat('d_', number) AS d",
            f"{event(2, 1)} AS event_name_1",
            f"{event(3, 1)} AS event_type_1",
            f"{event(2, 2)} AS event_name_2",
            f"{event(3, 2)} AS event_type_2",
            "cast(int(day % 3 = 1) AS string) AS snap_CA",
            "cast(int(number % 14 < 5) AS string) AS snap_TX",
            "cast(int(month % 2 = 0 AND day > 12) AS string) AS snap_WI",
        )
