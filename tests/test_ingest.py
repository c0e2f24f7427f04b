import shutil
from datetime import date

import pytest
from pyspark.sql import functions as F

from stockloom import schemas
from stockloom.operators import ingest, quality, summaries
from stockloom.plans import jobs
from stockloom.sources import raw_csv
from stockloom.sources.tables import Tables
from tests.conftest import (
    CALENDAR_DAYS,
    EVENT,
    SERIES,
    cells_with_units,
    kept_sales,
    price_of,
    week_of,
    write_raw_files,
)

N = len(kept_sales())


def test_counts_and_idempotence(spark, raw_dir, tmp_path):
    tables = Tables(spark, str(tmp_path))
    expected = {
        "stores": 3,
        "skus": 3,
        "calendar_days": 63,
        "sales_rows": N,
        "dropped_rows": cells_with_units() - N,
    }
    assert expected["dropped_rows"] > 0
    for _ in range(2):
        assert jobs.ingest_raw(tables, str(raw_dir)).first().asDict() == expected
    assert tables.require("sales").count() == N


def test_schemas(project):
    wanted = {
        "stores": schemas.STORES,
        "skus": schemas.SKUS,
        "calendar": schemas.CALENDAR,
        "prices": schemas.PRICES,
        "sales": schemas.SALES,
    }
    for name, schema in wanted.items():
        found = project.require(name).schema
        assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schema]


def test_series_start_at_their_launch_and_pause_without_price(project):
    sales = project.require("sales").where("store_id = 'market'")
    first = {r[0]: r[1] for r in sales.groupBy("sku_id").agg(F.min("date")).collect()}
    assert first["rye"] >= date(2020, 3, 14)
    weeks = {week_of(r.date) for r in sales.where("sku_id = 'oats'").collect()}
    assert weeks == set(range(900, 909)) - {905, 906}


def test_units_and_prices_are_those_of_the_files(project):
    rows = project.require("sales").collect()
    assert {(r.store_id, r.sku_id, r.date): (r.units_sold, r.sell_price) for r in rows} == kept_sales()
    assert len(rows) == N


def test_calendar_flags(project):
    days = {r.date: r for r in project.require("calendar").collect()}
    assert sorted(days) == CALENDAR_DAYS
    for day, row in days.items():
        assert row.day_of_week == day.isoweekday() % 7 and row.week_of_year == day.isocalendar().week
        assert row.is_weekend == (day.isoweekday() >= 6)
        assert row.is_event == (day in EVENT)
        assert row.is_holiday == (EVENT.get(day, ("", ""))[1] == "Religious")
        assert (row.snap_ca, row.snap_tx, row.snap_wi) == (day.day % 3 == 0, day.day > 24, day.isoweekday() == 3)


def test_a_calendar_with_a_hole_is_refused(spark, tmp_path):
    write_raw_files(tmp_path, [d for d in CALENDAR_DAYS if d != date(2020, 3, 20)])
    with pytest.raises(quality.QualityError, match="calendar_contiguous: 1 "):
        jobs.ingest_raw(Tables(spark, f"{tmp_path}/tables"), str(tmp_path))


def test_cultural_event_is_no_holiday_and_second_slot_counts(spark):
    rows = [
        ("2011-01-29", "d_1", "11101", "A", "Cultural", None, None, "0", "1", "0"),
        ("2011-01-30", "d_2", "11101", None, None, "B", "Religious", "1", "0", "0"),
        ("2011-01-31", "d_3", "11101", None, None, None, None, "0", "0", "1"),
    ]
    names = (
        "date d wm_yr_wk event_name_1 event_type_1 event_name_2 event_type_2 "
        "snap_CA snap_TX snap_WI"
    ).split()
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    flags = ingest.calendar(frame).orderBy("date").select("is_event", "is_holiday").collect()
    assert [tuple(f) for f in flags] == [(True, False), (True, True), (False, False)]


def test_unpivot_drops_null_cells_and_takes_only_day_columns(spark):
    wide = spark.createDataFrame(
        [("a", 1, None, 9), ("b", None, 0, 9)], "store_id string, d_1 int, d_2 int, d_x int"
    )
    rows = ingest.unpivot_days(wide, ["store_id"]).orderBy("store_id", "d").collect()
    assert [tuple(r) for r in rows] == [("a", "d_1", 1), ("b", "d_2", 0)]


def test_unpivot_agrees_with_the_builtin(spark, raw_dir):
    wide = raw_csv.read_raw(spark, str(raw_dir))["sales"]
    ids = ["store_id", "item_id"]
    builtin = wide.unpivot(ids, ingest.day_columns(wide), "d", "units_sold").dropna()
    ours = ingest.unpivot_days(wide, ids)
    assert ours.exceptAll(builtin).isEmpty() and builtin.exceptAll(ours).isEmpty()


def test_price_gaps_drop_rows_and_duplicate_prices_multiply(spark, project):
    calendar, prices = project.require("calendar"), project.require("prices")
    long = project.require("sales").join(calendar.select("date", "d"), "date").select(
        "store_id", "sku_id", "d", "units_sold"
    )
    kept = kept_sales()
    gap = prices.where("NOT (store_id = 'station' AND sku_id = 'rye' AND wm_yr_wk = 904)")
    lost = sum((s, i, week_of(d)) == ("station", "rye", 904) for s, i, d in kept)
    assert ingest.sales(long, calendar, gap).count() == N - lost < N
    twice = prices.unionAll(prices.where("store_id = 'harbour' AND wm_yr_wk = 901"))
    more = sum((s, week_of(d)) == ("harbour", 901) for s, _, d in kept)
    assert ingest.sales(long, calendar, twice).count() == N + more > N


def test_missing_files_are_listed(spark, raw_dir, tmp_path):
    shutil.copy(raw_dir / raw_csv.CALENDAR, tmp_path)
    with pytest.raises(raw_csv.MissingFilesError, match="sell_prices.*sales_train"):
        raw_csv.read_raw(spark, str(tmp_path))


def test_malformed_units_fail(spark, raw_dir, tmp_path):
    for name in (raw_csv.CALENDAR, raw_csv.PRICES):
        shutil.copy(raw_dir / name, tmp_path)
    text = (raw_dir / raw_csv.SALES).read_text().replace("harbour,WI,", "harbour,WI,many", 1)
    (tmp_path / raw_csv.SALES).write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest.long_sales(raw_csv.read_raw(spark, str(tmp_path))["sales"]).collect()


def checks_of(project, **changed):
    tables = {n: project.require(n) for n in ("stores", "skus", "calendar", "prices", "sales")}
    tables |= changed
    result = quality.quality_checks(
        tables["stores"], tables["skus"], tables["calendar"], tables["prices"], tables["sales"]
    )
    return result, {r.check_name: r for r in result.collect()}


def test_all_checks_pass(project):
    result, rows = checks_of(project)
    assert len(rows) == 13 and all(r.passed for r in rows.values())
    assert rows["sales_non_empty"].detail == f"{N} rows"
    assert rows["sales_key_unique"].detail == "ok"
    quality.require_quality(result)


def test_each_defect_is_found(spark, project):
    sales, prices = project.require("sales"), project.require("prices")
    first = sales.orderBy("store_id", "sku_id", "date").limit(1)
    bad = (
        sales.unionAll(first)
        .unionAll(first.withColumn("store_id", F.lit("XX")).withColumn("units_sold", F.lit(-1)))
        .unionAll(first.withColumn("sku_id", F.lit("YY")).withColumn("sell_price", F.lit(0.0)))
        .unionAll(first.withColumn("date", F.lit(date(2031, 5, 1))))
        .unionAll(first.withColumn("date", F.lit(date(2031, 5, 2))).withColumn(
            "sell_price", F.lit(None).cast("double")))
    )
    hole = date(2020, 4, 20)
    calendar = project.require("calendar").where(F.col("date") != F.lit(hole))
    result, rows = checks_of(
        project, sales=bad, calendar=calendar, prices=prices.unionAll(prices.limit(2))
    )
    values = {n: r.value for n, r in rows.items() if not r.passed}
    assert values == {
        "sales_key_unique": 1,
        "prices_key_unique": 2,
        "no_negative_units": 1,
        "positive_prices": 2,
        "sales_stores_exist": 1,
        "sales_skus_exist": 1,
        "sales_dates_in_calendar": 2 + sum(d == hole for _, _, d in kept_sales()),
        "calendar_contiguous": 1,
    }
    assert rows["sales_stores_exist"].detail == "1 violating rows"
    with pytest.raises(quality.QualityError, match="calendar_contiguous: 1 violating rows"):
        quality.require_quality(result)


def test_empty_tables(spark, project):
    _, rows = checks_of(
        project,
        calendar=spark.createDataFrame([], schemas.CALENDAR),
        sales=spark.createDataFrame([], schemas.SALES),
    )
    assert rows["calendar_non_empty"].detail == "table is empty"
    assert rows["calendar_contiguous"].passed  # a NULL number counts as zero
    assert not rows["sales_non_empty"].passed and rows["sales_key_unique"].passed


def test_null_keys_are_no_orphans(spark, project):
    facts = spark.createDataFrame([("market",), (None,), ("ZZ",), ("ZZ",)], "store_id string")
    rows = summaries.orphans(facts, project.require("stores"), "store_id").collect()
    assert [tuple(r) for r in rows] == [("ZZ", 2)]


def test_summaries(project):
    sales, skus, stores = (project.require(n) for n in ("sales", "skus", "stores"))
    day, kept = date(2020, 4, 1), kept_sales()
    by_day = summaries.sales_summary(sales, skus, stores)
    row = by_day.where("state_id = 'CA' AND cat_id = 'pantry' AND date = '2020-04-01'").first()
    own = [kept["market", i, day] for i in ("oats", "rye") if ("market", i, day) in kept]
    assert row.units_sold == sum(u for u, _ in own)
    assert row.revenue == pytest.approx(sum(u * p for u, p in own))
    coverage = {(r.store_id, r.sku_id): r for r in summaries.series_coverage(sales).collect()}
    assert coverage.keys() == set(SERIES)
    for (store, item), r in coverage.items():
        own = sorted(d for s, i, d in kept if (s, i) == (store, item))
        assert (r.first_date, r.last_date, r.n_days) == (own[0], own[-1], len(own))
    assert summaries.duplicate_keys(sales, summaries.SALES_KEY).isEmpty()
    assert price_of("market", "rye", 901) is None
