"""A local session and a small set of raw retail files with the defects that real ones have."""

import csv
import functools
import sys
import zlib
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stockloom.operators.forest import ForestQuantiles  # noqa: E402
from stockloom.plans import jobs  # noqa: E402
from stockloom.session import local_session  # noqa: E402
from stockloom.settings import ForecastSpec, ReplaySpec  # noqa: E402
from stockloom.sources import raw_csv  # noqa: E402
from stockloom.sources.tables import Tables  # noqa: E402

SMALL_FORECAST = ForecastSpec(
    horizon_days=5, test_size_days=3, validation_size_days=3, origin_stride_days=1
)
SMALL_FOREST = functools.partial(ForestQuantiles, trees=4, depths=(3,), min_leaf_rows=5)
SMALL_REPLAY = ReplaySpec(service_level=0.9, lead_time_days=3, n_simulations=200)

STATE = {"harbour": "WI", "market": "CA", "station": "NY"}
KIND = {"oats": ("grain", "pantry"), "rye": ("grain", "pantry"), "soap": ("wash", "home")}
SERIES = [
    ("harbour", "oats"),
    ("harbour", "soap"),
    ("market", "oats"),
    ("market", "rye"),
    ("market", "soap"),
    ("station", "rye"),
    ("station", "soap"),
]
CALENDAR_DAYS = [date(2020, 2, 29) + timedelta(days=n) for n in range(63)]
LAUNCH_WEEK = {("market", "rye"): 2, ("station", "soap"): 1}
UNPRICED = {("harbour", "soap"): {4}, ("market", "oats"): {5, 6}}  # weeks without a price
EVENT = {date(2020, 3, 17): ("Parade", "Cultural", 1), date(2020, 4, 12): ("Spring", "Religious", 2)}


def week_of(day: date) -> int:
    return 900 + (day - CALENDAR_DAYS[0]).days // 7


def _mixed(*parts) -> int:
    return zlib.crc32("/".join(map(str, parts)).encode())


def units_of(store: str, item: str, day: date) -> int | None:
    """Demand with a weekend peak; None where the file has an empty cell."""
    draw = _mixed(store, item, day)
    if draw % 47 == 0 and day < CALENDAR_DAYS[-12]:
        return None
    return draw % 5 + len(item) * (1 + (day.weekday() >= 5)) - 3


def price_of(store: str, item: str, week: int) -> float | None:
    number = week - 900
    if number < LAUNCH_WEEK.get((store, item), 0) or number in UNPRICED.get((store, item), ()):
        return None
    return round(1.5 + len(store) / 4 + (_mixed(item) % 7) * 0.35 + number // 3 * 0.05, 2)


def kept_sales() -> dict[tuple[str, str, date], tuple[int, float]]:
    """What ingest keeps: cells with units on days with a price."""
    cells = {(s, i, d): (units_of(s, i, d), price_of(s, i, week_of(d))) for s, i in SERIES for d in CALENDAR_DAYS}
    return {k: v for k, v in cells.items() if None not in v}


def cells_with_units() -> int:
    return sum(units_of(s, i, d) is not None for s, i in SERIES for d in CALENDAR_DAYS)


def _write(path: Path, header: list[str], rows: list[list]) -> None:
    with path.open("w", newline="", encoding="utf-8") as handle:
        csv.writer(handle).writerows([header, *[["" if v is None else v for v in r] for r in rows]])


def write_raw_files(folder: Path, days: list[date] = CALENDAR_DAYS) -> None:
    def calendar_row(number: int, day: date) -> list:
        name, kind, slot = EVENT.get(day, (None, None, 1))
        events = [name, kind, None, None] if slot == 1 else [None, None, name, kind]
        snaps = [int(day.day % 3 == 0), int(day.day > 24), int(day.weekday() == 2)]
        return [day.isoformat(), week_of(day), day.strftime("%A"), number % 7 + 1, day.month, day.year,
                f"d_{number + 1}", *events, *snaps]

    # The column names of the raw files.
    calendar = [
        "date", "wm_yr_wk", "weekday", "wday", "month", "year", "d", "event_name_1", "event_type_1",
        "event_name_2", "event_type_2", "snap_CA", "snap_TX", "snap_WI",
    ]
    prices = ["store_id", "item_id", "wm_yr_wk", "sell_price"]
    sales = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    numbered = list(enumerate(CALENDAR_DAYS))
    _write(folder / raw_csv.CALENDAR, calendar, [calendar_row(n, d) for n, d in numbered if d in days])
    priced = [[s, i, w, price_of(s, i, w)] for s, i in SERIES for w in range(900, 909)]
    _write(folder / raw_csv.PRICES, prices, [row for row in priced if row[3] is not None])
    _write(
        folder / raw_csv.SALES,
        sales + [f"d_{n + 1}" for n, _ in numbered],
        [[f"{i}/{s}", i, *KIND[i], s, STATE[s], *(units_of(s, i, d) for d in CALENDAR_DAYS)] for s, i in SERIES],
    )


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    write_raw_files(folder)
    return folder


@pytest.fixture(scope="session")
def project(spark, raw_dir, tmp_path_factory):
    """Tables after ingest and one feature snapshot."""
    tables = Tables(spark, str(tmp_path_factory.mktemp("project")))
    jobs.ingest_raw(tables, str(raw_dir))
    jobs.build_features(tables, git_commit="abc")
    return tables


def project_dataset(project, lead: int = 3):
    from stockloom.operators import horizon
    from stockloom.settings import FeatureSpec
    from stockloom.sources import snapshots

    return horizon.assemble_horizon(snapshots.read_snapshot(project), FeatureSpec(), lead)


def lead_pairs(lead: int = 3) -> dict[tuple[str, str, date], int]:
    """(series, origin) to the target units, where both days are kept."""
    kept, ahead = kept_sales(), timedelta(days=lead)
    return {(s, i, d): kept[s, i, d + ahead][0] for s, i, d in kept if (s, i, d + ahead) in kept}
