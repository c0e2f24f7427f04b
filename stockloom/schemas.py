"""Column layouts of the stored tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _B, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()

STORES = _struct(store_id=_S, state_id=_S)
SKUS = _struct(sku_id=_S, dept_id=_S, cat_id=_S)
CALENDAR = _struct(
    date=T.DateType(),
    d=_S,
    wm_yr_wk=_I,
    day_of_week=T.ByteType(),
    week_of_year=T.ByteType(),
    month=T.ByteType(),
    year=T.ShortType(),
    is_weekend=_B,
    event_name_1=_S,
    event_type_1=_S,
    event_name_2=_S,
    event_type_2=_S,
    is_event=_B,
    is_holiday=_B,
    snap_ca=_B,
    snap_tx=_B,
    snap_wi=_B,
)
PRICES = _struct(store_id=_S, sku_id=_S, wm_yr_wk=_I, sell_price=_D)
SALES = _struct(store_id=_S, sku_id=_S, date=T.DateType(), units_sold=_I, sell_price=_D)
FEATURE_SNAPSHOTS = _struct(
    version=_I,
    table_name=_S,
    created_at=T.TimestampType(),
    git_commit=_S,
    config_hash=_S,
    row_count=T.LongType(),
    min_date=T.DateType(),
    max_date=T.DateType(),
)
RUN_LOG = _struct(
    run_id=_S,
    experiment=_S,
    started_at=T.TimestampType(),
    kind=_S,
    name=_S,
    quantile=_D,
    param=_S,
    metric=_D,
)

# Raw files. The wide sales file adds one integer column per day after these identifiers.
RAW_CALENDAR = _struct(
    date=_S,
    wm_yr_wk=_S,
    weekday=_S,
    wday=_I,
    month=_I,
    year=_I,
    d=_S,
    event_name_1=_S,
    event_type_1=_S,
    event_name_2=_S,
    event_type_2=_S,
    snap_CA=_S,
    snap_TX=_S,
    snap_WI=_S,
)
RAW_PRICES = _struct(store_id=_S, item_id=_S, wm_yr_wk=_S, sell_price=_S)
RAW_SALES_IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: its columns, in its order, cast to its types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
