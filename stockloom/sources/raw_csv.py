"""Raw retail files: calendar, weekly prices and the wide daily sales matrix."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stockloom import schemas
from stockloom.operators.ingest import DAY_COLUMN

CALENDAR, PRICES, SALES = "calendar.csv", "sell_prices.csv", "sales_train_evaluation.csv"


class MissingFilesError(FileNotFoundError):
    """Required raw files are absent."""


def _header(spark: SparkSession, path: str) -> list[str] | None:
    """Column names from the first line; None if there is no such file."""
    try:
        lines = spark.read.text(path).head(1)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return [name.strip().strip('"') for name in lines[0].value.split(",")] if lines else []


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A typed scan; a header that differs from the schema or a malformed value is an error."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("maxColumns", 100_000)
        .csv(path)
    )


def sales_schema(header: list[str]) -> T.StructType:
    """Identifiers as text, day columns as integers, whatever their number."""
    return T.StructType(
        [
            T.StructField(n, T.IntegerType() if DAY_COLUMN.match(n) else T.StringType())
            for n in header
        ]
    )


def read_raw(spark: SparkSession, raw_dir: str) -> dict[str, DataFrame]:
    """The three raw tables of ``raw_dir``: calendar, prices, sales."""
    paths = {name: f"{raw_dir}/{name}" for name in (CALENDAR, PRICES, SALES)}
    headers = {name: _header(spark, path) for name, path in paths.items()}
    missing = [name for name, header in headers.items() if header is None]
    if missing:
        raise MissingFilesError(f"missing raw files in {raw_dir}: {', '.join(missing)}")
    return {
        "calendar": _scan(spark, paths[CALENDAR], schemas.RAW_CALENDAR),
        "prices": _scan(spark, paths[PRICES], schemas.RAW_PRICES),
        "sales": _scan(spark, paths[SALES], sales_schema(headers[SALES])),
    }
