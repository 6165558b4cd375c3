"""Source side: status columns, the backlog filter and scan, and the request-record source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.config import STATUS_PENDING, TERMINAL_STATES
from spindle.schemas import REQUEST, REQUEST_JSON, SOURCE_COLUMNS, STATUS_COLUMN, STATUS_TS_COLUMN


def ensure_status(df: DataFrame, status_col: str = STATUS_COLUMN) -> DataFrame:
    """Add the status pair when the source lacks it: existing rows get 'pending' and no time."""
    ts_col = f"{status_col}_timestamp" if status_col != STATUS_COLUMN else STATUS_TS_COLUMN
    if status_col not in df.columns:
        df = df.withColumn(status_col, F.lit(STATUS_PENDING))
    if ts_col not in df.columns:
        df = df.withColumn(ts_col, F.lit(None).cast("timestamp"))
    return df


def not_terminal(status: Column | str) -> Column:
    """Null-safe backlog predicate: NULL and non-terminal states stay eligible.

    ``NOT (s <=> x)`` for each terminal state; ``NOT IN`` would drop NULL. The predicate reaches
    the parquet scan as ``Not(EqualNullSafe(..))``.
    """
    s = F.col(status) if isinstance(status, str) else status
    return reduce(lambda a, b: a & b, [~s.eqNullSafe(F.lit(x)) for x in TERMINAL_STATES])


def eligible(df: DataFrame, status_col: str = STATUS_COLUMN) -> DataFrame:
    return df.where(not_terminal(status_col))


def backlog_order() -> list[Column]:
    """Oldest first, NULL times last, id as tie-break (the reference has none)."""
    return [F.col("original_timestamp").asc_nulls_last(), F.col("id").asc()]


def backlog_scan(df: DataFrame, limit: int | None, status_col: str = STATUS_COLUMN) -> DataFrame:
    """The 12 analysed columns of unprocessed rows, oldest first, at most ``limit`` rows.

    ``orderBy + limit`` plans as TakeOrderedAndProject: each task keeps ``limit`` rows, so a
    bounded batch never sorts the whole backlog. ``limit=None`` returns the whole backlog
    (used by the run-to-empty batch and the stream, which bound work by files instead).
    """
    rows = eligible(ensure_status(df, status_col), status_col).select(*SOURCE_COLUMNS)
    if limit is None:
        return rows
    return rows.orderBy(*backlog_order()).limit(limit)


def request_source(spark: SparkSession, path: str) -> DataFrame:
    """Analysis requests as JSON lines (one document per line, ISO-8601 times)."""
    return spark.read.schema(REQUEST_JSON).option("mode", "PERMISSIVE").json(path)


def request_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A handful of in-memory requests (the on-request path) as a DataFrame of the same shape."""
    return spark.createDataFrame(records, REQUEST)
