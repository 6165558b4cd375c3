"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.session import apply_defaults, ensure_checkpoint_dir, shared_path, ship_package

# the white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage
# return; bytes.split() in Python splits at exactly these
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults, the shared folder and the package on the workers."""
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # rows hold whole texts
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return shared_path(spark, "spindle-llm", f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the table and never a recomputation
    of what led to it, and values that depend on the partitioning (row numbers) become fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads, and let go of the shuffle files behind them
    (Spark removes these once the driver has collected the garbage that refers to them)."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            delete_path(df.sparkSession, path)
    gc.collect()
    for df in frames[:1]:
        df.sparkSession.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return the memory that this worker has freed to the system.

    Workers are reused by later stages, and the allocators keep what an earlier one has freed.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
    if trim is not None:
        trim(0)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(id_col: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns ``__id`` and ``__rk`` that name a row: its id and a hash of its text.

    Rows that share an id but not the text stay apart; rows equal in both are repeats of one
    document and get the same result. Join on these null-safely (``key_match``).
    """
    return [F.col(id_col).alias("__id"), F.xxhash64(text_or_empty(text)).alias("__rk")]


def key_match(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & (left["__rk"] == right["__rk"])
