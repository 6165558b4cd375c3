"""Size-checked broadcasting of side tables.

A side table is broadcast only after its rows and their bytes are known to be below a limit;
above either the caller gets the plain DataFrame and Spark plans a shuffle join instead. Both are
summed on a cached copy, so the check costs one pass over the (small) side table and the
broadcast reuses the cached rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_ROWS = 2_000_000
DEFAULT_MAX_BYTES = 256 << 20


class SideTableTooLarge(ValueError):
    pass


def row_count(df: DataFrame) -> int:
    return df.count()


def width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value: those of its strings and 8 for every number, string, array and struct."""
    inner = F.lit(0).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        inner = F.octet_length(c).cast("long")
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            inner = inner + width(c[f.name], f.dataType)
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            inner = F.aggregate(c, inner, lambda acc, e: acc + width(e, kind.elementType))
        else:
            inner = F.size(c).cast("long") * 8
    elif isinstance(kind, T.MapType):
        inner = width(F.map_entries(c), T.ArrayType(T.StructType().add("key", kind.keyType).add("value", kind.valueType)))
    return F.lit(8).cast("long") + F.when(c.isNotNull(), inner).otherwise(0)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of ``df``."""
    return width(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]), df.schema)


def sized_broadcast(
    df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, *, max_bytes: int = DEFAULT_MAX_BYTES, cache: bool = True
) -> tuple[DataFrame, bool]:
    """(frame to join, broadcast?) — the broadcast hint only when the counted size allows it."""
    if cache:
        df = df.cache()
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    if n <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df), True
    return df, False


def require_rows(df: DataFrame, what: str, max_rows: int | None = None) -> int:
    """Fail fast when a model side table is empty (or larger than ``max_rows``)."""
    n = row_count(df)
    if n == 0:
        raise SideTableTooLarge(f"{what} is empty")
    if max_rows is not None and n > max_rows:
        raise SideTableTooLarge(f"{what} has {n} rows, more than {max_rows}")
    return n
