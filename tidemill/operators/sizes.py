"""Which side of a join is small enough to be sent to every executor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bytes that are broadcast at most
BROADCAST_BYTES = 8 << 20
#: what a value counts besides its text
VALUE_BYTES = 16


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + VALUE_BYTES
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0)) + VALUE_BYTES
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, (_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(VALUE_BYTES))
    return F.lit(VALUE_BYTES)


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of df take, counted."""
    row = reduce(lambda a, b: a + b, (_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its counted bytes allow it, and whether they do."""
    small = measured_bytes(df) <= most
    return (F.broadcast(df) if small else df), small
