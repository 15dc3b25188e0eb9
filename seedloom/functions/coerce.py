"""Values as a declared column stores them, and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.sources.ddl import ColumnDef


def limited(column: ColumnDef) -> bool:
    return isinstance(column.spark_type(), T.StringType) and column.length is not None and column.length > 0


def truncated(value: Column, column: ColumnDef) -> Column:
    """Whether coerce() will shorten a value."""
    return F.coalesce(F.length(value.cast("string")) > column.length, F.lit(False)) if limited(column) else F.lit(False)


def coerce(value: Column, column: ColumnDef, given: T.DataType | None = None) -> Column:
    """Strings are cut to the declared length, decimals rounded half away from zero; bad text is an error (ANSI casts)."""
    kind = column.spark_type()
    if isinstance(kind, T.StringType):
        value = value.cast("string")
        return F.substring(value, 1, column.length) if limited(column) else value
    if isinstance(kind, T.DecimalType):
        return F.round(value.cast(T.DecimalType(38, 18 if kind.scale <= 10 else kind.scale)), kind.scale).cast(kind)
    if isinstance(kind, T.BinaryType) and not isinstance(given, T.BinaryType):
        text = value.cast("string")
        return F.unhex(F.when(text.startswith("0x"), F.substring(text, F.lit(3), F.length(text))).otherwise(text))
    if isinstance(kind, (T.ShortType, T.IntegerType, T.LongType)) and isinstance(given, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.bround(value).cast(kind)
    return value.cast(kind)


def printed(value: Column, kind: T.DataType) -> Column:
    """A value as CSV cells show it; null as empty text."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "1").otherwise("0")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("0x"), F.hex(value))
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        text = F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.TimestampType):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ssxxx")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def canonical(value: Column, kind: T.DataType) -> Column:
    """The text of keys and planned values: null is empty, booleans are 1 and 0, times are ISO."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "1").otherwise("0")
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        text = F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))
