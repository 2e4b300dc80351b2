"""SQL types, their families and conversions, as columns.

JSON numbers arrive as FLOAT, and FLOAT becomes an integer by rounding up. Timestamps have microseconds
(the text form prints nine digits). UNSIGNED types are wider Spark types with a range check.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlError

SIGNED, UNSIGNED = ("SMALLINT", "INTEGER", "BIGINT"), ("UNSIGNED INTEGER", "UNSIGNED BIGINT")
SPARK = {
    "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "UNSIGNED INTEGER": T.LongType(), "UNSIGNED BIGINT": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "TIMESTAMP": T.TimestampType(), "DURATION": T.LongType(), "NULL": T.NullType(),
}
_TOP = {"UNSIGNED INTEGER": (1 << 32) - 1, "UNSIGNED BIGINT": (1 << 64) - 1}


def family(t: str) -> str:
    return "signed" if t in SIGNED else "unsigned" if t in UNSIGNED else t


def format_timestamp(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000"))


def _checked(c: Column, ok: Column, what: str) -> Column:
    return F.when(c.isNull() | ok, c).otherwise(F.raise_error(F.lit(what)))


def convert(c: Column, source: str, target: str, lenient: bool = False) -> Column:
    """c of one type as another. What can't be converted is an error in analysis; a value that doesn't fit is an error in the row, or NULL if lenient."""
    cast = (lambda x, t: x.try_cast(t)) if lenient else (lambda x, t: x.cast(t))
    if source == target:
        return c
    if source == "NULL":
        return F.lit(None).cast(SPARK[target])
    if source in SIGNED and target in SIGNED:
        return cast(c, SPARK[target])
    if source in SIGNED + UNSIGNED and target in UNSIGNED and not (source in UNSIGNED and target not in UNSIGNED):
        wide = c.cast("decimal(20,0)")
        ok = (wide >= 0) & (wide <= F.lit(str(_TOP[target])).cast("decimal(20,0)"))
        return F.when(ok, cast(c, SPARK[target])) if lenient else _checked(c, ok, f"out of range for {target}").cast(SPARK[target])
    if source in SIGNED and target == "FLOAT":
        return c.cast("float")
    if source == "FLOAT" and target in SIGNED:
        lo, hi = {"SMALLINT": (-(1 << 15), (1 << 15) - 1), "INTEGER": (-(1 << 31), (1 << 31) - 1), "BIGINT": (-(1 << 63), (1 << 63) - 1)}[target]
        d = c.cast("double")
        return F.when(d.isNull(), None).when(F.isnan(d), 0).when(d <= lo, lo).when(d > hi - 1, hi).otherwise(F.ceil(d)).cast(SPARK[target])  # saturates
    if source == "TEXT" and target == "TIMESTAMP":
        return F.try_to_timestamp(c) if lenient else F.to_timestamp(c)
    if source == "TIMESTAMP" and target == "TEXT":
        return format_timestamp(c)
    raise SqlError(f"{source} can't be converted to {target}")
