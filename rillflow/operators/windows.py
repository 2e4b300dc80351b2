"""Panes, lateness and closing, in plain DataFrame operations.

A stream's frame has its columns, `__rt` (row time in microseconds) and `__seq` (array<bigint>, the arrival order).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.parser import Window

#: Ranges of arrival order that a running maximum is computed in, side by side: at most, and rows of one.
RANGES, RANGE_ROWS = 1024, 50_000


def panes(df: DataFrame, window: Window) -> DataFrame:
    """One row for each pane of a row, with `__open` and `__close`. Periods longer than the window leave gaps."""
    last = F.col("__rt") - F.pmod(F.col("__rt"), F.lit(window.period))
    if window.length == window.period:
        out = df.withColumn("__open", last)
    else:
        n = -(-window.length // window.period)
        opens = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: last - k.cast("bigint") * F.lit(window.period).cast("bigint"))
        out = df.withColumn("__open", F.explode(F.filter(opens, lambda o: o > F.col("__rt") - window.length)))
    return out.withColumn("__close", F.col("__open") + window.length)


def ranges(df: DataFrame, n: int, borders: list[int], low: int, high: int) -> Column:
    """The number of a row's range of arrival order. borders: n equal parts of the first arrival number; one that is met twice has so many
    rows that it's a range by itself, parted further by the second number (from low to high)."""
    tied = sorted({b for b, c in zip(borders, borders[1:], strict=False) if b == c})
    cuts = sorted({float(b) for b in borders} | {float(b + 1) for b in tied})
    first = F.coalesce(F.col("__first"), F.lit(0.0))
    if not tied or low is None:
        return first.cast("bigint")
    parts = max(2, n // len(tied))
    second = F.floor((F.coalesce(F.col("__seq")[1], F.lit(low)) - F.lit(low)).cast("double") / F.lit(float(high - low + 1)) * parts)
    own = [float(cuts.index(float(b)) + 1) for b in tied if abs(b) < 1 << 53]
    return F.when(F.col("__first").isin(own), first * parts + second).otherwise(first * parts).cast("bigint")


def on_time(df: DataFrame, delay: int, top: int | None = None) -> tuple[DataFrame, int | None]:
    """(rows that aren't older than the watermark that the rows before them have set, the latest row time).

    top: the latest row time before all of df. One job reads the rows' number, the borders of ranges of arrival order with
    equal numbers of rows, and the latest time. The running maximum is taken inside ranges, and each range starts
    from the maximum of those before it: a table of a few thousand rows at most. So no task sorts more than a range. A NULL arrival
    number comes first.
    """
    second = F.try_element_at("__seq", F.lit(2))
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.max("__rt").alias("top"), F.percentile_approx(F.col("__seq")[0], probs, 20_000).alias("borders"), F.min(second).alias("low"), F.max(second).alias("high")).first()
    if not seen["n"]:
        return df, top
    latest = seen["top"] if top is None else max(top, seen["top"])
    n = min(RANGES, -(-seen["n"] // RANGE_ROWS))
    if n > 1:
        borders = (seen["borders"] or [])[RANGES // n - 1 :: RANGES // n]
        tied = {b for b, c in zip(borders, borders[1:], strict=False) if b == c}
        cuts = sorted({float(b) for b in borders} | {float(b + 1) for b in tied})
        cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__number", outputCol="__first", handleInvalid="keep")
        numbered = df.withColumn("__number", F.coalesce(F.col("__seq")[0].cast("double"), F.lit(float(-(1 << 63)))))
        ranged = cut.transform(numbered)
        ranged = ranged.withColumn("__range", ranges(ranged, n, borders, seen["low"], seen["high"])).drop("__number", "__first")
        tops = ranged.groupBy("__range").agg(F.max("__rt").alias("__top"))
        before = tops.select(F.col("__range").alias("__r"), F.max("__top").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
        own = W.partitionBy("__range").orderBy("__seq").rowsBetween(W.unboundedPreceding, -1)
        # at most RANGES ranges and as many parts of tied ones: a bounded table
        ranged = ranged.withColumn("__own", F.max("__rt").over(own)).join(F.broadcast(before), F.col("__range") == F.col("__r"), "left").drop("__range", "__r")
    else:  # as few rows as one range has
        ranged = df.withColumn("__own", F.max("__rt").over(W.partitionBy(F.lit(0)).orderBy("__seq").rowsBetween(W.unboundedPreceding, -1))).withColumn("__before", F.lit(None).cast("bigint"))
    high = F.greatest("__own", "__before", F.lit(top).cast("bigint"))
    return ranged.filter(high.isNull() | (F.col("__rt") >= high - delay)).drop("__own", "__before"), latest


def closed(watermark: int | None) -> Column:
    """Panes that the watermark has closed."""
    return F.lit(False) if watermark is None else F.col("__close") <= F.lit(watermark)


def rounded_average(total: Column, n: Column) -> Column:
    """AVG closes to whole numbers, halves away from zero; NULL of no value."""
    return F.when(n > 0, F.round(total / n)).cast("float")
