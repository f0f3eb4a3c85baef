"""As-of, nearest and interval joins without range predicates or nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestream.plans.scan import OrderedScan, first_after, last_upto

def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    left_tie: str,
    right_tie: str,
    backward: str | None = "before",
    forward: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Attach the right row at or before (``backward``) and after (``forward``) each left row.

    Both sides are stacked into one ordered scan, so the cost is one sort of
    their union and a hot key is split like in any other scan. Among right rows
    of equal time the backward match takes the one with the largest tie value.
    """
    lcols, rcols = left.columns, right.columns
    lrow = F.struct(*[F.col(c) for c in lcols])
    rrow = F.struct(*[F.col(c) for c in rcols])
    lside = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(1).alias("_side"),
        F.col(left_tie).alias("_ltie"),
        F.lit(None).cast(right.schema[right_tie].dataType).alias("_rtie"),
        lrow.alias("_l"),
        F.lit(None).cast(right.select(rrow.alias("r")).schema["r"].dataType).alias("_r"),
    )
    rside = right.select(
        *keys,
        F.col(right_time).alias("_t"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(left.schema[left_tie].dataType).alias("_ltie"),
        F.col(right_tie).alias("_rtie"),
        F.lit(None).cast(left.select(lrow.alias("l")).schema["l"].dataType).alias("_l"),
        rrow.alias("_r"),
    )
    steps = {}
    if backward:
        steps[backward] = last_upto("_r")
    if forward:
        steps[forward] = first_after("_r")
    scan = OrderedScan.over(lside.unionByName(rside), keys, ["_t", "_side", "_ltie", "_rtie"], hot=hot).add(**steps)
    return scan.done().filter(F.col("_side") == 1).select("_l.*", *steps)


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    left_tie: str,
    right_tie: str,
    hot: bool | None = None,
) -> DataFrame:
    """Nearest right row as struct ``nearest`` (null when the key has none); the earlier wins ties."""
    both = asof_join(
        left, right, keys, left_time, right_time, left_tie, right_tie, "_before", "_after", hot=hot
    )
    t = F.col(left_time)
    back, ahead = t - F.col(f"_before.{right_time}"), F.col(f"_after.{right_time}") - t
    pick = (
        F.when(F.col("_before").isNull(), F.col("_after"))
        .when(F.col("_after").isNull(), F.col("_before"))
        .when(back <= ahead, F.col("_before"))
        .otherwise(F.col("_after"))
    )
    return both.withColumn("nearest", pick).drop("_before", "_after")


def interval_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    point: str,
    start: Column,
    end: Column,
    width: int,
    how: str = "inner",
) -> DataFrame:
    """Pairs with ``start <= point <= end``, both ends included.

    The equi key is (keys, time bucket). Spans are repeated once per bucket they
    touch, points are not repeated, so each pair appears once. Adaptive skew
    handling splits a hot bucket because this is a plain equi join.
    """
    lo, hi = F.floor(start / width), F.floor(end / width)
    buckets = spans.withColumns({"_start": start, "_end": end}).withColumn(
        "_bucket", F.explode(F.sequence(lo, F.greatest(lo, hi)))
    )
    buckets = buckets.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[c for c in buckets.columns if c not in keys],
    )
    on = [F.col(k) == F.col(f"_s_{k}") for k in keys]
    on += [
        F.col("_pbucket") == F.col("_bucket"),
        F.col(point) >= F.col("_start"),
        F.col(point) <= F.col("_end"),
    ]
    joined = points.withColumn("_pbucket", F.floor(F.col(point) / width)).join(buckets, on, how)
    return joined.drop("_pbucket", "_bucket", "_start", "_end", *[f"_s_{k}" for k in keys])


def nearest_on_grid(
    time: Column, first: Column, interval: Column, n_beats: Column, tolerance_us: int
) -> Column:
    """Nearest beat of a regular grid by arithmetic: rounded index, then one before, then one after."""
    at = F.floor((time - first) / interval + F.lit(0.5)).cast("long")

    def beat(offset: int) -> Column:
        i = at + offset
        value = first + i * interval
        return F.when((i >= 0) & (i < n_beats) & (F.abs(value - time) <= tolerance_us), value)

    return F.coalesce(beat(0), beat(-1), beat(1))
