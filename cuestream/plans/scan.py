"""Ordered per-key scans that stay parallel when one key holds most of the rows.

A window partitioned by key puts each key into one task. That is the plan used
while every group is below ``max_group_rows``; the size is checked with one
key-only aggregate. When a group is larger, rows are range-partitioned by
(key, order) instead, each partition becomes a chunk, the same window runs per
(key, chunk), and a small carry table brings in what earlier or later chunks
contribute. Only keys that straddle a chunk border have carries, at most two
per chunk, so the broadcast is bounded by the number of chunks whatever the
number of rows or keys.

Every step here is a prefix or suffix aggregate with an associative merge
(sum, max, last / first non-null, neighbour row), which is what makes both
plans give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuestream.plans.session import cut_lineage

MAX_GROUP_ROWS = 2_000_000
CHUNK = "_chunk"


@dataclass(frozen=True)
class Step:
    kind: str
    expr: Column | None = None


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def max_before(e):
    return Step("max_before", _col(e))


def max_upto(e):
    return Step("max_upto", _col(e))


def sum_before(e):
    return Step("sum_before", _col(e))


def sum_upto(e):
    return Step("sum_upto", _col(e))


def last_before(e):
    return Step("last_before", _col(e))


def last_upto(e):
    return Step("last_upto", _col(e))


def first_after(e):
    return Step("first_after", _col(e))


def prev_row(e):
    return Step("prev", _col(e))


def next_row(e):
    return Step("next", _col(e))


def position():
    return Step("position")


def group_sum(e):
    return Step("group_sum", _col(e))


def group_max(e):
    return Step("group_max", _col(e))


def group_min(e):
    return Step("group_min", _col(e))


def group_count():
    return Step("group_count")


def group_limit(df: DataFrame) -> int:
    """Largest group one task may order; ``spark.cuestream.maxGroupRows`` overrides the default."""
    return int(df.sparkSession.conf.get("spark.cuestream.maxGroupRows", str(MAX_GROUP_ROWS)))


def has_hot_group(df: DataFrame, keys: Sequence[str], max_group_rows: int | None = None) -> bool:
    """True when some key holds more rows than one task should order."""
    max_group_rows = group_limit(df) if max_group_rows is None else max_group_rows
    sizes = df.groupBy(*keys).count().filter(F.col("count") > max_group_rows)
    return bool(sizes.take(1))


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add a chunk id: contiguous runs of (key, order), sized by the range partitioner.

    The order columns must end in a unique tie-breaker, so that a single hot key,
    or even a single hot timestamp, still splits. The checkpoint pins the ids.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


class OrderedScan:
    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunked: bool):
        self.df, self.keys, self.order, self.chunked = df, list(keys), list(order), chunked

    @classmethod
    def over(
        cls,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot: bool | None = None,
        max_group_rows: int | None = None,
    ) -> OrderedScan:
        """``hot=None`` checks group sizes; pass the flag when already known.

        ``hot=False`` is for groups with a natural bound, such as the lines of
        one document, which all came out of a single cell.
        """
        if hot is None:
            hot = has_hot_group(df, keys, max_group_rows)
        if hot:
            df = range_chunks(df, keys, order)
        return cls(df, keys, order, hot)

    def let(self, **cols: Column) -> OrderedScan:
        """Row-wise columns that keep the order and the keys as they are."""
        return OrderedScan(self.df.withColumns(cols), self.keys, self.order, self.chunked)

    def add(self, **steps: Step) -> OrderedScan:
        build = self._add_chunked if self.chunked else self._add_plain
        return OrderedScan(build(steps), self.keys, self.order, self.chunked)

    def done(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.chunked else self.df

    def _windows(self, keys: list[str]):
        part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        asc = part.orderBy(*[F.col(c).asc() for c in self.order])
        desc = part.orderBy(*[F.col(c).desc() for c in self.order])
        return part, asc, desc

    def _local(self, step: Step, keys: list[str]) -> Column:
        part, asc, desc = self._windows(keys)
        before = (W.unboundedPreceding, -1)
        upto = (W.unboundedPreceding, W.currentRow)
        e = step.expr
        if step.kind == "max_before":
            return F.max(e).over(asc.rowsBetween(*before))
        if step.kind == "max_upto":
            return F.max(e).over(asc.rowsBetween(*upto))
        if step.kind == "sum_before":
            return F.coalesce(F.sum(e).over(asc.rowsBetween(*before)), F.lit(0))
        if step.kind == "sum_upto":
            return F.coalesce(F.sum(e).over(asc.rowsBetween(*upto)), F.lit(0))
        if step.kind == "last_before":
            return F.last(e, ignorenulls=True).over(asc.rowsBetween(*before))
        if step.kind == "last_upto":
            return F.last(e, ignorenulls=True).over(asc.rowsBetween(*upto))
        if step.kind == "first_after":
            # reversed order: a growing frame is linear, a shrinking one is not
            return F.last(e, ignorenulls=True).over(desc.rowsBetween(*before))
        if step.kind == "prev":
            return F.lag(F.struct(e.alias("v"))).over(asc)
        if step.kind == "next":
            return F.lead(F.struct(e.alias("v"))).over(asc)
        if step.kind == "position":
            return F.row_number().over(asc).cast("long")
        if step.kind == "group_sum":
            return F.sum(e).over(part)
        if step.kind == "group_max":
            return F.max(e).over(part)
        if step.kind == "group_min":
            return F.min(e).over(part)
        if step.kind == "group_count":
            return F.count(F.lit(1)).over(part)
        raise ValueError(step.kind)

    def _add_plain(self, steps: dict[str, Step]) -> DataFrame:
        cols = {}
        for name, step in steps.items():
            value = self._local(step, self.keys)
            cols[name] = value["v"] if step.kind in ("prev", "next") else value
        return self.df.withColumns(cols)

    def _summary(self, step: Step) -> Column:
        at = F.struct(*[F.col(c) for c in self.order])
        e = step.expr
        if step.kind in ("max_before", "max_upto", "group_max"):
            return F.max(e)
        if step.kind == "group_min":
            return F.min(e)
        if step.kind in ("sum_before", "sum_upto", "group_sum"):
            return F.sum(e)
        if step.kind in ("last_before", "last_upto"):
            return F.max_by(e, F.when(e.isNotNull(), at))
        if step.kind == "first_after":
            return F.min_by(e, F.when(e.isNotNull(), at))
        if step.kind == "prev":
            return F.max_by(F.struct(e.alias("v")), at)
        if step.kind == "next":
            return F.min_by(F.struct(e.alias("v")), at)
        return F.count(F.lit(1))

    def _carry(self, name: str, step: Step) -> Column:
        part = W.partitionBy(*self.keys) if self.keys else W.partitionBy(F.lit(0))
        asc, desc = part.orderBy(F.col(CHUNK)), part.orderBy(F.col(CHUNK).desc())
        before = (W.unboundedPreceding, -1)
        s = F.col(name)
        if step.kind in ("max_before", "max_upto"):
            return F.max(s).over(asc.rowsBetween(*before))
        if step.kind in ("sum_before", "sum_upto", "position"):
            return F.sum(s).over(asc.rowsBetween(*before))
        if step.kind in ("last_before", "last_upto"):
            return F.last(s, ignorenulls=True).over(asc.rowsBetween(*before))
        if step.kind == "first_after":
            return F.last(s, ignorenulls=True).over(desc.rowsBetween(*before))
        if step.kind == "prev":
            return F.lag(s).over(asc)
        if step.kind == "next":
            return F.lead(s).over(asc)
        if step.kind == "group_max":
            return F.max(s).over(part)
        if step.kind == "group_min":
            return F.min(s).over(part)
        return F.sum(s).over(part)

    @staticmethod
    def _merge(step: Step, local: Column, carry: Column) -> Column:
        if step.kind in ("max_before", "max_upto"):
            return F.greatest(local, carry)
        if step.kind in ("sum_before", "sum_upto", "position"):
            return local + F.coalesce(carry, F.lit(0))
        if step.kind in ("prev", "next"):
            return F.coalesce(local, carry)["v"]
        if step.kind.startswith("group_"):
            return F.coalesce(carry, local)
        return F.coalesce(local, carry)

    def _add_chunked(self, steps: dict[str, Step]) -> DataFrame:
        keys = [*self.keys, CHUNK]
        part = W.partitionBy(*self.keys) if self.keys else W.partitionBy(F.lit(0))
        summary = self.df.groupBy(*keys).agg(*[self._summary(s).alias(n) for n, s in steps.items()])
        carries = (
            summary.withColumn("_scan_n", F.count(F.lit(1)).over(part))
            .select(
                *[F.col(k).alias(f"_scan_k_{k}") for k in keys],
                "_scan_n",
                *[self._carry(n, s).alias(f"_scan_c_{n}") for n, s in steps.items()],
            )
            .filter(F.col("_scan_n") > 1)
        )
        local = self.df.withColumns({f"_scan_l_{n}": self._local(s, keys) for n, s in steps.items()})
        on = [F.col(k).eqNullSafe(F.col(f"_scan_k_{k}")) for k in keys]
        # at most two rows per chunk: see the module text
        joined = local.join(F.broadcast(carries), on, "left")
        out = joined.withColumns(
            {n: self._merge(s, F.col(f"_scan_l_{n}"), F.col(f"_scan_c_{n}")) for n, s in steps.items()}
        )
        return out.drop(
            "_scan_n", *[f"_scan_k_{k}" for k in keys], *[f"_scan_l_{n}" for n in steps], *[f"_scan_c_{n}" for n in steps]
        )


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    radius: int,
    *stages: dict[str, Callable[[object], Column]],
    chunk_rows: int = 65_536,
) -> DataFrame:
    """Window columns with a bounded reach, for dense integer indexes.

    Each chunk of the index is one window partition. Rows near a border are
    copied into the neighbouring chunk as a halo and dropped afterwards, so one
    long signal spreads over many tasks. Each stage maps names to functions of
    the ordered window and may use the columns of earlier stages; ``radius`` is
    the reach of all stages together. All stages share one shuffle.
    """
    if chunk_rows <= 2 * radius:
        raise ValueError("chunk_rows must exceed twice the radius")
    i = F.col(index)
    home = F.floor(i / chunk_rows)
    offset = F.pmod(i, F.lit(chunk_rows))
    halo = F.array_compact(
        F.array(
            home,
            F.when(offset < radius, home - 1),
            F.when(offset >= chunk_rows - radius, home + 1),
        )
    )
    out = df.withColumn("_home", home).withColumn(CHUNK, F.explode(halo))
    w = W.partitionBy(*keys, CHUNK).orderBy(index)
    for stage in stages:
        out = out.withColumns({name: make(w) for name, make in stage.items()})
    return out.filter(F.col(CHUNK) == F.col("_home")).drop(CHUNK, "_home")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key. Spark applies the limit before the shuffle too, so a hot key stays small."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
