"""Small bounded groups in sorted Arrow batches, and chunks of an integer order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_KEY = -(1 << 63)
Arrays = dict[str, np.ndarray]


def fold_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: str,
    fold: Callable[[tuple, pa.Table], pa.RecordBatch | None],
) -> DataFrame:
    """Apply ``fold`` to the rows of each group, in order; keys are integers, null a group of its own.

    Groups are hash-partitioned and sorted by Spark and read as they come; a worker holds
    one group beside the batch it reads, so groups must have a bound.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                got = fold(tuple(None if k == NO_KEY else k for k in now), pa.Table.from_batches(held))
                if got is not None:
                    yield got
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [pc.fill_null(batch.column(k).cast(pa.int64()), NO_KEY).to_numpy() for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                key = tuple(int(c[a]) for c in columns)
                if key != now:
                    yield from done()
                    now = key
                held.append(batch.slice(a, b - a))
        yield from done()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*names).mapInArrow(run, schema)


def long_groups(rows: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of up to ``limit`` rows, and those of longer ones; null is a group of its own.

    Only the keys of longer groups are broadcast, one for each ``limit`` rows at most.
    """
    longer = rows.groupBy(F.col(key).alias("_long")).count().filter(F.col("count") > limit).select("_long", F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(longer), F.col(key).eqNullSafe(F.col("_long")), "left")
    short = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    return short, marked.filter(F.col("_hot")).select(*rows.columns)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()
