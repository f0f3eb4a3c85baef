"""Tables, shared folder and byte columns for the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuestream.plans.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors see (``spark.checkpoint.dir``)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table through Spark's own file system, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Just ``doc_id`` and ``text``, null text as empty; other columns can't clash any more."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batch: pa.RecordBatch, max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``max_bytes``; a longer single text is its own slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` within ``group``) and ``n``, the size of the group.

    Ranges of (group, order) are written by one task each; the first number of each task
    and group follows from a table with a row per task and group, so a group of any size
    is numbered by many tasks. Null is a group of its own.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = keep(ranged.withColumn("mark", F.monotonically_increasing_id()), name)
    task = F.shiftright("mark", 33)
    parts = kept.groupBy(F.col(group).alias("of"), task.alias("task")).agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("here"))
    upto = Window.partitionBy("of").orderBy("task")
    parts = parts.select(
        "of", "task", "first",
        (F.sum("here").over(upto) - F.col("here")).alias("before"), F.sum("here").over(Window.partitionBy("of")).alias("n"),
    )
    met = kept.join(parts, F.col(group).eqNullSafe(F.col("of")) & (task == F.col("task")))
    return met.select(*rows.columns, (F.col("mark") - F.col("first") + F.col("before")).alias("pos"), "n")


def own_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in wanted])
