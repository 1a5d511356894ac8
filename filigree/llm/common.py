"""What the corpus operators share: tables in the shared folder, text as bytes, range prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from filigree.session import materialise, new_path, remove, shared_dir

__all__ = ["WORD", "bounded_batches", "materialise", "new_path", "rank_within", "remove", "rows_of", "shared_dir", "through", "utf8"]

#: The word of every contract here: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(column: str) -> Column:
    """The text as bytes, null as empty, without a copy through Python strings."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of about ``size`` bytes, and scans of 512 rows at a time, whatever the length of texts.

    A scan holds the texts of all its rows at a time in one array of the JVM. Both are settings of the session, and stay: the
    scan of a DataFrame is planned when it is run, after this returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def through(df: DataFrame, schema: StructType | str, *steps: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows through ``steps`` one after another, in one Python worker a task."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return df.mapInArrow(run, schema)


def rows_of(batches: Iterator[pa.RecordBatch], piece: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, piece):
            yield batch.slice(at, piece)


def rank_within(df: DataFrame, group: str, order: list[str], rank: str, label: str) -> DataFrame:
    """Rows numbered from 0 within ``group`` by ``order``, without bringing a group into one task.

    Rows are dealt by ranges of (group, order), numbered within their partition, and moved by the
    counts of the partitions before, of which there is one row for each (partition, group).
    Adds ``rank`` (long). Rows that tie in every column of ``order`` get neighbouring ranks.
    """
    from pyspark.sql import Window

    schema = df.schema
    names = schema.fieldNames()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    at = names.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, k = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            local = []
            for g in batch.column(at).to_pylist():
                k = k + 1 if g == last else 0
                last = g
                local.append(k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([pid] * batch.num_rows, pa.int32()), pa.array(local, pa.int64())],
                names=[*names, "_part", "_local"],
            )

    numbered = StructType([*schema.fields, StructField("_part", IntegerType()), StructField("_local", LongType())])
    local = materialise(through(dealt, numbered, number), label)
    counts = local.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        F.col(group).alias("_group"), F.col("_part").alias("_p"), "_before"
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p"))
    return local.join(counts, same).select(*names, (F.col("_local") + F.col("_before")).cast("long").alias(rank))
