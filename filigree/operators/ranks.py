"""Running sums and totals over whole tables, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import materialise


def running(df: DataFrame, order: list[str | Column], value: Column, out: str, label: str = "ranks") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (a long) over all rows before, in ``order``, which should tell rows apart.

    Rows are dealt by ranges of ``order``, summed within their range, and moved by the sums of the ranges before, of
    which there is one row a partition. Equal rows in ``order`` come in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.withColumn("_value", value.cast("long")).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), label)
    sums = dealt.groupBy(F.col("_part").alias("_p")).agg(F.sum("_value").alias("_sum"))
    sums = sums.select("_p", F.coalesce(F.sum("_sum").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    # One row a shuffle partition.
    moved = local.join(F.broadcast(sums), F.col("_part") == F.col("_p"))
    return moved.select(*df.columns, (F.col("_local") + F.col("_before")).alias(out))


def numbered(df: DataFrame, order: list[str | Column], out: str, label: str = "ranks") -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``."""
    return running(df, order, F.lit(1), out, label)


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with aggregates of all its rows as columns: one row, summed where the rows are, joined to each."""
    return df.join(F.broadcast(df.agg(*[c.alias(k) for k, c in totals.items()])))
