"""Running totals and row numbers over a whole table, by ranges of its order in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.sources.tables import store

#: Ranges of the order; one row for each is summed in one task.
BANDS = 64


def banded(rows: DataFrame, order: list[str | Column], bands: int = BANDS) -> DataFrame:
    """``rows`` with ``__b``, the range of the order that each lies in. Written once: ranges are drawn from a sample, so reading the plan twice could draw two sets."""
    return store(rows.repartitionByRange(bands, *order).withColumn("__b", F.spark_partition_id()))


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str, bands: int = BANDS) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before each, in the order of the columns, which should have no ties."""
    ranged = banded(rows.withColumn("__v", value), order, bands)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__b").agg(F.sum("__v").alias("__s")).select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(totals), "__b").withColumn(name, F.coalesce(F.sum("__v").over(own), F.lit(0)) + F.col("__s")).drop("__b", "__v", "__s")


def row_number(rows: DataFrame, order: list[str], name: str, bands: int = BANDS) -> DataFrame:
    """Adds ``name``: each row's place from 0."""
    return running_sum(rows, order, F.lit(1), name, bands)


def task_count(rows: DataFrame) -> int:
    """Partitions for work that is long for its bytes, such as pairs: adaptive execution sizes tasks by bytes and would leave most cores idle."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
