"""Numbers in the order of a column, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.plans.lineage import cut


def ordinals(df: DataFrame, column: str, name: str) -> DataFrame:
    """Numbers the rows from 0 in order of a column, nulls last.

    Ranges of the column are numbered by themselves; only the ranges' counts, a row each, meet in one task.
    """
    order = F.col(column).asc_nulls_last()
    parts = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    begins = parts.groupBy("__part").count().select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__begin"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parts.join(begins, "__part").withColumn(name, (inside + F.col("__begin")).cast("long")).drop("__part", "__begin")
