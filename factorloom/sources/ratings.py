"""Sources of ratings: rows (user long, item long, rating double), each row an observation of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.numbering import ordinals

COLUMNS = ("user", "item", "rating")


def from_dataframe(df: DataFrame, user: str = "user", item: str = "item", rating: str = "rating", on_null: str = "raise") -> DataFrame:
    """Ratings from three columns of any table.

    on_null: "raise" fails the query at the first row with a null, "drop" leaves such rows out.
    """
    rows = df.select(F.col(user).cast("long").alias("user"), F.col(item).cast("long").alias("item"), F.col(rating).cast("double").alias("rating"))
    if on_null == "drop":
        return rows.dropna()
    if on_null != "raise":
        raise ValueError("on_null is raise or drop")
    missing = F.raise_error(F.lit("a rating has a null user, item or value"))
    return rows.select(*(F.when(F.col(c).isNull(), missing.cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in COLUMNS)) if _nullable(rows) else rows


def _nullable(rows: DataFrame) -> bool:
    return any(f.nullable for f in rows.schema)


def read_text(spark: SparkSession, path: str, delimiter: str = ",", partitions: int | None = None) -> DataFrame:
    """Lines "user<delimiter>item<delimiter>rating"; the delimiter is a regular expression, more fields are ignored.

    A line that doesn't hold two whole numbers and a number fails the query.
    """
    fields = F.split("value", delimiter)
    rows = spark.read.text(path).select(*(F.trim(F.get(fields, F.lit(i))).cast(t).alias(c) for i, (c, t) in enumerate(zip(COLUMNS, ("long", "long", "double"), strict=True))))
    rows = from_dataframe(rows)
    return rows.repartition(partitions) if partitions else rows


def user_cutoff(ratings: DataFrame, last: int) -> DataFrame:
    """Ratings of users with an id up to ``last``."""
    return ratings.filter(F.col("user") <= last)


def with_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds whole-number ids (1, 2, ..) for the values of a column, in their order.

    Only the distinct values are numbered, range by range, and they are joined back; nulls get none and go.
    """
    values = ordinals(df.select(column).distinct(), column, name).withColumn(name, F.col(name) + 1)
    return df.join(values, column)


def customer_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers ordered of each part: the quantity is the rating."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    return from_dataframe(orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]), "o_custkey", "l_partkey", "l_quantity")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_dataframe(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_partkey", "l_suppkey", "l_quantity")


def user_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: the key in ``props`` is the item."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_dataframe(events.withColumn("k", F.get_json_object("props", "$.k")), "user_id", "k", "value")


def user_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose items are names, numbered."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value")
    return from_dataframe(with_ids(events, "event_type", "item"), "user_id", "item", "value")
