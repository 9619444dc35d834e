"""Trained factors: prediction, errors, saving and loading."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.vectors import dot
from factorloom.operators.recommend import recommend
from factorloom.plans.lineage import Tables


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, rank: int, cold_start: str = "drop") -> DataFrame:
    """The rows of pairs (user, item, ..) with ``prediction``.

    users, items: (id, features). cold_start: rows without a factor are dropped ("drop") or get NaN ("nan").
    """
    if cold_start not in ("drop", "nan"):
        raise ValueError("cold_start is drop or nan")
    how = "inner" if cold_start == "drop" else "left"
    met = pairs.join(users.select(F.col("id").alias("user"), F.col("features").cast("array<double>").alias("__u")), "user", how).join(items.select(F.col("id").alias("item"), F.col("features").cast("array<double>").alias("__i")), "item", how)
    value = F.coalesce(dot(F.col("__u"), F.col("__i"), rank), F.lit(float("nan")))
    return met.withColumn("prediction", value).select(*pairs.columns, "prediction")


def errors(predicted: DataFrame) -> DataFrame:
    """One row (rmse, max_error, n) of rows (rating, prediction)."""
    off = F.col("prediction") - F.col("rating")
    return predicted.agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.max(F.abs(off)).alias("max_error"), F.count("*").alias("n"))


def weighted_rmse(predicted: DataFrame) -> DataFrame:
    """One row (weighted_rmse): errors against the preference (1 if the rating is over 0), weighted by 1 + |rating|."""
    weight = 1 + F.abs("rating")
    off = F.when(F.col("rating") > 0, 1.0).otherwise(0.0) - F.col("prediction")
    return predicted.agg(F.sqrt(F.sum(weight * off * off) / F.sum(weight)).alias("weighted_rmse"))


@dataclass
class FactorModel:
    """user_factors and item_factors (id, features array<float>), history (iter, alpha, beta, grad_norm, loss).

    tables: the written tables that the factors are read from; ``close``, or the end of a ``with`` block, deletes them and
    unpersists the factors. An unclosed model's go with the session.
    """

    rank: int
    user_factors: DataFrame
    item_factors: DataFrame
    history: DataFrame
    tables: Tables | None = None

    def close(self) -> None:
        self.user_factors.unpersist()
        self.item_factors.unpersist()
        if self.tables is not None:
            self.tables.close()

    def __enter__(self) -> "FactorModel":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def predict(self, pairs: DataFrame, cold_start: str = "drop") -> DataFrame:
        return predict(pairs, self.user_factors, self.item_factors, self.rank, cold_start)

    def errors(self, ratings: DataFrame) -> DataFrame:
        return errors(self.predict(ratings))

    def recommend_items(self, n: int, users: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
        """(user, item, rank, prediction): the n best items of each user, or of those in ``users`` (id), but for pairs in ``seen``."""
        mine = self.user_factors if users is None else self.user_factors.join(users.select("id").distinct(), "id", "left_semi")
        return recommend(mine, self.item_factors, self.rank, n, seen)

    def recommend_users(self, n: int, items: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
        """(item, user, rank, prediction): the n best users of each item, or of those in ``items`` (id), but for pairs in ``seen``."""
        mine = self.item_factors if items is None else self.item_factors.join(items.select("id").distinct(), "id", "left_semi")
        seen = None if seen is None else seen.select(F.col("item").alias("user"), F.col("user").alias("item"))
        found = recommend(mine, self.user_factors, self.rank, n, seen)
        return found.select(F.col("user").alias("item"), F.col("item").alias("user"), "rank", "prediction")

    def save(self, path: str) -> None:
        spark = self.user_factors.sparkSession
        spark.createDataFrame([(json.dumps({"rank": self.rank}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        for name in ("user_factors", "item_factors", "history"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FactorModel":
        rank = json.loads(spark.read.text(f"{path}/settings").first()[0])["rank"]
        return cls(rank, *(spark.read.parquet(f"{path}/{n}") for n in ("user_factors", "item_factors", "history")))
