"""Predictions for a stream of pairs: a stream-static join with trained factors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factorloom.plans.model import FactorModel


def score(stream: DataFrame, model: FactorModel) -> DataFrame:
    """Rows (user, item, ..) of a stream with their prediction; pairs without factors are dropped."""
    return model.predict(stream)
