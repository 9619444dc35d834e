"""A training's progress in a folder: both sides' states, the loop's scalars and the history, to go on from.

``<folder>/<iteration>/user`` and ``item`` are tables, ``manifest`` is written after
them; an iteration without a finished manifest doesn't count. The two latest are kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from factorloom.plans.lineage import delete

SIDES = ("user", "item")


@dataclass
class Progress:
    iteration: int
    scalars: dict
    states: dict[str, DataFrame]
    history: list[tuple]


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Iterations whose manifest is whole, in order."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/manifest/_SUCCESS")
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getParent().getName()) for f in found)


def save(spark: SparkSession, folder: str, at: Progress, same: dict) -> None:
    """same: settings that a training must agree in to go on from here."""
    here = f"{folder}/{at.iteration:08}"
    delete(spark, here)  # of a run that was broken off while it wrote
    for key in SIDES:
        at.states[key].write.parquet(f"{here}/{key}")
    text = json.dumps({"same": same, "iteration": at.iteration, "scalars": at.scalars, "history": at.history})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").text(f"{here}/manifest")
    for old in _finished(spark, folder)[:-2]:
        delete(spark, f"{folder}/{old:08}")


def latest(spark: SparkSession, folder: str, same: dict, most: int) -> Progress | None:
    """The latest progress of up to ``most`` iterations; one of other settings is an error."""
    done = [i for i in _finished(spark, folder) if i <= most]
    if not done:
        return None
    here = f"{folder}/{done[-1]:08}"
    told = json.loads(spark.read.text(f"{here}/manifest").first()[0])
    if told["same"] != same:
        differ = sorted(key for key in same if told["same"].get(key) != same[key])
        raise ValueError(f"the progress in {folder} is of another training: {', '.join(differ)}")
    return Progress(told["iteration"], told["scalars"], {key: spark.read.parquet(f"{here}/{key}") for key in SIDES}, [tuple(row) for row in told["history"]])
