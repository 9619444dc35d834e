"""Cutting lineage: a table is written to the shared folder and read back.

A checkpoint keeps the size estimate of the plan it replaces, and joins multiply
estimates, so a loop's estimates grow by a factor in digits each round until the driver
does nothing else. What is read from files has its files' size. Written tables outlive
lost executors.

Whoever writes a table owns it: ``drop`` deletes it by name, a ``Tables`` deletes all
that was written while it was open and hasn't been handed over, and what still lies
there when the session ends is deleted with the application's folder.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_open: ContextVar[tuple["Tables", ...]] = ContextVar("factorloom_tables", default=())
_folders: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names in ``spark.checkpoint.dir``.

    A session of one machine without one (tests, notebooks) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factorloom-"))
        folder = context.getCheckpointDir()
    return folder


def scratch(spark: SparkSession) -> str:
    """A new path for a table of this application."""
    mine = f"{shared_folder(spark)}/factorloom-{spark.sparkContext.applicationId}"
    known = (spark.sparkContext.applicationId, mine)
    if known not in _folders:
        _folders.add(known)
        path = _path(spark, mine)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)  # when the JVM ends
        atexit.register(_sweep, spark, *known)  # or the interpreter, if it ends first
    return f"{mine}/{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _sweep(spark: SparkSession, application: str, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; then the JVM has done it
        if spark.sparkContext.applicationId == application:
            delete(spark, folder)


def delete(spark: SparkSession, name: str) -> None:
    path = _path(spark, name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """The same rows, written and read back; ``spent``: tables that ``cut`` gave and that nothing needs any more."""
    path = scratch(df.sparkSession)
    # no mark of success: nobody looks for one, and the write has ended before the path is known to anyone
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _open.get():
        _open.get()[-1].owned[path] = out
    drop(*spent)
    return out


FEW = 1 << 16  # rows


def few(table: DataFrame, rows: int) -> DataFrame:
    """A table, read as one partition if it and all that is made of it have ``rows`` rows, ``FEW`` at most.

    Its groupings and merge joins need no exchange then (what a join gives needs another ``few`` before the next join), so each step of a loop is one stage that the driver plans once. Every
    exchange costs the driver a plan made anew, code, a thread and a stage's figures, which it keeps however small the table is.
    """
    if rows > FEW:
        return table
    one = table.coalesce(1)
    if "written_to" in vars(table):
        one.written_to = table.written_to
    return one


def by_merge(table: DataFrame, rows: int) -> DataFrame:
    """What ``few`` gave, for a join without a broadcast; larger tables are joined as Spark finds best."""
    return table.hint("merge") if rows <= FEW else table


def drop(*spent: DataFrame) -> None:
    """Deletes the files of tables that ``cut`` gave; what still reads them fails."""
    for df in spent:
        delete(df.sparkSession, df.written_to)
        for owner in _open.get():
            owner.owned.pop(df.written_to, None)


def forget(spark: SparkSession) -> None:
    """Shuffle files that no plan in use needs any more go now, not whenever the driver next collects garbage."""
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Owns the tables that ``cut`` writes while it is open, apart from those handed over.

    At the end of the block what isn't kept is deleted; ``close`` deletes what was kept, when its last reader is done.
    """

    def __init__(self) -> None:
        self.owned: dict[str, DataFrame] = {}
        self.kept: dict[str, DataFrame] = {}
        self.readers = 1

    def __enter__(self) -> "Tables":
        self._token = _open.set((*_open.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _open.reset(self._token)
        for path, df in self.owned.items():
            if path not in self.kept:
                delete(df.sparkSession, path)
        self.owned.clear()

    def keep(self, *tables: DataFrame) -> None:
        """These outlive the block, until ``close``."""
        self.kept |= {df.written_to: df for df in tables}

    def share(self) -> "Tables":
        """Another reader; it too calls ``close`` in the end."""
        self.readers += 1
        return self

    def close(self) -> None:
        self.readers -= 1
        if self.readers == 0:
            for path, df in self.kept.items():
                delete(df.sparkSession, path)
            self.kept.clear()
