"""Session helpers shared by the entry points, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A number that no other row of a held table has.
ROW_ID = "__row_id"


def local_session(cpus: str | int = 8, app: str = "cohortloom", partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the session comes from spark-submit instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COHORTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Folders of local sessions that name none, by application; they go when the process ends.
_OWN: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where none is named (a local test) does this make one itself, one for the session, removed when the process ends.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is not None:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = spark.sparkContext.applicationId
    if own not in _OWN:
        _OWN[own] = tempfile.TemporaryDirectory(prefix="cohortloom-", ignore_cleanup_errors=True)
    return _OWN[own].name


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there, rows in the same order."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def materialised(df: DataFrame, name: str = "table", watch=None) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it from there.

    Later passes read only the columns they need, and a lost executor costs no recomputation of
    what came before. The row order is not kept. Checks of a ``watch`` that ride on the frame are settled after the
    write, so that a table that breaks one is never handed on.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df if watch is None else watch.written(df)).write.parquet(path)
    if watch is not None:
        watch.settle()
    return df.sparkSession.read.parquet(path)


def held(df: DataFrame, name: str = "held", watch=None) -> DataFrame:
    """``df`` written once with a row number (``ROW_ID``) that is unique and stays, since it is in the file.

    What is held already is returned as it is.
    """
    if ROW_ID in df.columns:
        return df
    return materialised(df.withColumn(ROW_ID, F.monotonically_increasing_id()), name, watch)
