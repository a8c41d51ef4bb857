"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where none is set and Spark runs in one process (tests) an own one.

    On a cluster a folder of one machine is none that executors share: an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Queries that are run inside delete their shuffle files at their end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write *df* once to the shared folder and read it back.

    Unlike a cached table the result survives the loss of any executor, and
    unlike recomputation each stage below it runs once.  Its shuffle files are
    deleted as soon as it is written, not when the driver next collects garbage.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with freeing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more, as the earlier rounds of a loop."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most *rows* rows: the check before any broadcast."""
    return df.limit(rows + 1).count() <= rows
