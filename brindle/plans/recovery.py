"""Places that every executor and the driver can reach, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a plan go when the plan has run. Right for plans that run once, such as those of checkpoints.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else the one given to ``setCheckpointDir``.

    Where neither is set, a session within one process gets a folder of our own; on a cluster that is an error, as a
    machine's own folder is out of reach of the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/").rpartition("/")[0]
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return f"file://{tempfile.gettempdir()}/brindle-checkpoints"


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    names = {"cleanup": _CLEANUP, "adaptive": "spark.sql.adaptive.enabled"}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def checkpoint(df: DataFrame, layout: bool = False) -> DataFrame:
    """Reliable checkpoint of ``df`` (never a local one): later stages read it from the shared folder.

    The shuffle files that made it go at once. ``layout``: the partitioning of ``df`` stays known, so that a later join or
    grouping by the same columns shuffles only its other side.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with _set(spark, cleanup="true", **({"adaptive": "false"} if layout else {})):
        return df.select("*").checkpoint(eager=True)


def drop(*checkpoints: DataFrame) -> None:
    """Deletes the files of ``checkpoints`` that no later plan reads."""
    for df in checkpoints:
        place = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if place.isDefined():
            delete(df.sparkSession, place.get())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_path(spark: SparkSession, prefix: str) -> str:
    """A new path below the shared folder, for a table that a query writes and reads again."""
    return f"{shared_dir(spark)}/brindle/{prefix}-{uuid.uuid4().hex}"
