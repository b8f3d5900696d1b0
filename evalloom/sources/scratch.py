"""Tables written between two steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Tables written and not yet deleted.
_OPEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may go without; it then gets a temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="evalloom-tables-"))
    return _LOCAL[0]


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder but for those that begin with ``_`` or a dot; none if there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return [n for n in names if n[0] not in "_."]


def deleted(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether there was one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: what made it isn't done again, whoever reads it, and whatever executors are lost.

    ``scratch`` deletes it; what is left goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evalloom-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OPEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were ``written`` inside; write what you want to keep before."""
    before = len(_OPEN)
    try:
        yield
    finally:
        for path in _OPEN[before:]:
            deleted(spark, path)
        del _OPEN[before:]


@atexit.register
def _delete_all() -> None:
    with suppress(Exception):  # a session that has ended before
        spark = SparkSession.getActiveSession()
        for path in _OPEN if spark else []:
            deleted(spark, path)
