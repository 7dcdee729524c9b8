"""Cutting lineage: intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession

import rillstone

# Functions of this package that run in Python workers travel with the job, so that the executors need no copy of it.
cloudpickle.register_pickle_by_value(rillstone)

FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only in local mode, where the setting may be missing."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="rillstone-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes at the end of `scratch`, or with the process."""
    path = f"{shared_dir(spark)}/rillstone-{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Writes inside give up their shuffle files when they end; else these stay until the driver collects its garbage."""
    before = spark.conf.get(FREES)
    spark.conf.set(FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and returns the table read back.

    Later stages that need it more than once read files instead of recomputing, and a lost executor costs no more than
    the tasks it held. An empty frame gives an empty table with the same columns.
    """
    path = new_path(df.sparkSession, label)
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that were cut inside when the block ends: results must be written or collected by then."""
    at = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > at:
            _remove(*_MADE.pop())


def _remove_all() -> None:
    while _MADE:
        _remove(*_MADE.pop())


atexit.register(_remove_all)


def _remove(spark: SparkSession, path: str) -> None:
    if path.startswith(("file:", "/")):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # the session may have ended: the folder's owner clears it
        print(f"not removed: {path} ({type(e).__name__})", file=sys.stderr)
