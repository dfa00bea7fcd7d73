"""Materialised steps: a frame written once to the shared folder and read back.

A written table cuts the lineage of loops, survives the loss of any executor, is column-pruned by later reads and
carries its size, so that Spark's own broadcast threshold sees real numbers. Loops drop their steps as they go; what a
lazy result still reads lies in the application's own folder, which goes when the application ends.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from axiomill.session import shared_dir


_FOLDERS: set[str] = set()
_LISTENERS: list[Callable[[str, dict], None]] = []


def on_progress(listener: Callable[[str, dict], None]) -> Callable[[], None]:
    """Have ``listener`` told the tag and the figures of every written step; returns what ends that."""
    _LISTENERS.append(listener)
    return lambda: _LISTENERS.remove(listener)



def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_end(spark: SparkSession, name: str) -> None:
    try:
        _delete(spark, name)
    except Exception:  # the session may be stopped: a local folder goes without it, another is left to whoever cleans there
        if name.startswith("file:"):
            shutil.rmtree(name[5:].replace("///", "/", 1).replace("//", "/", 1), ignore_errors=True)


def folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; deleted when Python ends."""
    name = f"{shared_dir(spark)}/axiomill/{spark.sparkContext.applicationId}"
    if name not in _FOLDERS:
        _FOLDERS.add(name)
        atexit.register(_at_end, spark, name)
    return name


class Cut:
    """A written frame: ``df`` reads it, ``seen`` holds figures gathered while it was written."""

    def __init__(self, df: DataFrame, tag: str, **figures: Column):
        self.spark = df.sparkSession
        self.path = f"{folder(self.spark)}/{tag}-{uuid.uuid4().hex}"
        schema = df.schema
        if figures:
            watch = Observation(f"{tag}-{uuid.uuid4().hex}")
            df = df.observe(watch, *[c.alias(k) for k, c in figures.items()])
        df.write.parquet(self.path)
        self.seen = watch.get if figures else {}
        for tell in list(_LISTENERS):
            tell(tag, dict(self.seen))
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; for steps that nothing lazy reads any more."""
        _delete(self.spark, self.path)


def cut(df: DataFrame, tag: str, **figures: Column) -> Cut:
    return Cut(df, tag, **figures)
