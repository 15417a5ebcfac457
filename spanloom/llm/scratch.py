"""Where intermediate tables go: the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from spanloom.shared import shared_dir

#: Folders of the run that is open in this thread; another thread's run has its own.
_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)


def place(spark: SparkSession, name: str) -> str:
    """A new folder; it belongs to the innermost open run, if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _RUN.get() is not None:
        _RUN.get().append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = place(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._spanloom_path = path
    return out


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that place made and nothing reads any more."""
    jvm, made = spark.sparkContext._jvm, _RUN.get()
    for path in paths:
        if made is not None and path in made:
            made.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def run():
    """Collects the folders made inside; those that `release` has not deleted pass to the run around it."""
    outer, mine = _RUN.get(), []
    token = _RUN.set(mine)
    try:
        yield mine
    finally:
        _RUN.reset(token)
        if outer is not None:
            outer += mine


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete the folders of the open run, less the stored tables to keep; nothing else may still read them."""
    drop(spark, *[p for p in list(_RUN.get() or []) if p not in {k._spanloom_path for k in keep}])
