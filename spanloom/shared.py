"""Tables written between steps: the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_spanloom_shared", None)
        if not at:
            at = spark._spanloom_shared = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return at.rstrip("/")


class Tables:
    """The tables of one run: what it stores is its own, and only that can it delete."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: lineage ends there and a lost executor costs no recomputation."""
        path, schema = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}", df.schema
        self.at.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._spanloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for path in [t._spanloom_path for t in tables]:
            if path in self.at:
                self.at.remove(path)
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
