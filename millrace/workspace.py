"""Steps of a job cut by writing Parquet below the shared folder.

The folder is the one in ``spark.checkpoint.dir``, so a lost executor costs a re-read and
never the whole lineage.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a full URI. Only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "millrace-shared")
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString()


class Workspace:
    """A fresh folder in the shared root; removed when the driver exits, or by ``drop`` before."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/millrace/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as a scan of what was written."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def mkdirs(self, name: str) -> str:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        return f"{self.path}/{name}"

    def drop(self, name: str = "") -> None:
        """Remove a step that nothing reads any more, or the whole folder."""
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone at exit; the folder is then left to the cluster's clean-up
            if name:
                raise
