"""Tables written between stages, in the folder that all executors share.

A written table cuts lineage and survives lost executors.  The folder is the session's
spark.checkpoint.dir; only a local session may leave it unset and gets one below its
warehouse.

A run's tables lie in one folder, `siftwell-<number>`.  What a result still reads must stay
until it was used; `sweep` removes the folders of runs that began before a given age.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return named.rstrip("/")


class Stages:
    """Written tables of one run; `drop` removes one that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/siftwell-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._stage_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, hours: float) -> int:
    """Removes the stage folders that nothing was written to for `hours`; how many they were."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("siftwell-") and f.getModificationTime() < time.time() * 1000 - hours * 3_600_000]
    for path in old:
        fs.delete(path, True)
    return len(old)
