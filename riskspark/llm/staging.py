"""Tables written to the shared folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage, is computed once, and survives the loss
of the executors that wrote it.  Tables that a step no longer needs are
dropped by ``release``; those behind a returned DataFrame stay until the
Python process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from riskspark.session import ensure_checkpoint_dir

_live: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_live.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; nothing can be deleted through it
            return


class Stage:
    """One run's tables.  ``write`` stores a DataFrame and returns it as read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _live[self.path] = spark

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
