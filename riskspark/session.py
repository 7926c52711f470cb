"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here is written against: AQE re-plans shuffles at run
# time (coalescing small partitions, splitting skewed join partitions), and
# the session time zone is pinned so results do not depend on the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files in the shared folder are removed once the data that
    # was checkpointed is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "riskspark",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build or reuse a session.  ``master`` is only set for local runs; on a
    cluster the launcher decides it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared (fault-tolerant) folder and is
    used as is.  Only when it is unset -- local tests -- a scratch folder is
    made here.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="riskspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint):
    the result survives the loss of the executors that computed it.

    The input is persisted while the checkpoint is written: writing the
    files of an unpersisted input computes it a second time.  Once written,
    the checkpoint is read from the folder and the persisted copy is
    released."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


_tables: dict[str, SparkSession] = {}


@atexit.register
def _delete_tables() -> None:
    for path, spark in list(_tables.items()):
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone; nothing can be deleted through it
            return


def write_table(df: DataFrame, name: str, *by: str, packed: bool = False) -> str:
    """``df`` written once as Parquet to the shared checkpoint folder, in
    folders of the columns ``by``; its path.  ``packed``: the columns would
    not shrink, so no codec tries.  The files go by ``delete_table`` or when
    the Python process ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    out = df.write.option("compression", "none") if packed else df.write
    (out.partitionBy(*by) if by else out).parquet(path)
    return path


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete the files of ``write_table``, or of one folder of them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _tables.pop(path, None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read
    back: computed once, with the columns and statistics of a table.  The
    files go when the Python process ends."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))
