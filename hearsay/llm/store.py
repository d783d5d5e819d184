"""Where intermediate tables and checkpoints go: the folder that the cluster
names in ``spark.checkpoint.dir``.  Only a local master, as in tests, may leave it
unset; elsewhere a folder of one machine would lose data, so that is an error."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hearsay-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch between the JVM and Python, where the session has Spark's
#: default of 64 MB: both sides hold several batches at a time.
BATCH, SPARKS_BATCH = "8m", "67108864b"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING) == SPARKS_BATCH:
        spark.conf.set(BATCH_SETTING, BATCH)


#: The shuffles behind a written table go as soon as it is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and reread: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that nothing can read any more;
    otherwise they stay on disk until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    jvm, root = spark.sparkContext._jvm, shared_dir(spark)
    for p in sorted({f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(p)
        if jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
