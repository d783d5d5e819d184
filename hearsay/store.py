"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpoint_dir(df: DataFrame) -> None:
    """The folder is the session's ``spark.checkpoint.dir``; only a local master may leave it unset."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = root or tempfile.mkdtemp(prefix="hearsay-")
        spark.sparkContext.setCheckpointDir(root)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts lineage and survives lost executors."""
    checkpoint_dir(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet beside the checkpoints and read again: the rows are made once, the
    last step is not run a second time as for a checkpoint, and only columns asked for are read."""
    checkpoint_dir(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
