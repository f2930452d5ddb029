"""The folder that driver and executors share, and reliable checkpoints and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a temporary one on a local master, which is one machine, and an error on a cluster, where folders
    differ by machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, which ends the lineage; Spark's cleaner removes its files once the frame is garbage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which ends the lineage and the estimate of its size.

    A checkpoint keeps the size that Spark has estimated, and a join's estimate is the product of its sides'. So in a loop that
    joins a frame with itself each round makes that number twice or three times as long, until the driver's memory is full
    of it; the size of a table is that of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/lectern-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
