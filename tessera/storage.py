"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where that is unset, which only a local run may leave open."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/{sc.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: what is read twice is the same both times, and lost executors don't bring it back to the start."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt by columns, or evenly, over tasks of about so many rows.

    A small or well-packed file is read by one task, and packed shuffles are joined by their packed size, whatever is made of each row. So tasks are
    counted by rows, and a task's work and memory stay the same as tables grow. The count reads no more columns than it needs.
    """
    if df.isStreaming:
        return df
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, *by) if tasks > 1 else df
