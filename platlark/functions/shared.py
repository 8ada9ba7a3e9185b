"""Materialising intermediate results where every executor can read them again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
        if folder is None and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = os.path.dirname(folder) if folder else tempfile.mkdtemp(prefix="platlark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/platlark-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: later steps survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: merged by hash and order, never broadcast through the driver.

    The planner goes by the size of compressed files, of which points, ends and cells are made
    that take many times as much.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str, rows: int = 250_000, count: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` into parts of about ``rows`` rows, however many there are; ``count``: how many, if it is known.

    Grouping, windows and joins by these keys then stay in their part; a part that is merged by
    its compressed size takes thirty times as much memory to sort and group.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if count is None else count) // rows))
    return df.repartition(n, *keys)
