"""Shared scratch storage: intermediate tables live where every executor can read them."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where none is named a private one is set for a local session (tests); on a cluster that would be one machine's,
    so it raises. What is written there is left for the folder's owner to clear, as results are lazy.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir names no shared folder")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            current = spark.sparkContext.getCheckpointDir()
        return current
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_setting = threading.Lock()
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str = "table", arrow_rows: int | None = None, held: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and sizes are known.

    arrow_rows: rows of a batch that goes to Python and back at most, where rows are large. held: bytes that a task holds
    before it writes them as a row group, which a reader then holds; else Parquet's own size, and looked at each 100 rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write = df.write if held is None else df.write.options(**{"parquet.block.size": held, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 100, "parquet.enable.dictionary": False})
    if arrow_rows is None:
        write.parquet(path)
    else:
        with _setting:  # the option is the session's, so one write at a time changes it
            before = spark.conf.get(ARROW_ROWS)
            try:
                spark.conf.set(ARROW_ROWS, arrow_rows)
                write.parquet(path)
            finally:
                spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt out over all cores by columns: what a few splits hold may be work for many tasks."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by)


def small_or_merge(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a written table for broadcast if it has at most max_rows rows, else for a sort-merge join.

    The caller passes a table with narrow rows, so that max_rows bounds its bytes.
    """
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df.hint("merge")
