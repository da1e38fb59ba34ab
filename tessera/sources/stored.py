"""Cuts of a lineage that survive the loss of executors, and shares of tasks that do not grow with a table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the folder that the cluster names in spark.checkpoint.dir; of its own only in local sessions."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tessera-cut-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()


#: Rows of a task's share, beyond what it takes to keep all cores busy with a sixteenth of that.
SHARE = 1 << 18


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, of about so many rows, dealt by the columns to as many tasks as give each at most SHARE rows, were they dealt evenly.

    Left to itself, adaptive execution joins shares up to so many bytes, and few and narrow columns are millions of rows then.
    """
    busy = min(df.sparkSession.sparkContext.defaultParallelism, rows // (SHARE // 16) + 1)
    return df.repartition(max(busy, rows // SHARE + 1), *by)
