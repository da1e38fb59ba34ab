"""Windowed event counts and grace-window starts over a stream of events, with watermarks for late rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRACE = "interval 3 days"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under a path; event times become timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # A stream reads folders; a lone file is its folder's only match.
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame) -> DataFrame:
    """Events and their value by day and type; rows up to two days late still count."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", "2 days").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def _run(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """The stream's last word on every key once all that is there has been read.

    Each batch writes the groups it changed to the shared folder, so state behind the watermark is dropped and no result has to
    fit on the driver. A batch that is run again writes the same rows again, which changes nothing.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
    path = f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"
    write = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/rows")
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    last = spark.read.parquet(f"{path}/rows").groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event type, computed as a stream."""
    out = _run(spark, windows(source(spark, f"{sf_dir}/events.parquet")), ["w", "event_type"])
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


QUERIES = {"stream_event_windows": event_windows}
SQL = {"stream_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS value FROM events GROUP BY 1, 2"}
