"""What the operators of this subpackage share: table access and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme; a local one only for a local session that names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub(r"^file:/+", "file:///", whole)


def _small_batches(spark: SparkSession) -> None:
    """Texts come to Python a few megabytes at a time, not Arrow's default of ten thousand rows, unless the user chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended, and its folders go with it
        pass


#: Spark's setting that deletes the shuffle files of a job once it is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, so that what follows survives the loss of executors.

    A table is deleted once no frame that reads it is left, here or in the JVM; that is looked up whenever another is written.
    """

    #: Of each table that was written: a weak reference to what its readers hold, the session, and the paths.
    _written: list[tuple] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _small_batches(spark)
        self._sweep()

    def write(self, df: DataFrame, codec: str = "zstd", with_folder: str | None = None, by: str | None = None) -> DataFrame:
        """Write df and read it again: a cut of the lineage. Files of with_folder, which its rows name, go when it goes.

        With a column ``by``, the rows of each of its values are in a folder of their own. Once the table is there, nothing needs the
        shuffles that led to it: their files go at once, not when the driver happens to collect its garbage.
        """
        self._n += 1
        at = f"{self.path}/{self._n}"
        writer = df.write.option("compression", codec)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(at)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(at)
        back._scratch_path = at
        files = back._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
        Scratch._written.append((self.spark.sparkContext._jvm.java.lang.ref.WeakReference(files), self.spark, [at, *filter(None, [with_folder])]))
        self._sweep()
        return back

    def size(self, df: DataFrame) -> int:
        """Bytes of df, columns of a table that was written, as Spark estimates them from the size of its files."""
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def drop(self, df: DataFrame) -> None:
        """Delete a table that :meth:`write` returned and nothing will read again."""
        _delete(self.spark, df._scratch_path)

    def _sweep(self) -> None:
        left = []
        for ref, spark, paths in Scratch._written:
            try:
                if ref.get() is None:
                    for at in paths:
                        _delete(spark, at)
                    continue
            except Exception:  # of a session that has ended
                continue
            left.append((ref, spark, paths))
        Scratch._written[:] = left
