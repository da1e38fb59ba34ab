"""File manifests, and the drift between two of them."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, length, digest) of the files below a folder, named by their path from there; each is digested where it is read.

    Spark's reader leaves out empty files, so the driver, which lists a folder for it anyway, looks for these itself.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(conf)
    root = system.makeQualified(top).toString().rstrip("/") + "/"
    own = lambda at: jvm.org.apache.hadoop.fs.Path(at).toUri().getPath()
    empty, listed = [], system.listFiles(top, True)
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and fnmatch(f.getPath().getName(), pattern):
            empty.append((f.getPath().toUri().getPath()[len(own(root)) + 1 :],))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    # A file's path comes with its scheme, and with as many slashes behind it as the file system likes.
    below = F.expr("substring(path, locate(prefix, path) + length(prefix))")
    files = files.withColumn("prefix", F.lit(own(root).rstrip("/") + "/")).select(below.alias("name"), "length", F.sha2("content", 256).alias("digest"))
    none = spark.createDataFrame(empty, "name string").select("name", F.lit(0).cast("bigint").alias("length"), F.sha2(F.lit(b""), 256).alias("digest"))
    return files.union(none)


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, status): what was added, removed or changed, by a full outer join on the name."""
    a, b = before.select("name", F.col("digest").alias("was")), after.select("name", F.col("digest").alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "name", "full").select("name", status.alias("status")).where("status is not null")


def summary(files: DataFrame) -> DataFrame:
    """One row (files, bytes, digest) of a manifest. The digest doesn't depend on the order of the files or on how they are partitioned.

    It is the digest of 4,096 partial ones, each over the sorted lines of the names that hash to it, so no task holds all names.
    """
    line = F.concat_ws(" ", "digest", "name")
    part = files.groupBy(F.pmod(F.xxhash64("name"), F.lit(4096)).alias("part")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("digest"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])
    return part.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws("\n", lines), 256).alias("digest"))
