"""Folders of files as tables: what is there, what is to be archived, what has gone."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, prefix: str, exclude: str = "") -> DataFrame:
    """key, path, modified, length of every file below a folder, by listing alone: contents aren't read. key: prefix / path below the folder. A file or folder whose name begins with
    `exclude` is left out with all below it. An empty folder gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    below = F.expr("substr(path, {})".format(len(root) + 2))
    df = files.select(F.concat(F.lit(prefix + "/"), below).alias("key"), "path", "modified", "length", F.split(below, "/").alias("_names"))
    if exclude:
        df = df.where(~F.exists("_names", lambda x: x.startswith(exclude)))
    return df.drop("_names")


def to_archive(files: DataFrame, known: DataFrame, min_age: str = "0 seconds", now: Column | None = None) -> DataFrame:
    """Of `listing`, the files at least `min_age` old whose key isn't in `known` (key). Files dated after `now` count as old."""
    at = F.current_timestamp() if now is None else now
    return files.where((F.col("modified") <= at - F.expr(f"INTERVAL {min_age}")) | (F.col("modified") > at)).join(known.select("key").distinct(), "key", "left_anti")


def still_known(known: DataFrame, files: DataFrame) -> DataFrame:
    """Of `known`, the keys whose file is there still."""
    return known.join(files.select("key"), "key", "left_semi")


def changed_folders(files: DataFrame, seen: DataFrame) -> DataFrame:
    """folder, modified (its newest file's time) of folders never seen, or with a file newer than was `seen` (folder, modified)."""
    now = files.groupBy(F.regexp_replace("key", "/[^/]*$", "").alias("folder")).agg(F.max("modified").alias("modified"))
    before = seen.select("folder", F.col("modified").alias("_before"))
    return now.join(before, "folder", "left").where(F.col("_before").isNull() | (F.col("modified") > F.col("_before"))).drop("_before")
