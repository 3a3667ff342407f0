"""Files of a folder, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, framework: str, path: str, pattern: str = "*.md") -> DataFrame:
    """Raw documents of all files whose name fits ``pattern``, in any folder below; files that are not UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    name = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    rel = F.when(F.startswith(name, F.lit(base)), F.substr(name, F.lit(len(base) + 1))).otherwise(name)
    text = F.when(F.is_valid_utf8("content"), F.col("content").cast("string"))
    kind = F.when(F.col("path").endswith(".rst"), "rst").when(F.col("path").rlike(r"\.html?$"), "html").otherwise("markdown")
    return files.select(F.lit(framework).alias("framework"), rel.alias("source_file"), text.alias("content"), kind.alias("content_type")).where(F.col("content").isNotNull())


def fingerprint(spark: SparkSession, path: str, pattern: str = "*.md") -> str:
    """A version that follows from the number of files, their size and the latest change; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("length", "modificationTime")
    return files.agg(version_of(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.unix_seconds(F.max("modificationTime")), F.lit(0)))).first()[0]


def version_of(count, size, modified):
    return F.left(F.sha2(F.concat_ws(":", count.cast("string"), size.cast("string"), modified.cast("string")), 256), F.lit(12))
