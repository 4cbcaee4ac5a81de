"""Lines of text files with their numbers, which depend on the files alone, however Spark splits them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(id, value): the lines of all files, in order of the files' paths, numbered from 0. With ``header`` the first line of
    each file is left out.

    A split's lines follow each other in one task, so a line's place in its split comes from the row numbers; the lines of the
    splits before it are added. Only counts of splits are shuffled.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = "PARTITION BY file ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    splits = splits.withColumn("above", F.expr(f"coalesce(sum(n) OVER ({own}), 0)"))
    files = splits.groupBy("file").agg((F.sum("n") - int(header)).alias("lines"))  # names only
    files = files.select("file", F.expr("coalesce(sum(lines) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    places = splits.join(files, "file").select("file", "start", "first", "above", "before")
    found = lines.join(places, ["file", "start"]).withColumn("row", F.col("above") + F.col("at") - F.col("first"))
    found = found.filter("row > 0") if header else found
    return found.select((F.col("before") + F.col("row") - int(header)).alias("id"), "value")
