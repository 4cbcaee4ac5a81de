"""Readers and writers for point files and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources import lines, prepare


def latitude_longitude(spark: SparkSession, path: str, n: int | None = None, seed: int = 1) -> DataFrame:
    """A CSV with columns Lat and Lon to (id, lat, lon) from 0 to 1 with a little jitter; ``n`` samples rows. The id is the line's
    number, so sample and jitter are the same however the file is split."""
    names = spark.read.option("header", True).csv(path).columns
    fields = F.from_csv("value", ", ".join(f"`{c}` string" for c in names))
    raw = lines.numbered(spark, path, header=True).select("id", fields.alias("f"))
    rows = raw.select("id", F.col("f.Lat").try_cast("double").alias("lat"), F.col("f.Lon").try_cast("double").alias("lon")).dropna()
    rows = prepare.sample(rows, "id", n, seed) if n else rows
    return prepare.jitter(prepare.min_max(rows, ["lat", "lon"]), ["lat", "lon"], "id", seed=seed)


def road(spark: SparkSession, path: str, md5: str | None = None, seed: int = 2) -> DataFrame:
    """A headerless CSV (key, longitude, latitude, altitude) to z-scores, by line number; ``md5`` guards the file."""
    if md5:
        found = spark.read.format("binaryFile").load(path).select(F.md5("content").alias("sum")).first()
        if found is None or found["sum"] != md5:
            raise ValueError(f"{path} is not the expected file")
    fields = F.from_csv("value", "key string, x double, y double, z double")
    rows = lines.numbered(spark, path).select("id", fields.alias("f")).select("id", "f.x", "f.y", "f.z").dropna()
    return prepare.jitter(prepare.z_score(rows, ["x", "y", "z"]), ["x", "y", "z"], "id", seed=seed)


def pixels(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """Images to (id, r, g, b) from 0 to 1: Spark's image source gives rows of blue, green, red (and alpha) bytes, or
    one byte of grey, which is all three."""
    image = spark.read.format("image").load(path).select("image.data", "image.nChannels", (F.col("image.width") * F.col("image.height")).alias("n"), F.col("image.origin").alias("origin"))
    files = image.select("origin").withColumn("file", F.row_number().over(Window.orderBy("origin")).cast("long") - 1)  # names only
    image = image.join(files, "origin")
    at = image.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    place = lambda k: F.when(F.col("nChannels") < 3, F.col("p") * F.col("nChannels") + 1).otherwise(F.col("p") * F.col("nChannels") + (3 - k))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), place(k).cast("int"), F.lit(1))), 16, 10).cast("double") / 255.0
    rows = at.select((F.shiftleft(F.col("file"), 32) + F.col("p")).alias("id"), byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))
    return prepare.jitter(rows, ["r", "g", "b"], "id", seed=seed)


def append_results(df: DataFrame, path: str) -> None:
    """Runs are added to a Parquet table; readers see whole appends only. ``results.Results`` adds each group once."""
    df.write.mode("append").parquet(path)


def json_record(df: DataFrame, path: str) -> None:
    """One JSON object a row, for records of an environment or of results."""
    df.write.mode("overwrite").json(path)


def text_points(points: DataFrame, path: str) -> None:
    """Points (id, x) for other programs: coordinates in the fewest digits that read back as the same number, in order of id within a file."""
    line = F.array_join(F.transform("x", lambda v: v.cast("string")), " ")
    points.repartitionByRange("id").sortWithinPartitions("id").select(line.alias("value")).write.mode("overwrite").text(path)


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.transform(F.split("value", " "), lambda v: v.cast("double")).alias("x"))


def summary_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
