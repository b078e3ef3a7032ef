"""Frames of videos as files: which ones to look at is decided from their names, before any is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames that one call of ``read_frames`` reads at most.
MOST = 100_000


def frame_files(spark: SparkSession, root: str, glob: str = "f*.jpg") -> DataFrame:
    """(folder, path, place, n): the files of every folder under ``root`` in order of their names, and how many there are.

    The plan asks the source for paths and lengths alone, so that no file is opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    named = files.select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"), "path")
    by = Window.partitionBy("folder")
    return named.select("folder", "path", (F.row_number().over(by.orderBy("path")) - 1).alias("place"), F.count("*").over(by).alias("n"))


def evenly_spaced(files: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` of each folder's files that are spread evenly from the first to the last, all of a folder that has no more.

    Places between two files go to the nearer, those in the middle to the even one; one wanted is the first.
    """
    places = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(max(wanted - 1, 1)))).cast("int"))
    return files.where((F.col("n") <= wanted) | F.array_contains(places, F.col("place")))


def read_frames(chosen: DataFrame, most: int = MOST) -> DataFrame:
    """(folder, path, place, content) of chosen files, say the frames of a batch of videos; an error for more than ``most``.

    Paths are what the source is opened with: files that were not chosen are neither listed again nor read.
    """
    rows = chosen.select("path").limit(most + 1).toArrow()["path"].to_pylist()
    if len(rows) > most:
        raise ValueError(f"more than {most} frames: read them for fewer videos at a time")
    spark = chosen.sparkSession
    if not rows:
        return chosen.select("folder", "path", "place", F.lit(None).cast("binary").alias("content"))
    content = spark.read.format("binaryFile").load(rows).select("path", "content")
    return chosen.select("folder", "path", "place").join(content, "path").select("folder", "path", "place", "content")
