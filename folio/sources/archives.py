"""Unpacked archives as a table of files: names and sizes without reading a file, contents where they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Pictures that are read as they are, and how many of an archive are kept.
PICTURES = r"(?i)\.(png|jpg|jpeg|gif|webp|svg|pdf|eps)$"
MOST_PICTURES = 30
#: The order of names: letters by their language, then accents, then case.
COLLATION = "UNICODE"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """paper (the first folder below `folder`), path (below that), length and content of all files, at any depth. A plan that doesn't use content doesn't read it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # the path as it stands behind the folder's last part
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    below = F.substring_index(F.col("path"), f"/{base}/", -1)
    return files.select(F.substring_index(below, "/", 1).alias("paper"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "length", "content")


def texts(files: DataFrame) -> DataFrame:
    """The TeX files with their content as text: paper, path and content, as the operator of main files takes them."""
    return files.where(F.lower("path").endswith(".tex")).select("paper", "path", F.decode("content", "UTF-8").alias("content"))


def in_order(name: Column) -> Column:
    """A name as it is ordered among others."""
    return F.collate(name, COLLATION)


def pictures(files: DataFrame, most: int = MOST_PICTURES) -> DataFrame:
    """The first pictures of each paper in the order of their names: paper, num (from 1), path and name."""
    order = Window.partitionBy("paper").orderBy(in_order(F.col("path")), "path")
    found = files.where(F.col("path").rlike(PICTURES)).select("paper", "path").withColumn("num", F.row_number().over(order))
    return found.where(F.col("num") <= most).select("paper", F.col("num").cast("long").alias("num"), "path", F.substring_index("path", "/", -1).alias("name"))
