"""Folders of items: an annotation table if there is one, else the image files in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from orbisplit.functions.vectors import base_name, suffix
from orbisplit.sources.tables import materialise

#: File endings that count as images.
IMAGES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _is_image(path: str = "path") -> Column:
    return suffix(F.col(path)).isin(*[f".{s}" for s in IMAGES])


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, path), sorted by name, of the folder itself; none is an error. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    files = files.where(_is_image()).select(base_name(F.col("path")).alias("filename"), "path")
    if files.isEmpty():
        raise FileNotFoundError(f"no images in {folder}")
    return files.orderBy("filename")


def numbered(df: DataFrame, name: str = "original_index") -> DataFrame:
    """Rows numbered from 0 in the order they are in: written with their place within a partition, then moved by what stands before."""
    at = F.monotonically_increasing_id()
    df = materialise(df.withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # A row for each partition.
    return df.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_row", "_start")


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """``annotations.csv`` with all its columns, of types that their values suggest (names of files stay text), in the order of the file, else
    the image files by name; ``original_index`` numbers the rows from 0."""
    path = f"{folder.rstrip('/')}/annotations.csv"
    if not _exists(spark, path):
        return numbered(image_files(spark, folder).select("filename"))
    read = spark.read.option("header", True).option("escape", '"')
    types = read.option("inferSchema", True).csv(path).schema
    for field in types:
        if field.name == "filename" or isinstance(field.dataType, (DateType, TimestampType, TimestampNTZType)):
            field.dataType = StringType()
    found = read.schema(types).csv(path)
    # One file's pieces come in their order, a partition each: they are of one size but for the last.
    return numbered(found)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, content) of the image files."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(_is_image()).select(base_name(F.col("path")).alias("filename"), "content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, height, width, nChannels, data, ending, content) of the image files, decoded by Spark's image source; what it cannot read has
    no data, and of files of a kind that it doesn't know the content is given instead."""
    files = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*").where(_is_image("origin"))
    found = files.select(base_name(F.col("origin")).alias("filename"), "height", "width", "nChannels", F.when(F.col("height") > 0, F.col("data")).alias("data"))
    found = found.withColumn("ending", F.substring(suffix(F.col("filename")), 2, 9))
    raw = spark.read.format("binaryFile").load(folder).where(suffix(F.col("path")) == ".webp").select(base_name(F.col("path")).alias("filename"), "content")
    return found.join(raw, "filename", "left")
