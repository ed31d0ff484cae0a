"""Image and raster files: indexes, pixels, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Parts of a raster's own name, or of its folder's, that set it aside.
UNUSED = r"(?i)(_CC_|multispectral|ortho)"


def index_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, basename`` (lower case) of the JPEG files below a directory; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return df.withColumn("basename", F.lower(F.element_at(F.split("path", "/"), -1))).where(F.col("basename").rlike(r"\.jpe?g$"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``origin, basename, image`` with rows of BGR bytes; unreadable files have a null image."""
    df = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
    origin = F.col("image.origin")
    return df.select(origin.alias("origin"), F.lower(F.element_at(F.split(origin, "/"), -1)).alias("basename"), F.when(F.col("image.height") > 0, F.col("image")).alias("image"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")


def raster_inventory(listing: DataFrame, field: str | None = None) -> DataFrame:
    """``path, modified, field, flight_folder, flight_date, year, kind``: surface and terrain rasters of drone flights.

    Flight folders start with ``DJI_`` and hold a date; the folder above names the field.
    Names end with ``_dsm.tif`` or ``_dtm.tif``: what is made from them (hillshades) is none.
    """
    folder = F.regexp_extract("path", r"/(DJI_[^/]*)/", 1)
    kind = F.lower(F.regexp_extract("path", r"(?i)_(dsm|dtm)\.tif$", 1))
    df = listing.withColumn("flight_folder", folder).withColumn("kind", kind).where((folder != "") & (kind != "") & ~F.regexp_extract("path", r"([^/]*/)?[^/]*$", 0).rlike(UNUSED))
    date = F.try_to_timestamp(F.regexp_extract("flight_folder", r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date")
    df = df.select("path", F.col("modificationTime").alias("modified"), F.upper(F.regexp_extract("path", r"/([^/]+)/DJI_", 1)).alias("field"), "flight_folder", date.alias("flight_date"), F.year(date).alias("year"), "kind")
    return df.where(F.col("field") == field.upper()) if field else df


def flight_rasters(latest: DataFrame) -> DataFrame:
    """``flight_folder, field, flight_date, year, dsm_path, dtm_path``: one row per flight from its newest file of each kind."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path"))).alias(f"{kind}_path")
    return latest.groupBy("flight_folder", "field", "flight_date", "year").agg(of("dsm"), of("dtm"))
