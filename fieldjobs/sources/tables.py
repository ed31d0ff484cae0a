"""Readers of the study's CSV and JSON tables, and the one sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ZONE = "America/New_York"
#: Where run directories name a fold or a model.
FOLD, MODEL = r"fold_?(\d{2,4})", r"/([^/]+?)_cv0(?:/|$)"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns with trimmed, lower-case names."""
    df = spark.read.csv(path, header=True, multiLine=False)
    return df.toDF(*(c.strip().lower() for c in df.columns))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def any_date(c: str | Column) -> Column:
    """M/d/yy or yyyy-MM-dd."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def number(c: str) -> Column:
    """A double; text flags and NaN are null."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def four_digits(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(_csv(spark, path), "image_filename", "year", "score")
    dates = [c for c in ("date", "flight_date") if c in df.columns]
    df = df.withColumns({c: any_date(c) for c in dates} | {"score": number("score"), "year": F.col("year").try_cast("int")})
    return df.withColumns({c: F.col(c).try_cast("int") for c in ("plot", "signed_days_diff") if c in df.columns}).where("score is not null")


def local_time(text: Column, *formats: str, zone: str = ZONE) -> Column:
    """UTC instant of a local time; times that the clock skips or repeats are null."""
    wall = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    utc = F.to_utc_timestamp(wall, zone)
    hour = F.expr("interval 1 hour")
    again = [F.from_utc_timestamp(u, zone) for u in (utc, utc - hour, utc + hour)]
    return F.when((again[0] == wall) & (again[1] != wall) & (again[2] != wall), utc)


def read_flights(spark: SparkSession, path: str, zone: str = ZONE) -> DataFrame:
    df = require_columns(_csv(spark, path), "flight_key", "flight_start", "flight_end")
    parts = F.split("flight_key", "_")
    return df.select(
        "flight_key", F.try_to_timestamp(parts[0], F.lit("yyyyMMdd")).cast("date").alias("flight_date"), F.upper(parts[1]).alias("field"),
        F.substring("flight_key", 1, 4).try_cast("int").alias("year"), *(local_time(F.col(c), "M/d/yy H:mm", zone=zone).alias(c) for c in ("flight_start", "flight_end")),
    )


def read_minutes(spark: SparkSession, path: str, zone: str = ZONE) -> DataFrame:
    df = require_columns(_csv(spark, path), "datetime", "radiation(w/m2)")
    at = local_time(F.col("datetime"), "M/d/yy H:mm", "M/d/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", zone=zone)
    return df.select(at.alias("at"), number("radiation(w/m2)").alias("radiation")).where("at is not null")


def read_increments(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(_csv(spark, path), "date", "gdd")
    return df.select(any_date("date").alias("date"), number("gdd").alias("gdd")).where("date is not null")


def read_reference_dates(spark: SparkSession, path: str, key: str, date: str) -> DataFrame:
    df = require_columns(_csv(spark, path), key, date)
    name = F.upper(F.col(key)) if key == "field" else F.col(key).try_cast("int")
    return df.select(name.alias(key), any_date(date).alias(date))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    df = require_columns(_csv(spark, path), "plot", "rater", "score")
    return df.select(F.col("plot").try_cast("int").alias("plot"), F.col("rater").try_cast("int").alias("rater"), number("score").alias("score"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All per-fold files below ``path``, the fold's year from the file's name."""
    df = spark.read.option("recursiveFileLookup", "true").csv(path, header=True)
    fold = F.regexp_extract("_metadata.file_path", FOLD, 1).try_cast("int")
    df = require_columns(df, "image_filename", "actual", "predicted").withColumn("fold", four_digits(fold))
    return df.withColumns({c: number(c) for c in ("actual", "predicted", "signed_error", "abs_error") if c in df.columns})


def read_runs(spark: SparkSession, root: str, name: str = "cv_results.csv") -> DataFrame:
    """A result file (CSV or JSON) of every run directory, with ``model`` and, for histories, ``fold`` from the path."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    df = read.json(root, multiLine=True) if name.endswith(".json") else read.csv(root, header=True, inferSchema=True)
    made = {"source_model": F.regexp_extract("_metadata.file_path", MODEL, 1)}
    if "fold" not in df.columns and "*" in name:
        made["fold"] = four_digits(F.regexp_extract("_metadata.file_path", FOLD, 1).try_cast("int"))
    return df.withColumns(made)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", columns: list[str] | None = None, decimals: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Write in a fixed column order, doubles rounded if asked."""
    out = df.select(*(columns or df.columns))
    if decimals is not None:
        out = out.withColumns({c: F.round(c, decimals) for c, kind in out.dtypes if kind in ("double", "float")})
    writer = out.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write a catalogue table in buckets sorted by ``keys``, and read it again.

    Two tables with the same keys and number of buckets join on the keys, checks of
    ``checked_join`` included, and group by them, without a shuffle. Rows are dealt by
    the keys once before they are written, so each bucket is one file. With ``path`` the
    table lies there, else in the warehouse.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
