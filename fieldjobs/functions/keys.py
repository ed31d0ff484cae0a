"""Keys in file names, errors, labels and small column rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def parse_image_key(df: DataFrame, name: str = "image_filename") -> DataFrame:
    """Adds ``flight_key, flight_date, field, plot`` from YYYYMMDD_FIELD_PLOT.jpg; null where the name does not fit."""
    base = F.element_at(F.split(F.col(name), "/"), -1)
    part = lambda pattern, i: F.nullif(F.regexp_extract(base, pattern, i), F.lit(""))
    head = r"^(\d{8})_([A-Za-z0-9]+)_"
    day, field = part(head, 1), F.upper(part(head, 2))
    return df.withColumns({
        "flight_key": F.when(day.isNotNull(), F.concat_ws("_", day, field)), "flight_date": F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date"),
        "field": field, "plot": part(r"_(\d{5})\.jpg$", 1).cast("int"),
    })


def padded(plot: Column) -> Column:
    """At least five digits."""
    text = plot.cast("int").cast("string")
    return F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)


def build_image_key(date: Column, field: Column, plot: Column) -> Column:
    return F.concat(F.date_format(date, "yyyyMMdd"), F.lit("_"), field, F.lit("_"), padded(plot), F.lit(".jpg"))


def short_date(date: Column) -> Column:
    """M/d/yy."""
    return F.date_format(date, "M/d/yy")


def with_errors(df: DataFrame) -> DataFrame:
    """Adds ``signed_error`` (predicted - actual) and ``abs_error`` where absent; takes target/prediction for actual/predicted."""
    for old, new in (("target", "actual"), ("prediction", "predicted")):
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    if "signed_error" not in df.columns:
        df = df.withColumn("signed_error", F.col("predicted") - F.col("actual"))
    return df if "abs_error" in df.columns else df.withColumn("abs_error", F.abs("signed_error"))


def validate_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``n_rows`` and ``null_<key>`` for each key; raises if a key is no column."""
    if missing := sorted(set(keys) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys))


def score_class(score: Column) -> Column:
    return F.when(F.pmod(score, F.lit(1.0)) == 0, "integer").when(score.isNotNull(), "half")


def error_sign(error: Column) -> Column:
    return F.when(error > 0, "over").when(error < 0, "under").when(error == 0, "exact")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def reliability(icc: Column) -> Column:
    return F.when(icc >= 0.9, "excellent").when(icc >= 0.75, "good").when(icc >= 0.5, "moderate").when(icc.isNotNull(), "poor")


def of_flight(df: DataFrame, flight: str, name: str = "image_filename") -> DataFrame:
    return parse_image_key(df, name).where(F.col("flight_key") == flight)


def with_names(df: DataFrame, names: DataFrame, key: str = "model") -> DataFrame:
    """Display columns of a small dimension table with ``rank``; unknown keys show themselves and come last."""
    out = df.join(names, key, "left").withColumn("rank", F.coalesce("rank", F.lit(9999)))
    return out.withColumn("display_name", F.coalesce("display_name", F.col(key)))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Adds ``label_index``: place among the sorted distinct labels, from 0; null labels get null.

    There are as many indexes as classes, so they are numbered in one small task.
    """
    from pyspark.sql import Window

    classes = df.where(F.col(label).isNotNull()).select(label).distinct()
    classes = classes.withColumn("label_index", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(classes, label, "left")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def days_since(date: Column, reference: Column) -> Column:
    return F.datediff(date, reference)


def season_axis(date: Column, year: int = 2000) -> Column:
    """The date's month and day in one year; null for a leap day in a common year."""
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    there = F.lit(True) if leap else ~((F.month(date) == 2) & (F.day(date) == 29))
    return F.when(there, F.make_date(F.lit(year), F.month(date), F.day(date)))
