"""Descriptive tables, top rows, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldjobs.operators.ranks import group_of, running_total, with_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def score_counts(df: DataFrame, score: str, low: float = 1.0, high: float = 9.0, step: float = 0.5) -> DataFrame:
    """``score, observed`` over all legal scores, zeros kept."""
    n = round((high - low) / step) + 1
    legal = df.sparkSession.range(n).select((F.lit(low) + F.col("id") * step).alias("score"))
    seen = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("observed"))
    return legal.join(seen, "score", "left").select("score", F.coalesce("observed", F.lit(0)).alias("observed"))


def half_share(counts: DataFrame) -> DataFrame:
    """One row: the share of scores that are no whole numbers."""
    return counts.agg((F.sum(F.when(F.pmod("score", F.lit(1.0)) != 0, F.col("observed")).otherwise(0)) / F.sum("observed")).alias("half_share"))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def offset_pivot(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def share_within(df: DataFrame, days: str, most: int = 3) -> DataFrame:
    return df.where(F.col(days).isNotNull()).agg(F.avg((F.abs(days) <= most).cast("double")).alias("share"))


def year_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    out = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = with_quantiles(out, df, value, [by], QUARTILES)
    return out.select(by, "n", "mean", "median", "sd", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def label_stats(df: DataFrame, label: str) -> DataFrame:
    out = df.agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("std"), F.min(label).alias("min"), F.max(label).alias("max"))
    return with_quantiles(out, df, label, [], {"median": 0.5})


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("_all")).alias("share"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, count, mean, std, min, q1, median, q3, max``."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "x")
    out = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return with_quantiles(out, long, "x", ["column"], QUARTILES).select("column", "count", "mean", "std", "min", "q1", "median", "q3", "max")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def worst_rows(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    return df.orderBy(by, *ties).limit(k)


def extremes(df: DataFrame, by: str, value: str, k: int, key: str) -> DataFrame:
    """The k largest and the k smallest rows of each group, with ``kind`` and ``place``."""
    parts = []
    for kind, order in (("largest", F.desc(value)), ("smallest", F.asc(value))):
        place = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
        parts.append(df.where(F.col(value).isNotNull()).withColumn("place", place).where(F.col("place") <= k).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, by: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """Up to n rows of each group, the same ones every time."""
    w = Window.partitionBy(by).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def percentile_pick(df: DataFrame, by: list[str], value: str, key: str, percents: tuple[int, ...] = (10, 90)) -> DataFrame:
    """Of each group, sorted, the rows at round(p / 100 * (n - 1)), ties of rounding to even.

    Values are placed by running totals; only the rows that share a wanted value are sorted, by ``key``.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_g", group_of(by)).withColumn("_v", F.col(value))
    counts = rows.groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    sizes = counts.groupBy("_g").agg(F.sum("_c").alias("_n")).select("_g", "_n", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    place = F.bround(F.col("percent") / 100 * (F.col("_n") - 1)).cast("long")
    placed = running_total(counts, "_v", "_c", ["_g"]).join(sizes, "_g").where((place >= F.col("before")) & (place < F.col("before") + F.col("_c")))
    placed = placed.select("_g", "_v", "percent", (place - F.col("before") + 1).alias("_nth"))
    alike = rows.join(placed.select("_g", "_v").distinct(), ["_g", "_v"], "left_semi")
    alike = alike.withColumn("_nth", F.row_number().over(Window.partitionBy("_g", "_v").orderBy(key)).cast("long"))
    return alike.join(placed, ["_g", "_v", "_nth"]).select(*df.columns, "percent")
