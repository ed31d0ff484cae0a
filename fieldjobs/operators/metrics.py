"""Regression metrics by fold, bin, flight and plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldjobs.functions.bins import half_step, integer_bin, offset_label, offset_position
from fieldjobs.functions.pvalues import p_of_t
from fieldjobs.operators.ranks import with_quantiles

ZERO_VARIANCE = ("sklearn", "infinite")


def correlation(x: Column, y: Column) -> Column:
    """Pearson r; null without spread, where ``corr`` raises in ANSI mode."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _aggregates(zero_variance: str) -> dict[str, Column]:
    a, p = F.col("actual"), F.col("predicted")
    e = p - a
    sse, sst = F.sum(e * e), F.nullif(F.var_pop(a) * F.count("*"), F.lit(0.0))
    worst = F.lit(0.0 if zero_variance == "sklearn" else float("-inf"))
    exact = F.lit(1.0 if zero_variance == "sklearn" else 0.0)
    flat = lambda good: F.when(good, exact).otherwise(worst)
    varied = F.min(a) != F.max(a)
    return {
        "n": F.count("*"),
        "r2": F.when(varied, 1 - sse / sst).otherwise(flat(sse == 0)),
        "pearson_r": F.when(varied & (F.min(p) != F.max(p)), correlation(a, p)),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mean_bias": F.avg(a - p),
        "mse": F.avg(e * e),
        "explained_variance": F.when(varied, 1 - F.var_pop(e) / F.nullif(F.var_pop(a), F.lit(0.0))).otherwise(flat(F.min(e) == F.max(e))),
        "mape": F.when(F.count_if(a == 0) == 0, F.avg(F.abs(e / F.nullif(a, F.lit(0.0)))) * 100),
        "mean_actual": F.avg(a), "sd_actual": F.stddev_pop(a), "mean_predicted": F.avg(p), "sd_predicted": F.stddev_pop(p),
        "bias": F.avg(e),
    }


#: The metrics of a fold, without rank correlation (see ranks.spearman).
FOLD = ("n", "r2", "pearson_r", "rmse", "mae", "mean_bias")
#: All metrics. ``mean_bias`` is actual - predicted, ``bias`` predicted - actual.
FULL = ("n", "r2", "pearson_r", "rmse", "mae", "mse", "explained_variance", "mape", "mean_actual", "sd_actual", "mean_predicted", "sd_predicted", "bias")


def regression_metrics(df: DataFrame, by: str, names: tuple[str, ...] = FOLD, total: str | None = None, zero_variance: str = "sklearn") -> DataFrame:
    """Metrics of ``actual`` and ``predicted`` per value of ``by``, as text; with ``total`` also a row of that name over all.

    A constant truth has R2 and explained variance 1 (exact) or 0, or, with
    ``zero_variance="infinite"``, 0 (exact) or minus infinity.
    """
    made = _aggregates(zero_variance)
    aggs = [made[n].alias(n) for n in names]
    src = df.where("actual is not null and predicted is not null")
    if total is None:
        return src.groupBy(F.col(by).cast("string").alias(by)).agg(*aggs)
    grouped = src.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("_total"), *aggs)
    return grouped.select(F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(by).cast("string")).alias(by), *names)


def across_folds(metrics: DataFrame, names: list[str], by: list[str], population: bool = False) -> DataFrame:
    """``by, metric, mean, std, min, max, median, n_folds`` over folds; NaN and infinities are skipped. std is of the sample unless ``population``."""
    long = metrics.unpivot(by, names, "metric", "value")
    ok = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    sd = F.stddev_pop("value") if population else F.stddev_samp("value")
    return ok.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), sd.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median"), F.sort_array(F.collect_list("value")).alias("values"), F.count("*").alias("n_folds"))


def summary_table(metrics: DataFrame, fold: str, names: list[str]) -> DataFrame:
    """The fold rows, then a ``mean`` and a ``std`` row."""
    rows = metrics.select(F.col(fold).cast("string").alias(fold), *(F.col(c).cast("double").alias(c) for c in names))
    row = lambda name, f: rows.agg(*(f(c).alias(c) for c in names)).select(F.lit(name).alias(fold), *names)
    return rows.unionByName(row("mean", F.avg)).unionByName(row("std", F.stddev_samp))


def half_step_bias(df: DataFrame, least: int = 5) -> DataFrame:
    """``bin, n, mean_signed_error, mean_predicted, q1, q3`` by nearest half step of ``actual``, bins of ``least`` rows at least."""
    src = df.select(half_step(F.col("actual")).alias("bin"), "predicted", (F.col("predicted") - F.col("actual")).alias("e"))
    out = src.groupBy("bin").agg(F.count("*").alias("n"), F.avg("e").alias("mean_signed_error"), F.avg("predicted").alias("mean_predicted"))
    return with_quantiles(out.where(F.col("n") >= least), src, "e", ["bin"], {"q1": 0.25, "q3": 0.75})


def integer_bias(df: DataFrame, least: int = 3, low: int = 1, high: int = 9) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    out = df.withColumn("bin", integer_bin(F.col("actual"), low, high)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(e).alias("mean_signed_error"))
    return out.where(F.col("n") >= least)


def offset_stats(df: DataFrame, days: str, error: str) -> DataFrame:
    """Error statistics of the seven day-offset bins, empty ones kept, with a t test against 0 for two rows or more."""
    e = F.col("e")
    src = df.where(F.col(error).isNotNull() & F.col(days).isNotNull()).select(offset_position(F.col(days)).alias("position"), F.col(error).alias("e"))
    got = src.groupBy("position").agg(F.count("*").alias("n"), F.avg(e).alias("mean_signed_error"), F.stddev_samp(e).alias("std_signed_error"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    got = with_quantiles(got, src, "e", ["position"], {"median_signed_error": 0.5})
    bins = df.sparkSession.range(7).select(F.col("id").cast("int").alias("position"))
    out = bins.join(got, "position", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("bin", offset_label(F.col("position")))
    return one_sample_t(out)


def one_sample_t(df: DataFrame, mean: str = "mean_signed_error", sd: str = "std_signed_error", n: str = "n") -> DataFrame:
    """Adds ``t, p`` of the mean against 0."""
    t = F.when((F.col(n) >= 2) & (F.col(sd) > 0), F.col(mean) / (F.col(sd) / F.sqrt(n)))
    out = df.withColumn("t", t)
    return out.withColumn("p", F.when(F.col("t").isNotNull(), p_of_t(F.coalesce("t", F.lit(0.0)), F.greatest(F.col(n) - 1, F.lit(1)).cast("double"))))


def group_error(df: DataFrame, by: str) -> DataFrame:
    """``by, n, mae, mean_signed_error`` (flights)."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.avg("signed_error").alias("mean_signed_error"))


def plot_means(df: DataFrame, by: str = "plot") -> DataFrame:
    return df.groupBy(by).agg(F.avg("predicted").alias("mean_predicted"), F.count("*").alias("n_images"))


def compare_with_baseline(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """One row: metrics of both on the rows they share, and gains (a rise of R2, a fall of RMSE and MAE)."""
    both = current.select(key, "actual", F.col("predicted").alias("p1")).join(baseline.select(key, F.col("predicted").alias("p0")), key)
    a, sst = F.col("actual"), F.var_pop("actual") * F.count("*")
    made = []
    for name, p in (("current", F.col("p1")), ("baseline", F.col("p0"))):
        e = p - a
        made += [(1 - F.sum(e * e) / sst).alias(f"r2_{name}"), F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"), F.avg(F.abs(e)).alias(f"mae_{name}")]
    out = both.agg(F.count("*").alias("n"), *made)
    return out.withColumns({"gain_r2": F.col("r2_current") - F.col("r2_baseline"), "gain_rmse": F.col("rmse_baseline") - F.col("rmse_current"), "gain_mae": F.col("mae_baseline") - F.col("mae_current")})


def error_histogram(df: DataFrame, error: str, bins: int = 50) -> DataFrame:
    """``bin`` 1..bins, ``n``: equal bins from the least to the largest error, the largest in the last."""
    ends = F.broadcast(df.agg(F.min(error).alias("lo"), F.max(error).alias("hi")))
    e = df.where(F.col(error).isNotNull()).select(F.col(error).alias("e")).join(ends)
    bin_ = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("e") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins)))
    return e.groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))
