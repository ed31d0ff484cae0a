"""Agreement of raters, fits, and the null model of scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fieldjobs.functions.keys import reliability, stars
from fieldjobs.functions.pvalues import p_of_chi2, p_of_r, quantile_of_f
from fieldjobs.operators.metrics import correlation


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``by, n, r, p`` of complete pairs."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    varied = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    out = ok.groupBy(*by).agg(F.count("*").alias("n"), F.when(varied, correlation(F.col(x), F.col(y))).alias("r"))
    return out.withColumn("p", p_of_r(F.col("r"), F.col("n")))


def rater_pairs(ratings: DataFrame) -> DataFrame:
    """``a, b, n, r, p``: correlation of every two raters over the plots both scored."""
    one = ratings.select("plot", F.col("rater").alias("a"), F.col("score").alias("x"))
    two = ratings.select("plot", F.col("rater").alias("b"), F.col("score").alias("y"))
    return pearson(one.join(two, "plot").where("a < b"), "x", "y", ["a", "b"])


def consensus(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("plot").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("score").alias("n"))


def icc(ratings: DataFrame, raters: int) -> DataFrame:
    """One row: ``n, k, icc, ci_low, ci_high, reliability``. ICC(2,1), absolute agreement, over plots that all raters scored."""
    full = ratings.where("score is not null").groupBy("plot").agg(F.count_distinct("rater").alias("_k")).where(F.col("_k") == raters).select("plot")
    r = ratings.where("score is not null").join(full, "plot")
    total = r.agg(F.sum("score").alias("s"), F.sum(F.col("score") ** 2).alias("ss"))
    rows = r.groupBy("plot").agg(F.sum("score").alias("x")).agg(F.sum(F.col("x") ** 2).alias("sr"), F.count("*").alias("n"))
    cols = r.groupBy("rater").agg(F.sum("score").alias("x")).agg(F.sum(F.col("x") ** 2).alias("sc"), F.count("*").alias("k"))
    one = total.join(F.broadcast(rows)).join(F.broadcast(cols))  # one row each
    n, k, N = F.col("n").cast("double"), F.col("k").cast("double"), F.col("n") * F.col("k").cast("double")
    mean = F.col("s") ** 2 / N
    msr, msc = (F.col("sr") / k - mean) / (n - 1), (F.col("sc") / n - mean) / (k - 1)
    mse = (F.col("ss") - F.col("sr") / k - F.col("sc") / n + mean) / ((n - 1) * (k - 1))
    one = one.where((n > 1) & (k > 1)).select("n", "k", msr.alias("msr"), msc.alias("msc"), mse.alias("mse"))
    n, k, msr, msc, mse = (F.col(c).cast("double") for c in ("n", "k", "msr", "msc", "mse"))
    value = (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)
    one = one.withColumn("icc", value)
    v = F.col("icc")
    a, b = k * v / (n * (1 - v)), 1 + k * v * (n - 1) / (n * (1 - v))
    df = (a * msc + b * mse) ** 2 / ((a * msc) ** 2 / (k - 1) + (b * mse) ** 2 / ((n - 1) * (k - 1)))
    one = one.withColumn("df", df)
    hi, lo = quantile_of_f(F.lit(0.975), n - 1, F.col("df")), quantile_of_f(F.lit(0.975), F.col("df"), n - 1)
    one = one.withColumn("f_hi", hi).withColumn("f_lo", lo)
    low = n * (msr - F.col("f_hi") * mse) / (F.col("f_hi") * (k * msc + (k * n - k - n) * mse) + n * msr)
    high = n * (F.col("f_lo") * msr - mse) / (k * msc + (k * n - k - n) * mse + n * F.col("f_lo") * msr)
    return one.select("n", "k", "icc", low.alias("ci_low"), high.alias("ci_high"), reliability(v).alias("reliability"))


def ols(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``by, n, slope, intercept`` of y on x over complete pairs."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def agreement_table(pairs: DataFrame, model_pairs: DataFrame) -> DataFrame:
    """Every pair with stars, then the mean rater-rater r, the mean model-rater r and their difference."""
    rows = pairs.select(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("what"), "n", "r", stars(F.col("p")).alias("stars"))
    models = model_pairs.select(F.concat_ws("-", F.lit("model"), F.col("rater").cast("string")).alias("what"), "n", "r", stars(F.col("p")).alias("stars"))
    rr, mr = pairs.agg(F.avg("r").alias("rr")), model_pairs.agg(F.avg("r").alias("mr"))
    both = rr.join(F.broadcast(mr))  # one row each
    means = both.select(F.expr("stack(3, 'rater-rater', rr, 'model-rater', mr, 'difference', mr - rr)").alias("what", "r"))
    return rows.unionByName(models).unionByName(means.select("what", F.lit(None).cast("long").alias("n"), "r", F.lit(None).cast("string").alias("stars")))


def _cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def expected_scores(counts: DataFrame, low: float = 1.0, high: float = 9.0, least: float = 0.5) -> DataFrame:
    """``score, observed, expected``: what a smooth density, reflected at the ends, expects at each legal half step.

    ``counts`` has score and observed, one row for each of the few legal scores. The
    kernel is normal with width max(sd * n^-0.2, ``least``); as its integral over a half
    step is a difference of two distribution values, the histogram is all that is needed.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        x, c = table["score"].to_numpy(float), table["observed"].to_numpy(float)
        n = c.sum()
        mean = (x * c).sum() / n
        sd = math.sqrt((c * (x - mean) ** 2).sum() / max(n - 1, 1))
        h = max(sd * n**-0.2, least)
        mass = []
        for s in sorted(x):
            a, b = max(s - 0.25, low), min(s + 0.25, high)
            mass.append(sum(w * (_cdf((b - m) / h) - _cdf((a - m) / h)) for v, w in zip(x, c) for m in (v, 2 * low - v, 2 * high - v)))
        total = sum(mass)
        return pd.DataFrame({"score": sorted(x), "expected": [n * m / total for m in mass]})

    made = counts.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(run, "score double, expected double")
    return counts.select("score", "observed").join(made, "score")


def chi_square(table: DataFrame) -> DataFrame:
    """One row: ``chi2, df, p`` of observed against expected."""
    out = table.agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"), (F.count("*") - 1).alias("df"))
    return out.withColumn("p", p_of_chi2(F.col("chi2"), F.col("df").cast("double")))
