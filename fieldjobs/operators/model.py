"""Scoring with any predictor, and leave-one-group-out fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, functions as F

from fieldjobs.operators.metrics import regression_metrics
from fieldjobs.operators.splits import leave_one_group_out, stratified_split

#: Columns of a fold. A loss is a mean squared error.
VALIDATION = ("train_samples", "train_loss", "train_r2", "val_samples", "val_loss", "val_r2", "test_samples", "test_loss", "test_r2", "test_rmse", "test_mae")


def score(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.Series]], inputs: list[str], actual: str | None = None) -> DataFrame:
    """``df`` with ``predicted`` and, if there is a truth, errors. ``make`` is called once a task and returns the predictor."""
    keep = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for pdf in batches:
            pdf["predicted"] = predict(pdf[inputs]) if len(pdf) else pd.Series(dtype=float)
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = df.mapInPandas(run, f"{kinds}, predicted double").select(*keep, "predicted")
    truth = F.col(actual).cast("double") if actual else F.lit(None).cast("double")
    return out.withColumn("signed_error", F.col("predicted") - truth).withColumn("abs_error", F.abs("signed_error"))


def _groups(df: DataFrame, group: str, most: int) -> list:
    values = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{group} has more than {most} values, each of which would be a fold")
    return sorted(values)


def cross_validate(df: DataFrame, group: str, estimator: Estimator, target: str, key: str, ratio: float = 0.15, parallel: int = 4, most: int = 100) -> DataFrame:
    """One row per group value, ``fold`` and the columns of ``VALIDATION``, of the estimator fitted without that group.

    Each fold is a distributed fit; ``parallel`` of them run side by side. More than
    ``most`` groups raise. For linear models see ``cross_validate_linear``.
    """

    def fold(v) -> tuple:
        pool = stratified_split(df.where(F.col(group) != v).withColumn("_fold", F.lit(v)), ["_fold"], target, key, ratio).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fitted = estimator.fit(pool.where("split = 'train'"))
            rows = pool.select("split", *df.columns).unionByName(df.where(F.col(group) == v).select(F.lit("test").alias("split"), "*"))
            rows = fitted.transform(rows).select("split", F.col(target).cast("double").alias("actual"), F.col("prediction").alias("predicted"))
            got = {r["split"]: r for r in regression_metrics(rows, "split", ("n", "mse", "r2", "rmse", "mae")).collect()}  # three rows
        finally:
            pool.unpersist()
        parts = [(p, m) for p, names in (("train", 3), ("val", 3), ("test", 5)) for m in ("n", "mse", "r2", "rmse", "mae")[:names]]
        return (str(v), *(got[p][m] if p in got else 0 if m == "n" else None for p, m in parts))

    values, folds = _groups(df, group, most), []
    if values:
        with ThreadPool(min(parallel, len(values))) as threads:
            folds = threads.map(inheritable_thread_target(df.sparkSession)(fold), values)
    return df.sparkSession.createDataFrame(folds, "fold string, " + ", ".join(f"{c} {'long' if c.endswith('samples') else 'double'}" for c in VALIDATION))


def _moments(columns: list[str]) -> list:
    """Mean and covariances of columns, in the order of the upper triangle; these merge, and lose no digits to large means."""
    pairs = [F.covar_pop(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return [F.count("*").alias("n"), F.array(*(F.avg(c) for c in columns)).alias("mean"), F.array(*pairs).alias("cov")]


def _solve(parts: pd.DataFrame, size: int) -> pd.DataFrame:
    """Coefficients of each fold from the moments of its training rows, and what they come to on both of its parts."""

    def unfold(row) -> tuple[np.ndarray, np.ndarray]:
        cov = np.zeros((size, size))
        cov[np.triu_indices(size)] = row.cov
        return np.asarray(row.mean), cov + np.triu(cov, 1).T

    out = []
    for name, rows in parts.groupby("fold"):
        by = {r.split: r for r in rows.itertuples()}
        mean, cov = unfold(by["train"])
        slopes = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=None)[0]
        cut = mean[-1] - slopes @ mean[:-1]
        weights, got = np.append(-slopes, 1.0), [name, slopes, cut]
        for what in ("train", "val"):
            if what not in by:
                got += [0, None, None]
                continue
            mean, cov = unfold(by[what])
            loss = max(weights @ cov @ weights + (weights @ mean - cut) ** 2, 0.0)
            got += [by[what].n, loss, 1 - loss / cov[-1, -1] if cov[-1, -1] else float(loss == 0)]
        out.append(got)
    return pd.DataFrame(out, columns=["fold", "slopes", "cut", *VALIDATION[:6]])


def cross_validate_linear(df: DataFrame, group: str, features: list[str], target: str, key: str, ratio: float = 0.15, most: int = 100) -> DataFrame:
    """``cross_validate`` of a least-squares fit, of all folds at once.

    One pass splits all pools and gathers means and covariances by fold and part; a fold's
    coefficients are solved from them in one small row, and so are its losses on training
    and validation rows. A second pass scores each row by its own group's coefficients (one
    row a fold is sent to all tasks). Rows with a null in a feature or the target take no
    part; where features repeat each other, the shortest coefficients are taken. More than
    ``most`` groups raise.
    """
    _groups(df, group, most)
    x = [f"_x{i}" for i in range(len(features))]
    own = df.select(F.col(group).alias("_group"), F.col(key).alias("_key"), *(F.col(f).cast("double").alias(c) for f, c in zip(features, x)), F.col(target).cast("double").alias("actual")).na.drop(subset=["_group", *x, "actual"])
    pool = stratified_split(leave_one_group_out(own, "_group").where("split = 'pool'").drop("split"), ["fold"], "actual", "_key", ratio, few=True)
    parts = pool.groupBy(F.col("fold").cast("string").alias("fold"), "split").agg(*_moments([*x, "actual"]))
    size = len(x) + 1
    kinds = ", ".join(f"{c} {'long' if c.endswith('samples') else 'double'}" for c in VALIDATION[:6])
    fits = parts.groupBy("fold").applyInPandas(lambda pdf: _solve(pdf, size), f"fold string, slopes array<double>, cut double, {kinds}")
    fits = df.sparkSession.createDataFrame(fits.collect(), fits.schema)  # a row a fold, at most ``most``; read twice below
    scored = own.withColumn("fold", F.col("_group").cast("string")).join(F.broadcast(fits.select("fold", "slopes", "cut")), "fold")
    predicted = reduce(lambda a, i: a + F.col("slopes")[i] * F.col(x[i]), range(len(x)), F.col("cut"))
    test = regression_metrics(scored.select("fold", "actual", predicted.alias("predicted")), "fold", ("n", "mse", "r2", "rmse", "mae")).toDF("fold", *VALIDATION[6:])
    return fits.join(test, "fold").select("fold", *VALIDATION)
