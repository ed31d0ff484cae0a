"""Field geometry from plot rings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _bearing(ring: np.ndarray) -> float | None:
    """Bearing (0 to 180 from north) of the long edge of the smallest rectangle around the points; None without extent."""
    p = np.unique(ring, axis=0)
    if len(p) < 2:
        return None
    best = None
    for i in range(len(p)):
        for d in p[i + 1 :] - p[i]:
            u = d / np.hypot(*d)
            along, across = np.ptp(p @ u), np.ptp(p @ np.array([-u[1], u[0]]))
            if best is None or along * across < best[0] - 1e-12:
                best = (along * across, u if along >= across else np.array([-u[1], u[0]]))
    return float(np.degrees(np.arctan2(best[1][0], best[1][1])) % 180)


def plot_bearing(ring: Column) -> Column:
    """Long-edge bearing of a plot; rings have few points, so every edge direction between two of them is tried."""

    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([_bearing(np.array([[p["x"], p["y"]] for p in r], float)) if r is not None and len(r) else None for r in rings], dtype="float64")

    run.__annotations__ = {"rings": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(ring)


def circular_mean(df: DataFrame, angle: str, by: str, axial: bool = False) -> DataFrame:
    """``by, mean_angle`` on 0..180. Plain averages the directions; ``axial`` doubles the angles first, so 1 and 179 average to 0."""
    k = 2.0 if axial else 1.0
    a = F.radians(F.col(angle) * k)
    mean = F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))) / k
    return df.groupBy(by).agg(F.pmod(mean, F.lit(180.0)).alias("mean_angle"))


def centroid(df: DataFrame, by: str) -> DataFrame:
    """``by, x, y, area``: centroid of all plots' rings, weighted by area."""
    ring = F.col("ring")
    closed = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    total = lambda f: F.aggregate(closed, F.lit(0.0), lambda acc, e: acc + f(e))
    each = df.select(by, total(cross).alias("a"), total(lambda e: (e["p"]["x"] + e["q"]["x"]) * cross(e)).alias("cx"), total(lambda e: (e["p"]["y"] + e["q"]["y"]) * cross(e)).alias("cy"))
    sign = F.signum("a")
    sums = each.groupBy(by).agg(F.sum(F.abs("a")).alias("a"), F.sum(F.col("cx") * sign).alias("cx"), F.sum(F.col("cy") * sign).alias("cy"))
    return sums.select(by, (F.col("cx") / (3 * F.col("a"))).alias("x"), (F.col("cy") / (3 * F.col("a"))).alias("y"), (F.col("a") / 2).alias("area"))
