"""Bins of scores and day offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldjobs.operators.ranks import group_of, quantiles

#: Labels of the day-offset bins and the right-closed edges between them.
OFFSET_LABELS = ["3+ days before", "2 days before", "1 day before", "Same day", "1 day after", "2 days after", "3+ days after"]
OFFSET_EDGES = [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5]


def half_step(score: Column) -> Column:
    """Nearest half, ties to the even half step."""
    return F.bround(score * 2) / 2


def integer_bin(score: Column, low: int = 1, high: int = 9) -> Column:
    """b for scores in [b - 0.5, b + 0.5); null outside low..high."""
    b = F.floor(score + 0.5)
    return F.when(b.between(low, high), b)


def offset_position(days: Column) -> Column:
    out = F.when(days.isNull(), None)
    for i, edge in enumerate(OFFSET_EDGES):
        out = out.when(days <= edge, i)
    return out.otherwise(len(OFFSET_EDGES))


def offset_label(position: Column) -> Column:
    return F.get(F.array(*map(F.lit, OFFSET_LABELS)), position)


def quantile_bins(df: DataFrame, col: str, n: int = 5, by: tuple[str, ...] = (), approx: bool = False, few: bool = False) -> DataFrame:
    """Adds ``bin`` 0..: linear quantile edges, equal edges merged, right-closed, the lowest value in the first bin.

    ``few``: a row for each ``by`` may be sent to all tasks, and ``df`` is not shuffled.
    """
    probabilities = [i / n for i in range(n + 1)]
    src = df.withColumn("_g", group_of([*by]))
    found = src.groupBy("_g").agg(F.percentile_approx(col, probabilities, 100_000).alias("_q")) if approx else quantiles(df, col, [*by], probabilities)
    out = src.join(found if by and not few else F.broadcast(found), "_g", "left").withColumn("_edges", F.array_distinct("_q"))  # without ``by``, one row
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    return out.withColumn("bin", F.when(F.col(col).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(col))))).drop("_edges", "_q", "_g")
