"""Models side by side, and what a training history comes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldjobs.functions.keys import with_names
from fieldjobs.operators.metrics import across_folds
from fieldjobs.operators.ranks import group_of, running_total

#: Steps of a run that are folded within a row; longer runs are cut into blocks of about so many.
STEPS = 1 << 16


def model_comparison(metrics: DataFrame, names: list[str], higher: tuple[str, ...] = ("r2",)) -> DataFrame:
    """``model, metric, mean, std, n_folds, best``: best of each metric over models, ties all flagged."""
    m = across_folds(metrics, names, ["model"]).select("model", "metric", "mean", "std", "n_folds")
    w = Window.partitionBy("metric")
    top = F.when(F.col("metric").isin(*higher), F.max("mean").over(w)).otherwise(F.min("mean").over(w))
    return m.withColumn("best", F.col("mean") == top)


def aggregate_results(metrics: DataFrame, names: DataFrame, values: list[str]) -> DataFrame:
    """Model x fold rows with display columns, and a ``mean`` row for each model."""
    rows = metrics.select("model", F.col("fold").cast("string").alias("fold"), *(F.col(v).cast("double").alias(v) for v in values))
    means = rows.groupBy("model").agg(*(F.avg(v).alias(v) for v in values)).select("model", F.lit("mean").alias("fold"), *values)
    return with_names(rows.unionByName(means), names)


def fold_digest(metrics: DataFrame, values: list[str]) -> DataFrame:
    """``fold, metric, avg, min, min_model, max, max_model, range`` over models; of equal values the first model by name."""
    long = metrics.unpivot(["model", "fold"], values, "metric", "value").where("value is not null")
    lo, hi = F.min(F.struct("value", "model")), F.min(F.struct((-F.col("value")).alias("v"), "model"))
    return long.groupBy("fold", "metric").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), lo["model"].alias("min_model"), F.max("value").alias("max"), hi["model"].alias("max_model"), (F.max("value") - F.min("value")).alias("range"))


def fold_summary(labels: DataFrame, metrics: DataFrame, values: list[str], year: str = "year", score: str = "score") -> DataFrame:
    """Per test year: rows to train on and to test, score spread, and mean metrics over models."""
    stats = labels.groupBy(F.col(year).alias("fold")).agg(F.count("*").alias("test_n"), F.stddev_samp(score).alias("score_sd"), (F.max(score) - F.min(score)).alias("score_range"))
    total = labels.agg(F.count("*").alias("_all"))
    means = metrics.groupBy("fold").agg(*(F.avg(v).alias(f"mean_{v}") for v in values))
    return stats.join(F.broadcast(total)).withColumn("train_n", F.col("_all") - F.col("test_n")).drop("_all").join(means, "fold", "left")


def run_summary(history: DataFrame, by: list[str], min_delta: float = 0.001, patience: int | None = None, epoch: str = "epoch", value: str = "value", steps: int = 0) -> DataFrame:
    """``by, best_epoch, best_value, epochs_trained, final_value``.

    An epoch is best if it is more than ``min_delta`` (0 at least) above the best so far;
    with ``patience`` (1 at least), epochs after so many misses in a row don't count. Rows
    without a value don't count; of an epoch that is given twice the smaller value comes
    first, and a null epoch before all. A run of at most ``steps`` rows is folded within
    its row, a longer one from its blocks' record highs.
    """
    if min_delta < 0 or (patience is not None and patience < 1):
        raise ValueError("min_delta is 0 at least, patience 1")
    steps = steps or STEPS
    rows = history.where(F.col(value).isNotNull()).select(group_of(by).alias("_run"), F.coalesce(F.col(epoch).cast("long"), F.lit(-(2**63))).alias("e"), F.col(value).cast("double").alias("v"))
    large = rows.groupBy("_run").agg(F.count("*").alias("n")).where(F.col("n") > steps)
    short = rows.join(large, "_run", "left_anti")
    whole = F.array_sort(F.collect_list(F.struct("e", "v")))
    ranked = short.groupBy("_run").agg(F.transform(whole, lambda x, i: F.struct((i + 1).cast("long").alias("p"), x["e"].alias("e"), x["v"].alias("v"))).alias("_s"))
    state = ranked.select("_run", _fold("_s", min_delta, patience).alias("r"), F.size("_s").cast("long").alias("n"), "_s").withColumn("n", _trained(patience))
    out = state.select("_run", "r.best", "n", F.element_at("_s", F.col("n").cast("int"))["v"].alias("final_value"))
    out = out.union(_of_blocks(rows.join(large, "_run", "left_semi"), large, min_delta, patience, steps))
    return out.select(
        *(F.col("_run").getField(c).alias(c) for c in by), F.nullif(F.col("best.e"), F.lit(-(2**63))).alias("best_epoch"), F.col("best.v").alias("best_value"),
        F.col("n").alias("epochs_trained"), "final_value",
    )


def _trained(patience: int | None):
    return F.col("n") if patience is None else F.least(F.col("n"), F.col("r.best.p") + patience)


def _fold(steps: str, min_delta: float, patience: int | None):
    """The last best of sorted steps (place ``p``, ``e``, ``v``), and whether patience ended there."""
    first = F.get(steps, F.lit(0))

    def step(acc, x):
        better = x["v"] > acc["best"]["v"] + min_delta
        late = F.lit(False) if patience is None else x["p"] - acc["best"]["p"] > patience
        ended = acc["ended"] | (better & late)
        return F.struct(F.when(better & ~ended, x).otherwise(acc["best"]).alias("best"), ended.alias("ended"))

    return F.aggregate(steps, F.struct(first.alias("best"), F.lit(False).alias("ended")), step)


def _of_blocks(rows: DataFrame, sizes: DataFrame, min_delta: float, patience: int | None, steps: int) -> DataFrame:
    """``_run, best, n, final_value`` of long runs.

    A best step is a record high of its run, so a block hands on only its steps above all
    before them. A record more than ``min_delta`` above the record before it is best
    whatever came before, so records are folded in stretches that begin with one.
    """
    rows = rows.groupBy("_run", "e", "v").agg(F.count("*").alias("c"))
    before = running_total(rows.groupBy("_run", "e").agg(F.sum("c").alias("n")), "e", "n", ["_run"]).select("_run", "e", "before")
    rows = rows.join(before, ["_run", "e"]).withColumn("_block", F.floor(F.col("before") / steps))
    inside, earlier = Window.partitionBy("_run", "_block").orderBy("e", "v"), (Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("_run").orderBy("_block").rowsBetween(*earlier)  # a row a block
    tops = rows.groupBy("_run", "_block").agg(F.max("v").alias("_m")).select("_run", "_block", F.max("_m").over(blocks).alias("_earlier"))
    place = F.first("before").over(inside) + F.coalesce(F.sum("c").over(inside.rowsBetween(*earlier)), F.lit(0)) + 1
    placed = rows.withColumns({"_top": F.max("v").over(inside.rowsBetween(*earlier)), "p": place})
    above = lambda c: F.col(c).isNull() | (F.col("v") > F.col(c))
    records = placed.join(tops, ["_run", "_block"]).where(above("_top") & above("_earlier"))
    last = F.coalesce(F.lag("v").over(inside), F.col("_earlier"))
    records = records.withColumn("_sure", F.when(last.isNull() | (F.col("v") > last + min_delta), 1).otherwise(0))
    counts = records.groupBy("_run", "_block").agg(F.sum("_sure").alias("_m")).select("_run", "_block", F.coalesce(F.sum("_m").over(blocks), F.lit(0)).alias("_seg"))
    records = records.withColumn("_own", F.sum("_sure").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(counts, ["_run", "_block"]).withColumn("_seg", F.col("_seg") + F.col("_own"))
    stretches = records.groupBy("_run", "_seg").agg(F.array_sort(F.collect_list(F.struct("p", "e", "v"))).alias("_s")).select("_run", "_seg", F.get("_s", F.lit(0))["p"].alias("_begin"), _fold("_s", min_delta, patience).alias("r"))
    following = stretches.select("_run", (F.col("_seg") - 1).alias("_seg"), F.col("_begin").alias("_next"))
    ends = stretches.join(following, ["_run", "_seg"], "left")
    late = F.lit(False) if patience is None else F.col("_next") - F.col("r.best.p") > patience
    best = ends.where(F.col("r.ended") | F.col("_next").isNull() | late).groupBy("_run").agg(F.min(F.struct("_seg", "r"))["r"].alias("r"))
    best = best.join(sizes, "_run").withColumn("n", _trained(patience))
    final = placed.join(best, "_run").where((F.col("p") <= F.col("n")) & (F.col("n") < F.col("p") + F.col("c")))
    return final.select("_run", "r.best", "n", F.col("v").alias("final_value"))


def cost_digest(runs: DataFrame, by: str, seconds: str, epochs: str, images: str) -> DataFrame:
    """``by, total_hours, mean_hours, epochs, seconds_per_epoch, images_per_second`` from one row per fold."""
    s = F.sum(seconds)
    return runs.groupBy(by).agg((s / 3600).alias("total_hours"), (F.avg(seconds) / 3600).alias("mean_hours"), F.sum(epochs).alias("epochs"), (s / F.nullif(F.sum(epochs), F.lit(0))).alias("seconds_per_epoch"), (F.sum(images) / F.nullif(s, F.lit(0))).alias("images_per_second"))
