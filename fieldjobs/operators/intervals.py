"""Interval joins, window summaries and range sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Cells up to this level (2 ** 32 microseconds, over an hour) are not dealt into parts.
LEVEL_OF_ONE = 32

def _cells(start, end, level):
    """The one or two cells of 2 ** level microseconds that a span no longer than that touches."""
    side = F.pow(F.lit(2.0), level).cast("long")
    return F.sequence(F.floor(start / side), F.floor(end / side))


def _salts(level):
    """Into how many parts the points of a cell are dealt: one up to about an hour, then twice as many for each fourfold length."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor((level - LEVEL_OF_ONE) / 2))).cast("int")


def interval_join(points: DataFrame, windows: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Pairs with start <= at <= end, both ends in.

    Time is cut into halves, quarters and so on. A window lies in one or two cells of the
    level of its own length; a point lies in one cell of each level that any window has
    (some tens at most, an array of numbers sent to all tasks). Points of long cells are
    dealt into parts, whose number grows with the square root of the cell's length, and
    windows stand in each part. So a window makes few rows whatever its length, no pair
    is made twice, and a cell of years is not one key.

    ``how="left"`` keeps windows without points. They are found by the points' times and
    keys alone; for statistics of windows ``window_stats`` makes no pairs.
    """
    micros = F.unix_micros
    length = F.greatest(micros(F.col(end)) - micros(F.col(start)) + 1, F.lit(1))
    w = windows.where(F.col(start) <= F.col(end)).withColumn("_level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    levels = w.agg(F.collect_set("_level").alias("_levels"))
    w = w.withColumn("_cell", F.explode(_cells(micros(F.col(start)), micros(F.col(end)), F.col("_level"))))
    w = w.withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(F.col("_level")) - 1)))
    p = points.where(F.col(at).isNotNull()).select(*(F.col(c).alias(f"_p_{c}") for c in points.columns))
    p = p.join(F.broadcast(levels)).withColumn("_p_level", F.explode("_levels")).drop("_levels")  # one row
    t = micros(F.col(f"_p_{at}"))
    p = p.withColumn("_p_cell", _cells(t, t, F.col("_p_level"))[0]).withColumn("_p_salt", F.pmod(F.xxhash64(t, *(f"_p_{c}" for c, kind in points.dtypes if "map" not in kind)), _salts(F.col("_p_level"))))
    on = F.col(f"_p_{at}").between(F.col(start), F.col(end))
    for c in ("level", "cell", "salt"):
        on &= F.col(f"_{c}") == F.col(f"_p_{c}")
    for k in keys:
        on &= F.col(k) == F.col(f"_p_{k}")
    added = [c for c in points.columns if c not in keys]
    pairs = w.join(p, on).select(*windows.columns, *(F.col(f"_p_{c}").alias(c) for c in added))
    if how == "inner":
        return pairs
    # nulls in a window's columns equal each other
    met = w.join(p, on, "left_semi").select(*(F.col(c).alias(f"_m_{c}") for c in windows.columns)).distinct()
    same = F.lit(True)
    for c in windows.columns:
        same &= F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    missed = windows.join(met, same, "left_anti")
    return pairs.unionByName(missed.select("*", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in added)))


def window_stats(points: DataFrame, windows: DataFrame, at: str, start: str, end: str, by: list[str], value: str, keys: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    """``by, mean, cv, n`` of the points in each window, ``window_summary`` for all windows; those without points have n = 0.

    No pair of point and window is made. Time is cut into cells no longer than the window
    and more than half as long, so a window is the end of one cell, a whole cell or none,
    and the beginning of another. Points and windows' ends are sorted together in each
    cell, forth and back, with the count, mean and spread so far; an end reads them, and a
    window's two or three parts are merged. Cells of over an hour are dealt into parts as
    in ``interval_join``. ``by`` are columns of the windows; nulls in them equal each other.
    """
    micros = F.unix_micros
    names = [f"_key_{k}" for k in keys]
    w = windows.where(F.col(start) <= F.col(end)).dropna(subset=[*keys]) if keys else windows.where(F.col(start) <= F.col(end))
    w = w.select(F.struct(*by).alias("_of"), *(F.col(k).alias(n) for k, n in zip(keys, names)), micros(F.col(start)).alias("_a"), micros(F.col(end)).alias("_b"))
    w = w.withColumn("_level", F.length(F.bin(F.greatest(F.col("_b") - F.col("_a"), F.lit(1)))) - 1)
    cell = lambda t: F.expr(f"shiftright({t}, _level)")
    part = lambda c, t, back: F.struct(c.alias("_cell"), t.alias("_t"), F.lit(back).alias("_back"))
    last = F.lit(2**63 - 1)
    whole = F.transform(F.sequence(cell("_a") + 1, cell("_b") - 1, F.lit(1)), lambda c: part(c, last, False))
    ends = F.array(part(cell("_a"), F.col("_a"), True), part(cell("_b"), F.col("_b"), False))
    parts = F.when(cell("_a") == cell("_b"), F.array(part(cell("_a"), last, False))).when(cell("_b") - cell("_a") == 1, ends).otherwise(F.concat(ends, whole))
    levels = w.agg(F.collect_set("_level").alias("_levels"))
    w = w.select("_of", *names, "_level", F.inline(parts)).withColumn("_salt", F.explode(F.sequence(F.lit(0), _salts(F.col("_level") + 1) - 1)))
    p = points.where(F.col(at).isNotNull() & F.col(value).isNotNull()).dropna(subset=[*keys]) if keys else points.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    p = p.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), micros(F.col(at)).alias("_t"), F.col(value).cast("double").alias("_x"))
    # values as multiples of one power of two, whose sums are exact, and small rests
    finite = F.when(F.abs("_x") < F.lit(float("inf")), F.abs("_x"))
    step = p.agg(F.max(F.when(finite > 0, finite)).alias("_most")).select(F.coalesce(F.pow(F.lit(2.0), F.ceil(F.log2("_most")) - 26), F.lit(1.0)).alias("_step"))
    p = p.join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels").join(F.broadcast(step))  # one row each
    p = p.withColumn("_hi", F.when(finite.isNotNull(), F.rint(F.col("_x") / F.col("_step")) * F.col("_step")).otherwise(F.col("_x")))
    p = p.withColumn("_lo", F.when(finite.isNotNull(), F.col("_x") - F.col("_hi")).otherwise(0.0)).drop("_step")
    p = p.withColumn("_cell", cell("_t")).withColumn("_salt", F.pmod(F.xxhash64("_t", "_x"), _salts(F.col("_level") + 1)).cast("int"))
    both = p.withColumn("_end", F.lit(0)).unionByName(w.withColumn("_end", F.lit(1)), allowMissingColumns=True)
    within = Window.partitionBy(*names, "_level", "_cell", "_salt")
    marks = {"n": F.count("_x"), "h": F.sum("_hi"), "l": F.sum("_lo"), "v": F.var_pop("_x")}
    forth, back = (within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("_t", "_end"), (F.desc("_t"), "_end")))
    read = both.withColumns({f"_{c}f": m.over(forth) for c, m in marks.items()}).withColumns({f"_{c}b": m.over(back) for c, m in marks.items()}).where(F.col("_end") == 1)
    read = read.select("_of", *(F.when(F.col("_back"), F.col(f"_{c}b")).otherwise(F.col(f"_{c}f")).alias(f"_{c}") for c in marks)).where("_n > 0")
    # deviations are taken from the mean of all parts, so large means lose no digits
    of = Window.partitionBy("_of")
    read = read.withColumn("_m", (F.col("_h") + F.col("_l")) / F.col("_n")).withColumn("_mean", (F.sum("_h").over(of) + F.sum("_l").over(of)) / F.sum("_n").over(of))
    n, mean = F.col("n"), F.col("mean")
    known = read.groupBy("_of").agg(F.sum("_n").alias("n"), F.max("_mean").alias("mean"), F.sum(F.col("_n") * (F.col("_v") + (F.col("_m") - F.col("_mean")) ** 2)).alias("_ss"))
    cv = F.when((n >= least) & (n > 1) & (mean > 0), F.sqrt(F.col("_ss") / F.greatest(n - 1, F.lit(1))) / mean)
    known = known.select("_of", F.when(n >= least, mean).alias("mean"), cv.alias("cv"), "n")
    out = windows.select(F.struct(*by).alias("_of")).distinct().join(known, "_of", "left")
    return out.select("_of.*", "mean", "cv", F.coalesce("n", F.lit(0)).alias("n"))


def window_summary(pairs: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    """``mean, cv, n`` of the valid values per key; with fewer than ``least`` mean and cv are null, cv also where the mean is not positive."""
    n, mean = F.count(value), F.avg(value)
    cv = F.when((n >= least) & (mean > 0), F.stddev_samp(value) / mean)
    return pairs.groupBy(*keys).agg(F.when(n >= least, mean).alias("mean"), cv.alias("cv"), n.alias("n"))


def prefix_sums(increments: DataFrame, day: str, value: str) -> DataFrame:
    """``day, total, days``: sum and number of days up to each day."""
    daily = increments.where(F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(day).agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    month = F.date_trunc("month", F.col(day))
    w = Window.partitionBy("_m").orderBy(day)
    daily = daily.withColumn("_m", month)
    months = daily.groupBy("_m").agg(F.sum("_v").alias("_mv"), F.sum("_n").alias("_mn"))
    before = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)  # one row a month
    months = months.select("_m", F.coalesce(F.sum("_mv").over(before), F.lit(0)).alias("_bv"), F.coalesce(F.sum("_mn").over(before), F.lit(0)).alias("_bn"))
    return daily.join(F.broadcast(months), "_m").select(day, (F.sum("_v").over(w) + F.col("_bv")).alias("total"), (F.sum("_n").over(w) + F.col("_bn")).alias("days"))


def range_sum(increments: DataFrame, spans: DataFrame, day: str, value: str, start: str, end: str) -> DataFrame:
    """``spans`` with ``total``: the sum over start <= day <= end, null where no day is in the span.

    Two look-ups in the prefix sums, laid out on a dense calendar of days.
    """
    sums = prefix_sums(increments, day, value)
    ends = sums.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    calendar = ends.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("_d"))
    dense = calendar.join(sums, calendar["_d"] == sums[day], "left").select("_d", "total", "days")
    month = Window.partitionBy(F.date_trunc("month", "_d")).orderBy("_d")
    last = lambda c: F.last(c, True).over(month)
    dense = dense.select("_d", F.date_trunc("month", "_d").alias("_m"), last("total").alias("total"), last("days").alias("days"))
    months = dense.groupBy("_m").agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("_d"))).alias("_t"), F.max("days").alias("_n"))
    before = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("_m", F.last("_t", True).over(before).alias("_t"), F.last("_n", True).over(before).alias("_n"))
    dense = dense.join(F.broadcast(months), "_m").select("_d", F.coalesce("total", "_t", F.lit(0)).alias("total"), F.coalesce("days", "_n", F.lit(0)).alias("days"))
    dense = F.broadcast(dense)  # one row a day
    s = spans.join(F.broadcast(ends.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))))
    s = s.withColumn("_to", F.least(F.col(end), "_hi")).withColumn("_from", F.when(F.col(start) > F.col("_lo"), F.least(F.date_sub(F.col(start), 1), "_hi")))
    s = s.join(dense.toDF("_to", "_st", "_sn"), "_to", "left").join(dense.toDF("_from", "_ft", "_fn"), "_from", "left")
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    held = F.coalesce("_sn", F.lit(0))
    n = held - F.least(F.coalesce("_fn", F.lit(0)), held)
    return s.withColumn("total", F.when(known & (n > 0), F.col("_st") - F.coalesce("_ft", F.lit(0)))).select(*spans.columns, "total")
