"""Average ranks without ever ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldjobs.functions.pvalues import p_of_chi2, p_of_r

#: Cells that a range of values is cut into, and the distinct values beyond which it is.
CELLS, LIMIT = 4096, 1 << 16


def running_total(counts: DataFrame, value: str, n: str | list[str], by: list[str], cells: int = 0, limit: int = 0) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over smaller values, within ``by`` (nulls equal each other); of several columns ``before_0`` and so on.

    Values fall into ranges in levels: first by their logarithm, then any range of more
    than ``limit`` values into ``cells`` of one width between its own least and largest
    value, and any of those once more. So the number of ranges grows with the values, and
    no task orders all of a group's. Where a range begins depends on the values alone, so
    a lost task finds the same ranges again.
    """
    cells, limit = cells or CELLS, limit or LIMIT
    x = F.col("_x")
    # NaN is the largest value, and its floor would not be
    coarse = F.when(F.isnan(x), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x)) * 64))
    c = counts.withColumns({"_by": group_of(by), "_x": F.col(value).cast("double")}).withColumn("_0", coarse)
    path = ["_by", "_0"]
    for level in ("_1", "_2"):
        wide = c.groupBy(*path).agg(F.count("*").alias("_many"), F.min("_x").alias("_low"), F.max("_x").alias("_high")).where(F.col("_many") > limit)
        cell = F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells)
        c = c.join(wide, path, "left").withColumn(level, F.coalesce(F.least(cell, F.lit(cells - 1)), F.lit(0))).drop("_many", "_low", "_high")
        path.append(level)
    totals = {"": n} if isinstance(n, str) else {f"_{i}": c for i, c in enumerate(n)}
    ranges = c.groupBy(*path).agg(*(F.sum(m).alias(f"_t{i}") for i, m in totals.items()))
    smaller = (Window.unboundedPreceding, -1)
    within = Window.partitionBy("_by", "_0").orderBy("_1", "_2").rowsBetween(*smaller)
    over = Window.partitionBy("_by").orderBy("_0").rowsBetween(*smaller)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    first = ranges.groupBy("_by", "_0").agg(*(F.sum(f"_t{i}").alias(f"_s{i}") for i in totals)).select("_by", "_0", *(sums(f"_s{i}", over).alias(f"_first{i}") for i in totals))
    ranges = ranges.join(first, ["_by", "_0"]).select(*path, *((F.col(f"_first{i}") + sums(f"_t{i}", within)).alias(f"_before{i}") for i in totals))
    inside = Window.partitionBy(*path).orderBy(value).rowsBetween(*smaller)
    out = c.join(ranges, path).withColumns({f"before{i}": F.col(f"_before{i}") + sums(m, inside) for i, m in totals.items()})
    return out.drop(*path, "_x", *(f"_before{i}" for i in totals))


def average_ranks(df: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """``by, value, n, rank``: each distinct value with its count and the mean rank of its ties."""
    n = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    return running_total(counts, value, "n", by).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).drop("before")


def group_of(by: list[str]) -> Column:
    """The columns ``by`` as one, in which nulls equal each other."""
    return F.struct(*by) if by else F.struct(F.lit(1).alias("all"))


def quantiles(df: DataFrame, value: str, by: list[str], probabilities: list[float]) -> DataFrame:
    """``_g, _q``: per group (``group_of`` of ``by``) the quantiles of its non-null values, linear between the two nearest.

    Exact, and no group is held or sorted in one task: values are placed by running
    totals, and only those at the wanted places are gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group_of(by).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    wanted = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        wanted += [F.struct(F.lit(i).alias("i"), at.alias("place"), part.alias("part")) for at, part in ((low, high - place), (high, place - low))]
    sizes = counts.groupBy("_g").agg(F.sum("_c").alias("_n")).select("_g", F.array(*wanted).alias("_w"))
    placed = running_total(counts, "_v", "_c", ["_g"]).join(sizes, "_g")
    here = F.filter("_w", lambda x: (x["place"] >= F.col("before")) & (x["place"] < F.col("before") + F.col("_c")))
    hits = placed.select("_g", "_v", F.explode(here).alias("x")).select("_g", "_v", "x.*")
    q = F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise(F.sum(F.col("_v") * F.col("part"))).alias("q")
    lists = hits.groupBy("_g", "i").agg(q).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_q"))  # one for each probability
    return lists.select("_g", F.transform("_q", lambda x: x["q"]).alias("_q"))


def with_quantiles(table: DataFrame, df: DataFrame, value: str, by: list[str], names: dict[str, float]) -> DataFrame:
    """``table`` (a row for each group of ``by``) with quantiles of ``value`` in ``df``, by name."""
    found = quantiles(df, value, by, list(names.values()))
    out = table.withColumn("_g", group_of(by)).join(found, "_g", "left")
    return out.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(names)}).drop("_g", "_q")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``by, n, rho, p``: rank correlation of complete pairs; null under three pairs or without spread."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_w"))
    # both columns are ranked in one pass, as one long column
    sides = F.array(F.struct(F.lit("x").alias("_side"), F.col("_x").alias("_v")), F.struct(F.lit("y").alias("_side"), F.col("_y").alias("_v")))
    long = pairs.select(*by, "_w", F.explode(sides).alias("s")).select(*by, "_w", "s.*")
    ranks = average_ranks(long, "_v", [*by, "_side"], "_w")
    rx, ry = (ranks.where(F.col("_side") == side).select(*by, F.col("_v").alias(f"_{side}"), F.col("rank").alias(f"_r{side}")) for side in "xy")
    ranked = pairs.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    return _correlated(ranked, "_rx", "_ry", "_w", by)


def _correlated(ranked: DataFrame, x: str, y: str, weight: str, by: list[str]) -> DataFrame:
    """``by, n, rho, p`` of the ranks ``x`` and ``y``, each pair of which counts ``weight`` times."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    sums = ranked.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    n = F.col("n")
    spread = (n * F.col("saa") - F.col("sa") ** 2) * (n * F.col("sbb") - F.col("sb") ** 2)
    rho = F.when((n >= 3) & (spread > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(spread))))
    out = sums.select(*by, "n", rho.alias("rho"))
    return out.withColumn("p", p_of_r(F.col("rho"), F.col("n")))


def spearman_by_covariate(df: DataFrame, covariates: list[str], errors: list[str], ids: list[str]) -> DataFrame:
    """``covariate, error, n, rho, p`` for every covariate and error column.

    Equal rows are counted first, and each column is ranked once, not once for each pair.
    Ranks hold among complete pairs: a value counts, for each column it is paired with,
    the rows that have that one too.
    """
    names = [*covariates, *errors]
    own = [f"_v{i}" for i in range(len(names))]
    of = {i: range(len(covariates), len(names)) if i < len(covariates) else range(len(covariates)) for i in range(len(names))}
    rows = df.groupBy(*(F.col(c).alias(v) for c, v in zip(names, own))).agg(F.count("*").alias("_w"))
    # laid out anew, for a filter on one column would move below the count, and each column then count all rows for itself
    rows = rows.select(F.inline(F.array(F.struct(*own, "_w"))))
    ranked = rows
    for i, partners in of.items():
        held = [F.sum(F.when(F.col(own[j]).isNotNull(), F.col("_w")).otherwise(0)).alias(f"_n{j}") for j in partners]
        counts = rows.where(F.col(own[i]).isNotNull()).groupBy(own[i]).agg(*held)
        placed = running_total(counts, own[i], [f"_n{j}" for j in partners], [])
        places = F.array(*(F.col(f"before_{k}") + (F.col(f"_n{j}") + 1) / 2 for k, j in enumerate(partners)))
        ranked = ranked.join(placed.select(own[i], places.alias(f"_r{i}")), own[i], "left").drop(own[i])
    pairs = [
        F.struct(F.lit(c).alias("covariate"), F.lit(e).alias("error"), F.col(f"_r{i}")[j].alias("_x"), F.col(f"_r{len(covariates) + j}")[i].alias("_y"))
        for i, c in enumerate(covariates) for j, e in enumerate(errors)
    ]
    long = ranked.select("_w", F.inline(F.array(*pairs))).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    return _correlated(long, "_x", "_y", "_w", ["covariate", "error"])


def fisher_ci(df: DataFrame, r: str = "rho", n: str = "n") -> DataFrame:
    """Adds ``ci_low, ci_high`` (95 %, four pairs at least) and, if there is a p, ``significant``."""
    z, se = F.atanh(F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col(r)))), 1.959964 / F.sqrt(F.greatest(F.col(n) - 3, F.lit(1)))
    out = df.withColumn("ci_low", F.when(F.col(n) >= 4, F.tanh(z - se))).withColumn("ci_high", F.when(F.col(n) >= 4, F.tanh(z + se)))
    return out.withColumn("significant", F.col("p") < 0.05) if "p" in df.columns else out


def covariate_table(df: DataFrame, covariates: list[str], errors: list[str], ids: list[str]) -> DataFrame:
    """``covariate, error, n, rho, p, ci_low, ci_high, significant, mean, sd``: rank correlations, and each covariate's mean and spread over all rows that have it."""
    both = df.agg(*(f(c).alias(f"{name}_{i}") for i, c in enumerate(covariates) for name, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    rows = F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(f"mean_{i}").cast("double").alias("mean"), F.col(f"sd_{i}").alias("sd")) for i, c in enumerate(covariates)))
    spread = both.select(F.inline(rows))  # a row for each named covariate
    return fisher_ci(spearman_by_covariate(df, covariates, errors, ids)).join(F.broadcast(spread), "covariate")


def kruskal(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """``by, h, groups, n, p``: Kruskal-Wallis over the groups, corrected for ties."""
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = average_ranks(counts, "_v", by, "_c")
    ties = ranks.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("_ties"))
    sums = counts.join(ranks.select(*by, "_v", "rank"), [*by, "_v"]).groupBy(*by, group).agg(F.sum(F.col("_c") * F.col("rank")).alias("_r"), F.sum("_c").alias("_n"))
    per = sums.groupBy(*by).agg(F.sum(F.col("_r") ** 2 / F.col("_n")).alias("_s"), F.count("*").alias("groups"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_ties") / (n**3 - n))
    out = per.join(ties, by).select(*by, F.when((F.col("groups") > 1) & (F.col("_ties") < n**3 - n), h).alias("h"), "groups", "n")
    return out.withColumn("p", p_of_chi2(F.col("h"), (F.col("groups") - 1).cast("double")))
