"""Leave-one-group-out folds, stratified and equal-size samples, fingerprints.

A random choice is the order of md5(key:seed). The rows that make up a quota are found
in two steps, so that a stratum that holds most rows is never sorted in one task: rows
are counted by the first characters of their hash, whole ranges below the quota are in,
and only the range in which the quota falls is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldjobs.functions.bins import quantile_bins
from fieldjobs.operators.profile import hash_order

PREFIX = 2


def take_quota(df: DataFrame, by: list[str], quota: DataFrame, key: str, seed: int, few: bool = False) -> DataFrame:
    """Adds ``taken``: whether the row is among the first ``quota`` of its group in hash order (``quota`` has by, quota).

    ``few``: the ranges of all groups (256 each) may be sent to all tasks; only rows of the ranges that are ranked move.
    """
    hashed = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, PREFIX))
    ranges = hashed.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).join(quota, by)
    state = F.when(F.col("_before") + F.col("_c") <= F.col("quota"), "in").when(F.col("_before") >= F.col("quota"), "out").otherwise("part")
    ranges = ranges.select(*by, "_p", state.alias("_s"), (F.col("quota") - F.col("_before")).alias("_left"))
    placed = hashed.join(F.broadcast(ranges) if few else ranges, [*by, "_p"])
    rank = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key))
    part = placed.where("_s = 'part'").withColumn("taken", rank <= F.col("_left"))
    whole = placed.where("_s <> 'part'").withColumn("taken", F.col("_s") == "in")
    return whole.unionByName(part).drop("_h", "_p", "_s", "_left")


def downsample_by_group(df: DataFrame, group: str, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """n rows of each group; n is the smallest group's size, and a larger n than that raises."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n")).first()[0] or 0
    if n is not None and n > least:
        raise ValueError(f"n = {n} is more than the smallest group's {least} rows")
    quota = counts.select(group, F.lit(least if n is None else n).alias("quota"))
    return take_quota(df, [group], quota, key, seed).where("taken").drop("taken")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Every row once per group value (few), with ``fold`` and ``split``: test where it is its own group, else pool."""
    folds = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).collect()]
    out = df.withColumn("fold", F.explode(F.array(*map(F.lit, folds)) if folds else F.array().cast("array<string>")))
    return out.withColumn("split", F.when(F.col(group) == F.col("fold"), "test").otherwise("pool"))


def stratified_split(df: DataFrame, by: list[str], target: str, key: str, ratio: float = 0.15, bins: int = 5, seed: int = 42, few: bool = False) -> DataFrame:
    """Adds ``split`` (train/val): ceil(ratio * n) validation rows for each ``by``, spread over quantile bins of the target.

    Each bin gets the whole part of its share; what is left goes to the bins with the
    largest rests, lower bins first. ``few``: there are so few ``by`` that rows need not be
    shuffled by them.
    """
    binned = quantile_bins(df, target, bins, tuple(by), few=few).withColumn("bin", F.coalesce("bin", F.lit(-1)))
    sizes = binned.groupBy(*by, "bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    sizes = sizes.withColumn("_val", F.ceil(F.sum("_n").over(w) * ratio)).withColumn("_share", F.col("_val") * F.col("_n") / F.sum("_n").over(w))
    sizes = sizes.withColumn("_whole", F.floor("_share")).withColumn("_rest", F.round(F.col("_share") - F.col("_whole"), 9))
    extra = F.row_number().over(w.orderBy(F.desc("_rest"), "bin")) <= F.col("_val") - F.sum("_whole").over(w)
    quota = sizes.select(*by, "bin", (F.col("_whole") + extra.cast("long")).alias("quota"))
    out = take_quota(binned, [*by, "bin"], quota, key, seed, few)
    return out.withColumn("split", F.when(F.col("taken"), "val").otherwise("train")).drop("taken")


def split_report(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy("fold", "split").agg(F.count("*").alias("n"), F.min(target).alias("min"), F.max(target).alias("max"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("sd"))


def downsample_report(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """``group, original, kept`` and a total row."""
    a, b = (df.groupBy(F.col(group).cast("string").alias(group)).agg(F.count("*").alias(n)) for df, n in ((before, "original"), (after, "kept")))
    both = a.join(b, group, "left").na.fill(0, ["kept"])
    return both.unionByName(both.agg(F.sum("original").alias("original"), F.sum("kept").alias("kept")).select(F.lit("total").alias(group), "original", "kept"))


def fingerprint_tree(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """``prefix, n, digest``: of the rows whose MD5 begins with each ``digits`` hexadecimal digits, how many there are and a digest of them.

    A digest is made of sums of the rows' digests, so it depends on the rows (repeats
    included) and not on their order, and nothing that grows with the rows is held.
    """
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)))
    sums = [F.sum(F.conv(F.substring("r", i, 8), 16, 10).cast("decimal(20,0)")) for i in (1, 9, 17, 25)]
    whole = F.md5(F.concat_ws(":", F.count("*").cast("string"), *(s.cast("string") for s in sums)))
    return df.select(row.alias("r")).groupBy(F.substring("r", 1, digits).alias("prefix")).agg(F.count("*").alias("n"), whole.alias("digest"))


def fingerprint(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """One row, ``fingerprint``: a digest of the tree's digests (at most 16 to the power of ``digits``) in the order of their prefixes."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat(x["prefix"], x["digest"]))
    return fingerprint_tree(df, columns, digits).agg(F.md5(F.concat_ws("", parts)).alias("fingerprint"))


def fingerprint_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``prefix, n_a, n_b`` where two trees differ, in order; a prefix that one hasn't counts 0 there."""
    x, y = (t.select("prefix", F.col("n").alias(f"n_{side}"), F.col("digest").alias(f"digest_{side}")) for t, side in ((a, "a"), (b, "b")))
    both = x.join(y, "prefix", "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return both.select("prefix", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).orderBy("prefix")


def require_fingerprint(df: DataFrame, columns: list[str], expected: str, like: DataFrame | None = None) -> None:
    """Raise if the fingerprint is another; with the table it should be ``like``, the first prefix where they differ is named."""
    if (found := fingerprint(df, columns).first()[0]) == expected:
        return
    where = like and fingerprint_differences(fingerprint_tree(df, columns), fingerprint_tree(like, columns)).first()
    raise ValueError(f"fingerprint {found} is not {expected}" + (f"; they differ first at {where['prefix']}: {where['n_a']} rows against {where['n_b']}" if where else ""))
