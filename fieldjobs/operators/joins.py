"""Joins with checks, existence, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Extensions tried, in this order, when an image is not there under its own name.
EXTENSIONS = ("tif", "tiff", "jpg", "jpeg", "png")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """One row: ``n_duplicates``, the rows beyond the first of each key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def _once(df: DataFrame, on: list[str], what: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``df``, which raises when a row repeats the values ``on`` and ``within``.

    The check is a filter over rows sorted by ``on``, as the join on these columns wants
    them, so it needs no shuffle of its own; and as a filter it stays when columns are pruned.
    """
    if within:
        own = F.struct(*within)
        again = F.lag(own).over(Window.partitionBy(*on).orderBy(*within)).eqNullSafe(own)
    else:
        again = F.row_number().over(Window.partitionBy(*on).orderBy(*on)) > 1
    message = F.concat(F.lit(f"repeated {what} keys: "), F.to_json(F.struct(*on, *within)))
    return df.withColumn("_again", again).where(F.when(F.col("_again"), F.raise_error(message)).otherwise(F.lit(True))).drop("_again")


def _all_found(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a left join without their mark ``_met``; raises where it is null."""
    message = F.concat(F.lit("rows without partner: "), F.to_json(F.struct(*keys)))
    return joined.where(F.when(F.col("_met").isNull(), F.raise_error(message)).otherwise(F.lit(True))).drop("_met")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], all_found: bool = True) -> DataFrame:
    """Left join, one to one; raises if a key repeats on either side or, with ``all_found``, a left row has no partner.

    The checks are part of the plan: no job runs before the join, and a bad row raises
    ``SparkRuntimeException`` when the result is computed, naming its key. On the left,
    null keys equal each other and have no partner; on the right they meet nothing and
    aren't checked.
    """
    right = _once(right.dropna(subset=keys), keys, "right")
    if not all_found:
        return _once(left, keys, "left").join(right, keys, "left")
    return _all_found(_once(left, keys, "left").join(right.withColumn("_met", F.lit(True)), keys, "left"), keys)


def compile_predictions(predictions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Predictions with date, field and plot of the test metadata, in the order of the combined table.

    A name occurs once for each model and fold, and once in the metadata; else, or where
    a prediction has no metadata, the result raises when it is computed.
    """
    key = ["image_filename"]
    meta = _once(metadata.select(*key, "date", "field", "plot").dropna(subset=key), key, "right").withColumn("_met", F.lit(True))
    out = _all_found(_once(predictions, key, "left", ("model", "fold")).join(meta, key, "left"), key)
    return out.select("model", "fold", "test_year", "image_filename", "date", "field", "plot", "actual", "predicted", "signed_error", "abs_error")


def join_metadata(predictions: DataFrame, metadata: DataFrame, columns: list[str], order: list[str], key: str = "image_filename") -> tuple[DataFrame, DataFrame]:
    """Predictions with ``columns`` of their key's first metadata row; and one row: ``n_predictions, n_lost``, those without.

    First is the smallest by ``order``, then by the columns themselves. It is found by a
    minimum, so a key that very many rows repeat is reduced before it moves. Null keys
    meet nothing.
    """
    first = metadata.dropna(subset=[key]).groupBy(key).agg(F.min(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate([*order, *columns])))).alias("_first"))
    both = predictions.join(first, key, "left")
    lost = both.agg(F.count("*").alias("n_predictions"), F.count_if(F.col("_first").isNull()).alias("n_lost"))
    own = [F.col("_first").getField(f"_{len(order) + i}").alias(c) for i, c in enumerate(columns)]
    return both.where("_first is not null").select(*predictions.columns, *own), lost


def join_covariates(predictions: DataFrame, covariates: DataFrame, key: str = "image_filename") -> tuple[DataFrame, DataFrame]:
    """Predictions with errors and their image's covariates; and one row: ``n_predictions, n_lost``, those without covariates."""
    if "signed_error" not in predictions.columns:
        predictions = predictions.withColumn("signed_error", F.col("predicted") - F.col("actual"))
    predictions = predictions.withColumn("abs_error", F.abs("signed_error"))
    known = covariates.select(key).distinct().withColumn("_known", F.lit(True))
    lost = predictions.join(known, key, "left").agg(F.count("*").alias("n_predictions"), F.count_if(F.col("_known").isNull()).alias("n_lost"))
    return predictions.join(covariates, key), lost


def filter_existing(labels: DataFrame, files: DataFrame, name: str = "image_filename") -> tuple[DataFrame, DataFrame]:
    """Labels whose image is there (exact name, else another extension), with ``found_name``; and those without."""
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    candidates = F.array(F.col(name), *(F.concat("_base", F.lit(f".{e}")) for e in EXTENSIONS))
    there = files.groupBy(base("basename").alias("_base")).agg(F.collect_set("basename").alias("_there"))
    tried = labels.withColumn("_base", base(name)).join(there, "_base", "left")
    tried = tried.withColumn("found_name", F.get(F.filter(candidates, lambda c: F.array_contains("_there", c)), F.lit(0)))
    own = [name, *(c for c in labels.columns if c != name)]
    return tried.where("found_name is not null").select(*own, "found_name"), tried.where("found_name is null").select(*labels.columns)


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def filter_complete(labels: DataFrame, report: DataFrame, path: str = "image_path") -> DataFrame:
    """Labels whose image a report calls valid; a path reported twice counts once."""
    return labels.join(report.where("is_valid").select(path).distinct(), path, "left_semi")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows, repeats included, without partner."""
    return left.join(right, keys, "left_anti")


def union_folds(parts: dict[str, DataFrame], column: str = "fold", only: tuple[str, ...] = ()) -> DataFrame:
    out = None
    for name, df in parts.items():
        if not only or name in only:
            df = df.withColumn(column, F.lit(name))
            out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no fold is selected")
    return out


def assemble_covariates(flights: DataFrame, *sections: DataFrame, key: str = "flight_key") -> DataFrame:
    """All flights with every section's columns; each section has one row a flight."""
    for s in sections:
        flights = flights.join(s, key, "left")
    return flights


def long_errors(df: DataFrame, ids: list[str], errors: list[str]) -> DataFrame:
    return df.unpivot(ids, errors, "error_type", "error")
