"""The three workloads, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldjobs.functions import solar
from fieldjobs.functions.keys import build_image_key, days_since, parse_image_key, with_errors
from fieldjobs.operators import intervals, joins, metrics, ranks, raster
from fieldjobs.sources.files import flight_rasters, raster_inventory
from fieldjobs.sources.tables import ZONE


def flight_covariates(flights: DataFrame, minutes: DataFrame, increments: DataFrame, planting: DataFrame, inoculation: DataFrame, fields: DataFrame, zone: str = ZONE) -> DataFrame:
    """One row per flight: sun, light, growth. ``fields``: field, latitude, longitude, row_azimuth (small, as are the date tables).

    Flights come with UTC ``flight_start, flight_end``; absent look-ups leave nulls.
    """
    middle = F.timestamp_micros(((F.unix_micros("flight_start") + F.unix_micros("flight_end")) / 2).cast("long"))
    base = flights.join(fields, "field", "left").join(planting, "field", "left").join(inoculation, "year", "left").withColumn("_at", middle)
    zenith, azimuth = solar.solar_position(F.col("_at"), F.col("latitude"), F.col("longitude"))
    base = base.withColumns({
        "sza": zenith, "sun_azimuth": azimuth, "abs_time_from_noon": solar.minutes_from_noon(F.col("_at"), F.col("longitude"), zone, F.col("latitude")),
        "dpi": days_since(F.col("flight_date"), F.col("inoculation_date")),
    })
    base = base.withColumn("shadow_row_angle", solar.shadow_row_angle(F.col("sun_azimuth"), F.col("row_azimuth")))
    light = intervals.window_stats(minutes, flights.select("flight_key", "flight_start", "flight_end"), "at", "flight_start", "flight_end", ["flight_key"], "radiation")
    light = light.select("flight_key", F.col("mean").alias("irradiance_mean"), F.col("cv").alias("irradiance_cv"), F.col("n").alias("irradiance_n"))
    spans = flights.join(planting, "field", "left").select("flight_key", "planting_date", "flight_date")
    growth = intervals.range_sum(increments, spans, "date", "gdd", "planting_date", "flight_date").select("flight_key", F.col("total").alias("agdd"))
    out = joins.assemble_covariates(base, light, growth)
    return out.select("flight_key", "flight_date", "field", "year", "flight_start", "flight_end", "sza", "sun_azimuth", "abs_time_from_noon", "irradiance_mean", "irradiance_cv", "irradiance_n", "dpi", "agdd", "row_azimuth", "shadow_row_angle")


def image_covariates(labels: DataFrame, files: DataFrame, pixels: DataFrame, weeds: DataFrame) -> DataFrame:
    """One row per distinct label image: pixel metrics by lower-case name (null without file) and the weed fraction."""
    names = parse_image_key(labels.select("image_filename").distinct()).withColumn("basename", F.lower("image_filename"))
    found = names.join(files.select("basename").distinct(), "basename", "left_semi").select("image_filename", "basename").join(pixels.drop("origin"), "basename")
    out = names.join(found.select("image_filename", "sf_illuminorm", "mean_brightness", "contrast_rms"), "image_filename", "left")
    out = joins.checked_join(out, weeds.select("image_filename", "frac_weed"), ["image_filename"], all_found=False)
    return out.select("image_filename", F.col("flight_key").alias("flight_id"), "field", "frac_weed", "sf_illuminorm", "mean_brightness", "contrast_rms")


def weed_fractions(listing: DataFrame, tiles: DataFrame, polygons: DataFrame, own_years: tuple[int, ...] = (), field: str | None = None) -> DataFrame:
    """``image_filename, dtm_strategy, px_valid, px_weed, frac_weed`` of every plot of every flight, from the list of raster files.

    ``tiles`` holds the rasters' tiles, ``raster_id`` being the file's path. Flights
    without a surface, or without any terrain of their season, give no row.
    """
    flights = flight_rasters(raster.latest_file(raster_inventory(listing, field), ("flight_folder", "field", "flight_date", "year", "kind")))
    flights = raster.assign_reference(flights, own_years).where("dsm_path is not null and ref_dtm_path is not null")
    heights = raster.canopy_height(tiles, tiles, flights.select(F.col("dsm_path").alias("surface_id"), F.col("ref_dtm_path").alias("terrain_id"), "field"), polygons)
    of = flights.select(F.col("dsm_path").alias("raster_id"), "field", "flight_date", "dtm_strategy")
    out = raster.zonal(heights, polygons, of).join(of, ["raster_id", "field"])
    return out.select(build_image_key(F.col("flight_date"), F.col("field"), F.col("plot")).alias("image_filename"), "dtm_strategy", "px_valid", "px_weed", "frac_weed")


def prediction_metrics(predictions: DataFrame) -> DataFrame:
    """Errors, then metrics per fold and over all folds, with the rank correlation."""
    rows = with_errors(predictions).where("actual is not null and predicted is not null").withColumn("fold", F.col("fold").cast("string"))
    both = rows.select("actual", "predicted", F.explode(F.array("fold", F.lit("all_folds"))).alias("fold"))
    rho = ranks.spearman(both, "actual", "predicted", ["fold"]).select("fold", F.col("rho").alias("spearman_rho"))
    return metrics.regression_metrics(rows, "fold", total="all_folds").join(rho, "fold", "left")


def error_by_covariate(flight_errors: DataFrame, covariates: DataFrame, names: list[str]) -> DataFrame:
    """Rank correlation of flight errors with covariates, with confidence intervals and each covariate's mean and SD."""
    both = flight_errors.join(covariates.select("flight_key", *names), "flight_key", "left")
    return ranks.covariate_table(both, names, ["mae", "mean_signed_error"], ["flight_key"])
