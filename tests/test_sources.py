"""Readers and the sink, on files written to a temporary folder."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldjobs.plans import jobs
from fieldjobs.sources import files, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_read_labels(spark, tmp_path):
    path = put(tmp_path / "labels.csv", " Image_Filename ,Year,Score,Date,Plot\na.jpg,2024,3.5,6/1/24,7\nb.jpg,2024,,2024-06-02,8\nc.jpg,2023,n/a,x,9\nd.jpg,2023,4,bad,none\n")
    got = tables.read_labels(spark, path).select("image_filename", "year", "score", "date", "plot")
    assert rows(got) == [("a.jpg", 2024, 3.5, dt.date(2024, 6, 1), 7), ("d.jpg", 2023, 4.0, None, None)]
    with pytest.raises(ValueError, match="score"):
        tables.read_labels(spark, put(tmp_path / "bad.csv", "image_filename,year\na,1\n"))


def test_read_flights_and_minutes(spark, tmp_path):
    path = put(tmp_path / "flights.csv", "flight_key,flight_start,flight_end\n20240601_b7a,6/1/24 9:05,6/1/24 9:20\n20240310_B8,3/10/24 2:30,3/10/24 3:30\n")
    got = {r["flight_key"]: r for r in tables.read_flights(spark, path).collect()}
    one = got["20240601_b7a"]
    assert (one["flight_date"], one["field"], one["year"]) == (dt.date(2024, 6, 1), "B7A", 2024)
    assert (one["flight_start"], one["flight_end"]) == (dt.datetime(2024, 6, 1, 13, 5), dt.datetime(2024, 6, 1, 13, 20))
    assert got["20240310_B8"]["flight_start"] is None and got["20240310_B8"]["flight_end"] == dt.datetime(2024, 3, 10, 7, 30)
    path = put(tmp_path / "minutes.csv", "DateTime,Radiation(W/m2)\n6/1/2024 9:05,512.5\n2024-06-01 09:06:00,NaN\n11/3/24 1:30,5\nnever,1\n")
    assert rows(tables.read_minutes(spark, path)) == [(dt.datetime(2024, 6, 1, 13, 5), 512.5), (dt.datetime(2024, 6, 1, 13, 6), None)]


def test_read_increments_dates_and_ratings(spark, tmp_path):
    assert rows(tables.read_increments(spark, put(tmp_path / "g.csv", "Date,GDD\n6/1/24,12.5\n2024-06-02,x\n,3\n"))) == [(dt.date(2024, 6, 1), 12.5), (dt.date(2024, 6, 2), None)]
    assert rows(tables.read_reference_dates(spark, put(tmp_path / "p.csv", "field,planting_date\nb7a,5/1/24\n"), "field", "planting_date")) == [("B7A", dt.date(2024, 5, 1))]
    assert rows(tables.read_reference_dates(spark, put(tmp_path / "i.csv", "year,inoculation_date\n2024,2024-06-20\n"), "year", "inoculation_date")) == [(2024, dt.date(2024, 6, 20))]
    assert rows(tables.read_ratings(spark, put(tmp_path / "r.csv", "plot,rater,score\n1,2,3.5\n1,3,missing\n"))) == [(1, 2, 3.5), (1, 3, None)]


def test_read_predictions_and_runs(spark, tmp_path):
    for year, text in (("23", "a.jpg,1,1.5\n"), ("2024", "b.jpg,2,nan\n")):
        put(tmp_path / "pred" / f"fold_{year}" / "test.csv", "image_filename,actual,predicted\n" + text) if year == "23" else put(tmp_path / "pred" / "x" / f"test_fold{year}.csv", "image_filename,actual,predicted\n" + text)
    assert rows(tables.read_predictions(spark, str(tmp_path / "pred"))) == [("a.jpg", 1.0, 1.5, 2023), ("b.jpg", 2.0, None, 2024)]
    for model in ("eva", "swin"):
        put(tmp_path / "runs" / f"{model}_cv0" / "cv_results.csv", "fold,test_r2\n2023,0.5\n")
        put(tmp_path / "runs" / f"{model}_cv0" / "fold_2024" / "summary.json", json.dumps({"mean": 1.5, "model": model}))
        put(tmp_path / "runs" / f"{model}_cv0" / "history_fold24.csv", "epoch,val\n1,0.1\n")
    assert rows(tables.read_runs(spark, str(tmp_path / "runs")).select("source_model", "fold", "test_r2")) == [("eva", 2023, 0.5), ("swin", 2023, 0.5)]
    assert rows(tables.read_runs(spark, str(tmp_path / "runs"), "summary.json").select("source_model", "model", "mean")) == [("eva", "eva", 1.5), ("swin", "swin", 1.5)]
    assert rows(tables.read_runs(spark, str(tmp_path / "runs"), "history_*.csv").select("source_model", "fold", "epoch")) == [("eva", 2024, 1), ("swin", 2024, 1)]


def test_write_table(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.23456, 2)], "k string, x double, n int")
    tables.write_table(df, str(tmp_path / "out"), "csv", ["n", "x"], 2)
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect()[0][:] == ("2", "1.23")
    tables.write_table(df, str(tmp_path / "pq"), partition_by=("k",))
    tables.write_table(df, str(tmp_path / "pq"), partition_by=("k",))
    assert rows(spark.read.parquet(str(tmp_path / "pq")).select("k", "n")) == [("b", 2)]


def test_images_are_indexed_and_read(spark, tmp_path):
    from base64 import b64decode

    # one red pixel, as PNG
    png = b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAIAAACQd1PeAAAADElEQVR4nGP4z8AAAAMBAQDJ/pLvAAAAAElFTkSuQmCC")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.JPG").write_bytes(png)
    (tmp_path / "a" / "y.jpeg").write_bytes(b"no image")
    (tmp_path / "a" / "z.txt").write_bytes(b"")
    assert [r["basename"] for r in files.index_images(spark, str(tmp_path)).orderBy("basename").collect()] == ["x.jpg", "y.jpeg"]
    got = {r["basename"]: r["image"] for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got["y.jpeg"] is None and (got["x.jpg"]["height"], got["x.jpg"]["nChannels"]) == (1, 3) and bytes(got["x.jpg"]["data"])[2] > 200


LISTED = [
    "/orthodata/b7a/DJI_20240601_1/out/f_20240601_20240605T1200_dsm.tif", "/orthodata/b7a/DJI_20240601_1/out/f_20240601_20240604T1300_dsm.tif", "/orthodata/b7a/DJI_20240601_1/out/f_20240603T0900_DTM.tif",
    "/orthodata/b7a/DJI_20240701_1/out/g_dsm.tif", "/orthodata/b7a/DJI_20240701_1/out_CC_1/g_20250101T0000_dsm.tif", "/orthodata/b7a/DJI_20240701_1/multispectral/h_dsm.tif", "/orthodata/b7a/other/x_dsm.tif", "/orthodata/b8/DJI_20240702_1/out/z_dsm.tif",
    "/orthodata/b7a/DJI_20240601_1/out/f_20240601_20240609T1200_dsm_hillshade.tif", "/orthodata/b7a/DJI_20240601_1/out/dsm_colours.tif",
]


def test_raster_job_from_file_list_to_weed_fraction(spark):
    at = dt.datetime(2024, 8, 1)
    listing = spark.createDataFrame([(p, at) for p in LISTED], "path string, modificationTime timestamp")
    inventory = files.raster_inventory(listing)
    assert {r["path"] for r in inventory.collect()} == {LISTED[i] for i in (0, 1, 2, 3, 7)}
    assert files.raster_inventory(listing, "B8").count() == 1
    ground = lambda y, x: 10 + 0.1 * x + 0.05 * y
    tiles = []

    def cut(name, dx, height, size, x0=0.0):
        n = int(32 / dx)
        y, x = np.meshgrid((np.arange(n) + 0.5) * dx, x0 + (np.arange(n) + 0.5) * dx, indexing="ij")
        a = ground(y, x) + height(y, x)
        for r in range(0, n, size):
            for c in range(0, n, size):
                part = a[r : r + size, c : c + size]
                tiles.append((name, r // size, c // size, x0 + c * dx, r * dx, dx, dx, *part.shape, None, part.ravel().tolist()))

    cut(LISTED[2], 0.5, lambda y, x: 0.0, 8)
    cut(LISTED[0], 1.0, lambda y, x: np.where(x < 16, 1.0, 3.0), 4, -0.25)
    cut(LISTED[3], 0.25, lambda y, x: 0.0 * x, 16)
    kind = "raster_id string, tile_r int, tile_c int, x0 double, y0 double, dx double, dy double, h int, w int, nodata float, pixels array<float>"
    rings = [("B7A", 1, 2, 2, 12, 8), ("B7A", 2, 10, 10, 22, 20), ("B7A", 3, 20, 2, 28, 8), ("B7A", 4, 60, 60, 70, 70), ("B8", 1, 2, 2, 12, 8)]
    plots = spark.createDataFrame([(f, n, [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]) for f, n, a, b, c, d in rings], "field string, plot int, ring array<struct<x: double, y: double>>")
    got = {r["image_filename"]: r for r in jobs.weed_fractions(listing, spark.createDataFrame(tiles, kind), plots).collect()}
    assert sorted(got) == [f"{d}_B7A_0000{n}.jpg" for d in ("20240601", "20240701") for n in (1, 2, 3)]
    # terrain pixels of half a unit: 20 x 12, 24 x 20 and 16 x 12 of them; surface read across its tiles' borders
    assert [(got[f"20240601_B7A_0000{n}.jpg"]["px_valid"], got[f"20240601_B7A_0000{n}.jpg"]["px_weed"]) for n in (1, 2, 3)] == [(240, 240), (480, 240), (192, 0)]
    assert got["20240601_B7A_00001.jpg"]["dtm_strategy"] == "earliest_self" and got["20240701_B7A_00001.jpg"]["dtm_strategy"] == "earliest" and got["20240701_B7A_00002.jpg"]["frac_weed"] == 0.0


def test_image_covariates_job(spark):
    labels = spark.createDataFrame([("20240601_B7A_00001.jpg",), ("20240601_B7A_00001.jpg",), ("20240601_B7A_00002.jpg",)], "image_filename string")
    found = spark.createDataFrame([("20240601_b7a_00001.jpg",)], "basename string")
    pixels = spark.createDataFrame([("o", "20240601_b7a_00001.jpg", 0.25, 100.0, 9.0)], "origin string, basename string, sf_illuminorm double, mean_brightness double, contrast_rms double")
    weeds = spark.createDataFrame([("20240601_B7A_00002.jpg", 0.5)], "image_filename string, frac_weed double")
    assert rows(jobs.image_covariates(labels, found, pixels, weeds)) == [("20240601_B7A_00001.jpg", "20240601_B7A", "B7A", None, 0.25, 100.0, 9.0), ("20240601_B7A_00002.jpg", "20240601_B7A", "B7A", 0.5, None, None, None)]


def test_flight_covariates_and_errors(spark, tmp_path):
    flights = tables.read_flights(spark, put(tmp_path / "f.csv", "flight_key,flight_start,flight_end\n20240601_B7A,6/1/24 13:00,6/1/24 13:20\n20240608_B7A,6/8/24 13:00,6/8/24 13:20\n20240608_ZZ,6/8/24 13:00,6/8/24 13:20\n"))
    start = dt.datetime(2024, 6, 1, 17)
    minutes = spark.createDataFrame([(start + dt.timedelta(minutes=i), 500.0 + i) for i in range(-5, 40)], "at timestamp, radiation double")
    growth = spark.createDataFrame([(dt.date(2024, 5, 1) + dt.timedelta(days=i), 10.0) for i in range(60)], "date date, gdd double")
    planting = spark.createDataFrame([("B7A", dt.date(2024, 5, 10))], "field string, planting_date date")
    inoculation = spark.createDataFrame([(2024, dt.date(2024, 5, 30))], "year int, inoculation_date date")
    fields = spark.createDataFrame([("B7A", 35.665, -78.495, 20.0)], "field string, latitude double, longitude double, row_azimuth double")
    out = jobs.flight_covariates(flights, minutes, growth, planting, inoculation, fields)
    got = {r["flight_key"]: r for r in out.collect()}
    one, other, unknown = got["20240601_B7A"], got["20240608_B7A"], got["20240608_ZZ"]
    assert (one["irradiance_mean"], one["irradiance_n"], one["dpi"], one["agdd"]) == (510.0, 21, 2, 230.0)
    assert (other["irradiance_mean"], other["irradiance_n"], other["agdd"]) == (None, 0, 300.0) and unknown["sza"] is None and unknown["agdd"] is None
    assert abs(one["sza"] - 13.9) < 0.7 and one["abs_time_from_noon"] < 5 and 0 <= one["shadow_row_angle"] <= 90
    errors = spark.createDataFrame([(k, float(i), -float(i)) for i, k in enumerate(got)], "flight_key string, mae double, mean_signed_error double")
    table = jobs.error_by_covariate(errors, out, ["dpi", "agdd"])
    assert {(r["covariate"], r["error"], r["n"]) for r in table.collect()} >= {("dpi", "mae", 3), ("agdd", "mae", 2)}


def test_noon_is_the_highest_minute(spark):
    from fieldjobs.functions import solar

    days = [dt.datetime(2024, m, d, 16, 0) for m, d in ((1, 5), (3, 10), (6, 21), (11, 3), (12, 31))]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    zone = "America/New_York"
    got = {r[0]: r[1] for r in df.select("ts", solar.minutes_from_noon(F.col("ts"), F.lit(solar.LONGITUDE), zone)).collect()}
    day = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp("ts", zone)), zone)
    grid = df.select("ts", F.explode(F.sequence(day, day + F.expr("interval 1439 minutes"), F.expr("interval 1 minute"))).alias("at"))
    best = grid.select("ts", "at", solar.elevation(F.col("at"), F.lit(solar.LATITUDE), F.lit(solar.LONGITUDE))[0].alias("h")).groupBy("ts").agg(F.max_by("at", F.struct("h", -F.unix_micros("at"))).alias("at"))
    assert {r["ts"]: abs((r["ts"] - r["at"]).total_seconds()) / 60 for r in best.collect()} == {k: round(v, 6) for k, v in got.items()}
