"""Queries against their SQL where customers have more than five digits and rasters have gaps."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Customers of one to six digits, several with the same first five on one day; orders in two stretches with a gap between."""
    path = str(tmp_path_factory.mktemp("large"))
    day = lambda i: dt.datetime(1996, 1, 1) + dt.timedelta(days=i % 3)
    customers = [0, 7, 41, 12345, 99999, *range(101150, 101162)]
    orders = [(k, customers[k % len(customers)], "O", 1000.0 + 97 * k % 400000, day(k // 40), f"{k % 2 + 1}-X") for k in [*range(400), *range(20000, 20400)]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.range(400).select(F.col("id").alias("c_custkey")).write.parquet(f"{path}/customer.parquet")
    return path


def compare(spark, folder, name):
    df = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_key_build_equals_sql(spark, folder):
    compare(spark, folder, "key_build")


def test_key_parse_equals_sql(spark, folder):
    compare(spark, folder, "key_parse")


def test_pad_and_date_equals_sql(spark, folder):
    compare(spark, folder, "pad_and_date")


def test_found_images_equals_sql(spark, folder):
    compare(spark, folder, "found_images")


def test_zonal_fraction_equals_sql_over_gaps(spark, folder):
    compare(spark, folder, "zonal_fraction")
