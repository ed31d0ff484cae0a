"""Joins with checks inside their plan, bucketed tables, first metadata rows, covariate tables."""

import statistics

import pytest
from pyspark.sql import functions as F

from fieldjobs.operators import joins, ranks
from fieldjobs.sources import tables


def exchanges(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def jobs_of(spark, name, run) -> int:
    spark.sparkContext.setJobGroup(name, name)
    run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_checks_run_no_job_before_the_join(spark):
    a = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    b = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
    made = []
    assert jobs_of(spark, "build", lambda: made.append(joins.checked_join(a, b, ["k"]))) == 0
    assert jobs_of(spark, "run", made[0].collect) > 0
    assert made[0].count() == 100 and made[0].columns == ["k", "v", "w"]
    # null keys: one on the left stays when partners may be missing, two repeat; on the right they meet nothing
    nulls = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k long, x long")
    assert joins.checked_join(a, nulls, ["k"], all_found=False).where("x is not null").count() == 1
    assert joins.checked_join(nulls.where("x > 1"), a, ["k"], all_found=False).count() == 2
    with pytest.raises(Exception, match="repeated left keys"):
        joins.checked_join(nulls, a, ["k"], all_found=False).collect()
    with pytest.raises(Exception, match="rows without partner"):
        joins.checked_join(nulls.where("x > 1"), a, ["k"]).collect()
    assert joins.checked_join(a.where("false"), b, ["k"]).count() == 0


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        names = spark.range(2000).select(F.concat(F.lit("i"), "id").alias("image_filename"), "id")
        left = tables.write_bucketed(names.withColumnRenamed("id", "v"), "bucketed_left", ["image_filename"], 4, str(tmp_path / "l"))
        right = tables.write_bucketed(names.withColumnRenamed("id", "w"), "bucketed_right", ["image_filename"], 4)
        joined = joins.checked_join(left, right, ["image_filename"])
        assert joined.where("v = w").count() == 2000
        assert exchanges(joined) == 0 and exchanges(joins.join_covariates(left.select("image_filename", F.col("v").alias("actual"), F.col("v").alias("predicted")), right)[0]) == 0
        assert exchanges(joined.groupBy("image_filename").count()) == 0
        assert exchanges(joins.checked_join(names.withColumnRenamed("id", "v"), names, ["image_filename"])) == 2  # a shuffle a side, none for the checks
        twice = tables.write_bucketed(names.union(names), "bucketed_left", ["image_filename"], 4, str(tmp_path / "t"))
        with pytest.raises(Exception, match="repeated left keys"):
            joins.checked_join(twice, right, ["image_filename"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists bucketed_left")
        spark.sql("drop table if exists bucketed_right")


def test_first_metadata_row_of_each_name(spark):
    predictions = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), (None, 4.0)], "image_filename string, predicted double")
    meta = spark.createDataFrame([("a", 2, 20, "x"), ("a", 1, 10, "y"), ("a", 1, 10, "y"), (None, 0, 0, "z"), ("c", 1, None, "w")], "image_filename string, row int, signed_days_diff int, predicted string")
    both, lost = joins.join_metadata(predictions, meta, ["signed_days_diff"], ["row"])
    assert both.columns == ["image_filename", "predicted", "signed_days_diff"]
    assert sorted(map(tuple, both.collect())) == [("a", 1.0, 10), ("a", 2.0, 10)] and tuple(lost.first()) == (4, 2)
    empty, none = joins.join_metadata(predictions.where("false"), meta, ["signed_days_diff"], ["row"])
    assert empty.count() == 0 and tuple(none.first()) == (0, 0)


def test_covariate_table_has_mean_and_spread(spark):
    rows = [(f"f{i}", float(i), float(i * i % 7), None if i == 3 else i / 2) for i in range(9)]
    df = spark.createDataFrame(rows, "flight_key string, mae double, dpi double, agdd double")
    got = {r["covariate"]: r for r in ranks.covariate_table(df, ["dpi", "agdd"], ["mae"], ["flight_key"]).collect()}
    for i, c in ((2, "dpi"), (3, "agdd")):
        own = [r[i] for r in rows if r[i] is not None]
        assert got[c]["mean"] == pytest.approx(statistics.mean(own)) and got[c]["sd"] == pytest.approx(statistics.stdev(own)) and got[c]["n"] == len(own)
    assert got["agdd"]["rho"] == pytest.approx(1) and got["agdd"]["significant"] and got["dpi"]["ci_low"] < got["dpi"]["rho"] < got["dpi"]["ci_high"]
