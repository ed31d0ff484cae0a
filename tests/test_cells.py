"""Interval joins over windows of all lengths, and boxes of all sizes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldjobs.operators import intervals, raster

START = dt.datetime(2015, 1, 1)


def _times(n, seed):
    r = random.Random(seed)
    return [START + dt.timedelta(seconds=r.randrange(10 * 366 * 86400), microseconds=r.choice([0, 0, 1, 999_999])) for _ in range(n)]


def test_windows_of_a_second_and_of_ten_years(spark):
    r = random.Random(3)
    points = [(i, t, r.choice("xy")) for i, t in enumerate(_times(400, 1))]
    points += [(1000 + i, points[0][1], "x") for i in range(5)] + [(2000, None, "x")]
    spans = [dt.timedelta(0), dt.timedelta(seconds=1), dt.timedelta(minutes=20), dt.timedelta(days=1), dt.timedelta(days=400), dt.timedelta(days=3653)]
    windows = [(i, t, t + r.choice(spans), r.choice(["x", "y", None])) for i, t in enumerate([p[1] for p in points[:40]] + _times(80, 2))]
    windows += [(500, START, START + spans[-1], "x"), (501, START + spans[-1], START, "x"), (502, None, START, "x"), (503, START - spans[-1] * 6, START - spans[-1], "y")]
    p = spark.createDataFrame(points, "i int, at timestamp, k string")
    w = spark.createDataFrame(windows, "w int, s timestamp, e timestamp, k string")
    for keys in ((), ("k",)):
        want = sorted((b[0], a[0]) for a in points for b in windows if a[1] and b[1] and b[1] <= a[1] <= b[2] and (not keys or a[2] == b[3]))
        q = p if keys else p.drop("k")
        assert sorted((x["w"], x["i"]) for x in intervals.interval_join(q, w, "at", "s", "e", keys).collect()) == want
        left = sorted((x["w"], -1 if x["i"] is None else x["i"]) for x in intervals.interval_join(q, w, "at", "s", "e", keys, "left").collect())
        assert left == sorted(want + [(b[0], -1) for b in windows if b[0] not in {x for x, _ in want}])
        stats = intervals.window_stats(q, w, "at", "s", "e", ["w", "s"], "i", keys)
        assert {x["w"]: x["n"] for x in stats.collect()} == {b[0]: sum(x == b[0] for x, _ in want) for b in windows}


def test_a_window_makes_few_rows_and_its_points_are_dealt_out(spark):
    level = spark.range(1).select(F.ceil(F.log2(F.lit(3653 * 86400e6))).alias("level"))
    assert level.select(intervals._salts(F.col("level")) * 2).first()[0] <= 512
    p = spark.range(20_000).select((F.lit(START) + F.make_dt_interval(secs=F.col("id") * 10_000)).alias("at"), "id")
    w = spark.createDataFrame([(1, START, START + dt.timedelta(days=3653)), (2, START, START)], "w int, s timestamp, e timestamp")
    assert {x["w"]: x["count"] for x in intervals.interval_join(p, w, "at", "s", "e").groupBy("w").count().collect()} == {1: 20_000, 2: 1}


def test_empty_points_and_windows(spark):
    p, w = spark.createDataFrame([], "at timestamp, v double"), spark.createDataFrame([(1, START, START)], "w int, s timestamp, e timestamp")
    assert intervals.interval_join(p, w, "at", "s", "e").count() == 0
    assert [tuple(x) for x in intervals.window_stats(p, w, "at", "s", "e", ["w"], "v").collect()] == [(1, None, None, 0)]
    assert intervals.interval_join(p, w.limit(0), "at", "s", "e", how="left").count() == 0


def test_boxes_of_all_sizes(spark):
    r = random.Random(5)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, a, b = r.uniform(-500, 500), r.uniform(-500, 500), r.choice([0.0, 0.01, 3.0, 64.0, 300.0]), r.choice([0.5, 4.0, 100.0])
            out.append((i, "k" if i % 3 else "m", x, x + a, y, y + b))
        return out

    left, right = boxes(120), boxes(150)
    kind = "string, x1 double, x2 double, y1 double, y2 double"
    got = raster._overlapping(spark.createDataFrame(left, f"i int, k {kind}"), spark.createDataFrame(right, f"j int, k {kind}"), ["k"])
    want = [(a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5]]
    assert sorted((x["i"], x["j"]) for x in got.collect()) == sorted(want)


def test_one_huge_box_leaves_the_small_ones_apart(spark):
    kind = "k string, x1 double, x2 double, y1 double, y2 double"
    small = [(i, "k", x := float(i % 100) * 10, x + 1, y := float(i // 100) * 10, y + 1) for i in range(10_000)]
    left = spark.createDataFrame([*small, (-1, "k", 0.0, 1000.0, 0.0, 1000.0)], f"i int, {kind}")
    right = spark.createDataFrame([(a, k, x1 + 0.5, x2 + 0.5, y1, y2) for a, k, x1, x2, y1, y2 in small], f"j int, {kind}")
    assert raster._overlapping(left, right, ["k"]).count() == 20_000
    assert raster._candidates(left, right, ["k"]).count() < 60_000


def test_statistics_of_windows_make_no_pairs_and_equal_brute_force(spark, monkeypatch):
    import math
    import statistics

    monkeypatch.setattr(intervals, "interval_join", lambda *a, **b: pytest.fail("pairs of points and windows were made"))
    rnd = random.Random(8)
    start = dt.datetime(2024, 3, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    points = [(at(rnd.randrange(4000)), rnd.choice([None, 1e9 + rnd.random(), 1e9 + rnd.random()]), rnd.choice("xyz")) for _ in range(400)]
    lengths = [0, 1, 2, 3, 7, 64, 500, 1023, 1024, 3999, 10_000_000]
    windows = [(i % 60, at(a := rnd.randrange(-50, 4000)), at(a + rnd.choice(lengths)), rnd.choice(["x", "y", None])) for i in range(90)] + [(None, at(5), at(900), "y"), (99, at(9), at(3), "x"), (98, None, at(3), "x")]
    p = spark.createDataFrame(points, "at timestamp, v double, k string")
    w = spark.createDataFrame(windows, "w int, s timestamp, e timestamp, k string")
    for keys in ((), ("k",)):
        got = {r["w"]: (r["mean"], r["cv"], r["n"]) for r in intervals.window_stats(p, w, "at", "s", "e", ["w"], "v", keys, least=2).collect()}
        assert got.keys() == {x[0] for x in windows}
        for i, (mean, cv, n) in got.items():
            held = [v for j, s, e, k in windows if j == i and s and s <= e for t, v, c in points if v is not None and s <= t <= e and (not keys or c == k)]
            assert n == len(held) and (mean is None) == (cv is None) == (n < 2)
            if n > 1:
                assert math.isclose(mean, statistics.fmean(held), rel_tol=1e-15) and math.isclose(cv, statistics.stdev(held) / statistics.fmean(held), rel_tol=1e-6)
