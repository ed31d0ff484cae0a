"""Statistics against golden rows and against densities integrated by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from fieldjobs.functions import bins
from fieldjobs.operators import intervals, joins, metrics, model, pixels, profile, ranks, splits, stats

#: How often each half step from 1 to 9 was scored, and what a smooth density expects.
OBSERVED = [155, 1027, 1446, 552, 1624, 581, 2777, 677, 2849, 1581, 2396, 1237, 2668, 2402, 2601, 1422, 76]
EXPECTED = [398.91, 932.05, 1063.18, 1069.78, 1162.57, 1387.09, 1652.17, 1774.68, 1962.11, 2022.51, 1952.64, 1972.23, 2222.75, 2370.53, 2108.3, 1474.07, 545.43]


def tail(density, x, far, steps=400_001):
    """The upper tail of a density beyond x."""
    grid = np.linspace(x, far, steps)
    y = density(grid)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(grid)).sum())


def t_two_sided(t, df):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * (tail(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0.0, abs(t)))


def chi2_upper(x, df):
    c = 1 / (2 ** (df / 2) * math.gamma(df / 2))
    return tail(lambda v: c * v ** (df / 2 - 1) * np.exp(-v / 2), x, x + 400)


def test_expected_scores_and_chi_square(spark):
    counts = spark.createDataFrame([(1 + i / 2, n) for i, n in enumerate(OBSERVED)], "score double, observed long")
    table = stats.expected_scores(counts)
    got = [r["expected"] for r in table.orderBy("score").collect()]
    assert math.isclose(sum(got), sum(OBSERVED)) and all(math.isclose(a, b, rel_tol=0.15, abs_tol=60) for a, b in zip(got, EXPECTED))
    one = stats.chi_square(table).first()
    want = sum((o - e) ** 2 / e for o, e in zip(OBSERVED, got))
    assert math.isclose(one["chi2"], want) and one["df"] == 16 and one["p"] < 1e-12
    even = stats.chi_square(spark.createDataFrame([(10, 12.0), (14, 12.0), (12, 12.0)], "observed long, expected double")).first()
    assert math.isclose(even["p"], chi2_upper(even["chi2"], 2), abs_tol=1e-6)


def test_p_values_of_correlations(spark):
    r = random.Random(4)
    data = [("a", x := r.random(), x + r.random(), r.choice("uvw")) for _ in range(40)] + [("b", r.random(), r.random(), r.choice("uvw")) for _ in range(25)]
    df = spark.createDataFrame(data, "g string, x double, y double, k string")
    place = lambda v: np.argsort(np.argsort(v))
    for made, change, name in ((stats.pearson(df, "x", "y", ["g"]), np.asarray, "r"), (ranks.fisher_ci(ranks.spearman(df, "x", "y", ["g"])), place, "rho")):
        for row in made.collect():
            x, y = (change([d[i] for d in data if d[0] == row["g"]]) for i in (1, 2))
            rho, n = float(np.corrcoef(x, y)[0, 1]), len(x)
            p = t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
            assert row["n"] == n and math.isclose(row[name], rho) and math.isclose(row["p"], p, abs_tol=1e-6)
            if name == "rho":
                z, se = math.atanh(rho), 1.959964 / math.sqrt(n - 3)
                assert math.isclose(row["ci_low"], math.tanh(z - se)) and math.isclose(row["ci_high"], math.tanh(z + se)) and row["significant"] == (p < 0.05)
    for row in ranks.kruskal(df, "x", "k", ["g"]).collect():
        assert math.isclose(row["p"], chi2_upper(row["h"], row["groups"] - 1), abs_tol=1e-6)


def test_one_sample_t_and_agreement(spark):
    row = metrics.one_sample_t(spark.createDataFrame([(0.5, 1.2, 20)], "mean_signed_error double, std_signed_error double, n long")).first()
    assert math.isclose(row["t"], 0.5 / (1.2 / math.sqrt(20))) and math.isclose(row["p"], t_two_sided(row["t"], 19), abs_tol=1e-6)
    pairs = spark.createDataFrame([(1, 2, 30, 0.8, 0.0001), (1, 3, 30, 0.2, 0.3)], "a int, b int, n long, r double, p double")
    models = spark.createDataFrame([(1, 30, 0.9, 0.02)], "rater int, n long, r double, p double")
    got = {r["what"]: (r["r"], r["stars"]) for r in stats.agreement_table(pairs, models).collect()}
    assert got == {"1-2": (0.8, "***"), "1-3": (0.2, "ns"), "model-1": (0.9, "*"), "rater-rater": (0.5, None), "model-rater": (0.9, None), "difference": (pytest.approx(0.4), None)}


def test_icc_interval_of_a_published_example(spark):
    """Six subjects and four judges: the often printed example, ICC(2,1) = 0.29 (0.02 to 0.76)."""
    scores = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    r = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(scores) for j, v in enumerate(row)] + [(9, 0, 1.0)], "plot int, rater int, score double")
    got = stats.icc(r, 4).first()
    assert (got["n"], got["k"], round(got["icc"], 2), got["reliability"]) == (6, 4, 0.29, "poor")
    assert math.isclose(got["ci_low"], 0.019, abs_tol=2e-3) and math.isclose(got["ci_high"], 0.761, abs_tol=2e-3)


def test_prepare_and_restore(spark):
    r = np.random.default_rng(1)
    rgb = r.integers(0, 256, (6, 6, 3), dtype=np.uint8)
    gray = r.integers(0, 256, (6, 6, 1), dtype=np.uint8)
    two = np.concatenate([gray, 255 - gray], 2)
    wide = (gray.astype("<u2") << 8 | 7).tobytes()
    rows = [("rgb", 3, rgb[:, :, ::-1].tobytes()), ("gray", 1, gray.tobytes()), ("two", 2, two.tobytes()), ("wide", 1, wide), ("none", 1, None)]
    df = spark.createDataFrame([(o, o, (6, 6, c, bytearray(d)) if d is not None else None) for o, c, d in rows], "origin string, basename string, image struct<height: int, width: int, nChannels: int, data: binary>")
    same = {r["origin"]: r["tensor"] for r in pixels.prepare_images(df, 6).collect()}
    mean, sd = np.array(pixels.MEAN)[:, None, None], np.array(pixels.SD)[:, None, None]
    want = {"rgb": rgb.transpose(2, 0, 1), **{k: np.repeat(gray.transpose(2, 0, 1), 3, 0) for k in ("gray", "two", "wide")}}
    assert set(same) == set(want) and all(np.allclose(same[k], ((want[k] / 255 - mean) / sd).ravel(), atol=1e-5) for k in want)
    back = {r["origin"]: r["pixels"] for r in pixels.restore(pixels.prepare_images(df, 6)).collect()}
    assert all(back[k] == want[k].ravel().tolist() for k in want)
    crop = {r["origin"]: r["tensor"] for r in pixels.prepare_images(df, 12, 4).collect()}
    assert all(len(v) == 3 * 16 for v in crop.values())
    halves = pixels.resized(np.array([[[0.0], [10.0]]]), 1, 4)[0, :, 0]
    assert halves.tolist() == [0.0, 2.5, 7.5, 10.0]


def test_shadow_fraction_and_unusable_images():
    a = np.full((10, 10, 3), 200, np.uint8)
    a[:2] = 40
    a[9] = 250
    mean, shadow, contrast, white, valid, reason = pixels.measure(a)
    assert (round(mean, 4), round(shadow, 4), white, valid, reason) == (round((20 * 40 + 70 * 200) / 90, 4), round(20 / 90, 4), 0.1, False, "partially_oob_white") and contrast > 0
    assert pixels.measure(a, 40)[1] == 0.0 and pixels.measure(a, 60)[1] == pytest.approx(20 / 90)
    assert pixels.measure(None)[3:] == (1.0, False, "load_error") and pixels.measure(np.zeros((2, 2, 5)))[3:] == (1.0, False, "wrong_channels")


def test_cross_validation_fits_without_the_group(spark):
    r = random.Random(8)
    data = [(i, f"f{i % 3}", float(x := r.random()), 2 * x + 1 + (i % 3) * 0.1 + 0.01 * r.random()) for i in range(300)]
    df = spark.createDataFrame(data, "id long, fold string, x double, label double")
    fit = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="label")])
    got = {r["fold"]: r for r in model.cross_validate(df, "fold", fit, "label", "id").collect()}
    for f in ("f0", "f1", "f2"):
        pool = splits.stratified_split(df.where(f"fold <> '{f}'").selectExpr("*", "1 AS _fold"), ["_fold"], "label", "id").where("split = 'train'").collect()
        slope, cut = np.polyfit([p["x"] for p in pool], [p["label"] for p in pool], 1)
        test = [(d[3], slope * d[2] + cut) for d in data if d[1] == f]
        assert (got[f]["train_samples"], got[f]["val_samples"], got[f]["test_samples"]) == (170, 30, 100)
        assert math.isclose(got[f]["test_mae"], sum(abs(a - b) for a, b in test) / 100, rel_tol=1e-6)


def test_linear_folds_from_moments_equal_fitted_ones(spark):
    r = random.Random(9)
    data = [(i, f"f{i % 3}", a := 1e6 + r.random(), b := r.gauss(0, 3), 2 * (a - 1e6) - b + (i % 3) * 0.1 + r.random()) for i in range(400)]
    df = spark.createDataFrame([*data, (900, None, 1.0, 1.0, 1.0), (901, "f0", None, 1.0, 1.0)], "id long, fold string, a double, b double, label double")
    known = df.where("id < 900").withColumnRenamed("fold", "group")
    pool = splits.stratified_split(splits.leave_one_group_out(known, "group").where("split = 'pool'").drop("split"), ["fold"], "label", "id").select("fold", "id", "split").collect()
    split = {(x["fold"], x["id"]): x["split"] for x in pool}
    got = model.cross_validate_linear(df.withColumn("c", F.col("b")), "fold", ["a", "b", "c"], "label", "id")
    assert got.columns == ["fold", *model.VALIDATION]
    got = {x["fold"]: x for x in got.collect()}
    assert sorted(got) == ["f0", "f1", "f2"]
    for f, row in got.items():
        parts = {p: np.array([[1.0, d[2] - 1e6, d[3], d[4]] for d in data if (split.get((f, d[0])) if d[1] != f else "test") == p]) for p in ("train", "val", "test")}
        fit = np.linalg.lstsq(parts["train"][:, :3], parts["train"][:, 3], rcond=None)[0]
        want = []
        for rows in parts.values():
            e = rows[:, 3] - rows[:, :3] @ fit
            want += [len(e), (e**2).mean(), 1 - (e**2).mean() / rows[:, 3].var()]
        want += [math.sqrt(want[-2]), abs(e).mean()]
        assert [row[c] for c in model.VALIDATION] == pytest.approx(want, rel=1e-8)
    with pytest.raises(ValueError):
        model.cross_validate_linear(df, "id", ["a"], "label", "id")


def test_left_interval_join_with_null_attributes(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 6, 1, h)
    windows = spark.createDataFrame([("a", None, at(1), at(3)), ("b", "n", at(5), at(6)), ("b", "n", at(5), at(6)), ("c", None, None, at(9)), ("d", "x", at(9), at(8))], "k string, note string, s timestamp, e timestamp")
    points = spark.createDataFrame([(at(2), 1.0), (at(3), None)], "at timestamp, v double")
    got = intervals.interval_join(points, windows, "at", "s", "e", how="left").collect()
    assert sorted((r["k"], r["at"] is None) for r in got) == [("a", False), ("a", False), ("b", True), ("b", True), ("c", True), ("d", True)]


def test_compiled_predictions_of_several_models_and_lost_rows(spark):
    meta = spark.createDataFrame([("a.jpg", None, "F", 1)], "image_filename string, date date, field string, plot int")
    kind = "model string, fold int, test_year int, image_filename string, actual double, predicted double, signed_error double, abs_error double"
    rows = [("m", 2023, 2023, "a.jpg", 1.0, 2.0, 1.0, 1.0), ("n", 2023, 2023, "a.jpg", 1.0, 3.0, 2.0, 2.0), ("m", 2024, 2024, "a.jpg", 1.0, 0.0, -1.0, 1.0)]
    assert joins.compile_predictions(spark.createDataFrame(rows, kind), meta).count() == 3
    for bad in ([*rows, rows[0]], [(*rows[0][:3], "b.jpg", *rows[0][4:])]):
        with pytest.raises(Exception, match="repeated left keys|rows without partner"):
            joins.compile_predictions(spark.createDataFrame(bad, kind), meta).count()
    both, lost = joins.join_covariates(spark.createDataFrame([("a", 1.0, 3.0), ("b", 1.0, 1.0), (None, 1.0, 1.0)], "image_filename string, actual double, predicted double"), spark.createDataFrame([("a", 5)], "image_filename string, w int"))
    assert [tuple(r) for r in both.collect()] == [("a", 1.0, 3.0, 2.0, 2.0, 5)] and tuple(lost.first()) == (3, 2)


def test_quantiles_equal_the_built_in_ones_for_each_group(spark):
    r = random.Random(11)
    rows = [(r.choice(["a", "b", None]), r.choice([r.random() * 9, float(r.randrange(5)), None])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    p = [0.0, 0.2, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {x["_g"]["g"]: x["_q"] for x in ranks.quantiles(df, "v", ["g"], p).collect()}
    want = {x["g"]: x["q"] for x in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, p))).alias("q")).collect()}
    assert got.keys() == want.keys() - {"none"} and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in got)
    assert ranks.quantiles(df, "v", [], [0.5]).first()["_q"] == pytest.approx([df.agg(F.median("v")).first()[0]])
    assert ranks.quantiles(df.where("false"), "v", ["g"], p).count() == 0
    binned = bins.quantile_bins(df, "v", 4, ("g",))
    assert binned.columns == ["g", "v", "bin"] and binned.count() == len(rows) and binned.where("v is not null and bin is null").count() == 0


def test_percentile_pick_with_ties_and_null_groups(spark):
    r = random.Random(12)
    rows = [(r.choice(["a", None]), float(r.randrange(6)), k) for k in range(500)] + [("a", None, 900), ("one", 1.0, 901)]
    got = profile.percentile_pick(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v", "k")
    want = []
    for g in ("a", None, "one"):
        own = sorted((v, k) for x, v, k in rows if x == g and v is not None)
        want += [(g, *own[round(p / 100 * (len(own) - 1))], p) for p in (10, 90)]
    assert got.columns == ["g", "v", "k", "percent"] and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_covariates_are_ranked_once_and_equal_ranks_among_complete_pairs(spark):
    rnd = random.Random(11)
    some = lambda f: None if rnd.random() < 0.2 else f()
    table = [(some(lambda: rnd.randrange(4) / 10), some(lambda: rnd.random()), some(lambda: rnd.randrange(9) - 4.0), some(lambda: rnd.random())) for _ in range(150)] * 2
    names = ["c0", "c1", "e0", "e1"]
    df = spark.createDataFrame(table, ", ".join(f"{c} double" for c in names))
    out = ranks.spearman_by_covariate(df, names[:2], names[2:], [])
    rank = lambda x: [(2 * sum(v < u for v in x) + sum(v == u for v in x) + 1) / 2 for u in x]
    got = {(r["covariate"], r["error"]): (r["n"], r["rho"]) for r in out.collect()}
    assert len(got) == 4
    for (c, e), (n, rho) in got.items():
        pairs = [(r[names.index(c)], r[names.index(e)]) for r in table if None not in (r[names.index(c)], r[names.index(e)])]
        want = np.corrcoef(*(rank([p[i] for p in pairs]) for i in (0, 1)))[0, 1]
        assert n == len(pairs) and math.isclose(rho, want, abs_tol=1e-9)
    # rows are counted before they are laid out for each pair
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_split_of_few_folds_shuffles_no_rows_by_them(spark):
    df = spark.range(900).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") * 37 % 101).cast("double").alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, plain = (splits.stratified_split(df, ["fold"], "y", "id", few=x) for x in (True, False))
        assert sorted(map(tuple, few.select("id", "split").collect())) == sorted(map(tuple, plain.select("id", "split").collect()))
        assert few._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
