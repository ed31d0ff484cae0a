"""Run summaries by blocks equal a plain loop over each run."""

import random

import pytest
from pyspark.sql import functions as F

from fieldjobs.operators import compare


def loop(steps, delta, patience):
    best, missed, n, last = None, 0, 0, None
    for e, v in steps:
        if patience is not None and missed >= patience:
            break
        n, last = n + 1, v
        if best is None or v > best[1] + delta:
            best, missed = (e, v), 0
        else:
            missed += 1
    return (*best, n, last)


@pytest.mark.parametrize("delta, patience", [(0.0, None), (0.5, None), (0.5, 3), (0.0, 6)])
def test_blocks_equal_a_loop(spark, delta, patience):
    r = random.Random(5)
    rows = []
    for run, slope in (("a", 0.1), ("b", 0.3), (None, 0.0), ("d", 1.0), ("e", -0.2), ("f", 0.02)):
        for e in range(60):
            rows += [(run, e, r.choice([round(slope * e + r.random() * 2, 3), float(r.randrange(4)), None]))] * r.choice([1, 1, 1, 2])
        rows += [(run, None, r.random()), (run, 7, r.random())]
    rows.append(("one", 3, 1.5))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "m string, epoch int, value double")
    want = {}
    for m in {x[0] for x in rows}:
        steps = sorted(((e is not None, e or 0, v) for k, e, v in rows if k == m and v is not None))
        want[m] = loop([(e if there else None, v) for there, e, v in steps], delta, patience)
    for steps in (4, 1000):
        got = compare.run_summary(df, ["m"], delta, patience, steps=steps)
        assert got.columns == ["m", "best_epoch", "best_value", "epochs_trained", "final_value"]
        assert {x[0]: tuple(x)[1:] for x in got.collect()} == want


def test_a_very_long_run(spark):
    n = 1_000_000
    run = spark.range(n).select(F.lit("r").alias("m"), F.col("id").alias("epoch"), F.when(F.col("id") == 700_001, 9.0).otherwise(F.pmod(F.hash("id"), F.lit(1000)) / 1000).alias("value"))
    got = compare.run_summary(run, ["m"], 0.1).first()
    assert tuple(got)[:4] == ("r", 700_001, 9.0, n) and got["final_value"] == run.where(F.col("epoch") == n - 1).first()["value"]
    with pytest.raises(ValueError):
        compare.run_summary(run, ["m"], -1.0)
