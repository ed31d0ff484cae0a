"""Heights are made only where a plot asks for them, and the plots' sums stay the same."""

import numpy as np
from pyspark.sql import functions as F

from fieldjobs.operators import raster


def test_only_tiles_under_plots_are_made(spark):
    r = np.random.default_rng(4)
    tile = lambda name, row, col, low: (name, row, col, col * 4.0, row * 4.0, 1.0, 1.0, 4, 4, None, [float(v) for v in low + r.random(16)])
    kind = "raster_id string, tile_r int, tile_c int, x0 double, y0 double, dx double, dy double, h int, w int, nodata float, pixels array<float>"
    tiles = spark.createDataFrame([tile(n, i, j, low) for n, low in (("s", 1.0), ("g", 0.0)) for i in range(6) for j in range(6)], kind)
    ring = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    plots = spark.createDataFrame([("f", 1, ring(1.0, 1.0, 2.0)), ("f", 2, ring(3.0, 3.0, 3.0)), ("other", 3, ring(16.0, 16.0, 3.0))], "field string, plot int, ring array<struct<x: double, y: double>>")
    pairs = spark.createDataFrame([("s", "g", "f")], "surface_id string, terrain_id string, field string")
    every, some = raster.canopy_height(tiles, tiles, pairs), raster.canopy_height(tiles, tiles, pairs, plots)
    assert every.count() == 36
    assert sorted((x["tile_r"], x["tile_c"]) for x in some.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    of = pairs.select(F.col("surface_id").alias("raster_id"), "field")
    a, b = (sorted(map(tuple, raster.zonal(h, plots, of).collect())) for h in (every, some))
    assert a == b and [x[:4] for x in a] == [("s", "f", 1, 4), ("s", "f", 2, 9)]
