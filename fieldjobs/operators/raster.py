"""Rasters as tables of tiles: references, heights, zonal fractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Height classes in metres; both ends of the weed class belong to it.
WEED_FROM, WEED_TO = 0.492, 2.461


def latest_file(inventory: DataFrame, keys: tuple[str, ...] = ("flight_folder", "kind")) -> DataFrame:
    """The newest file of each key: by the processing time in its name (_yyyyMMddTHHmm_), else by modification time."""
    name = F.element_at(F.split("path", "/"), -1)
    stamp = F.regexp_extract(name, r"_(\d{8}T\d{4})_", 1)
    when = F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd'T'HHmm")), F.col("modified"))
    rest = [c for c in inventory.columns if c not in keys]
    best = inventory.withColumn("_w", when).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("_w", F.lit("1970-01-01").cast("timestamp")), "path")).alias("_r"))
    return best.select(*keys, "_r.*")


def assign_reference(inventory: DataFrame, own_years: tuple[int, ...] = ()) -> DataFrame:
    """Adds ``ref_dtm_path, dtm_strategy``.

    In own years a flight's own terrain is used (own), else the season's earliest
    (own_fallback). In others it is the earliest of the year and field; flights of that
    date are earliest_self. Without any terrain both are null.
    """
    there = F.col("dtm_path").isNotNull()
    w = Window.partitionBy("year", "field")
    first = F.min(F.when(there, F.struct("flight_date", "dtm_path"))).over(w)
    out = inventory.withColumn("_f", first)
    own = F.col("year").isin(*own_years) if own_years else F.lit(False)
    strategy = F.when(F.col("_f").isNull(), None).when(own & there, "own").when(own, "own_fallback").when(F.col("flight_date") == F.col("_f.flight_date"), "earliest_self").otherwise("earliest")
    return out.withColumn("dtm_strategy", strategy).withColumn("ref_dtm_path", F.when(F.col("dtm_strategy") == "own", F.col("dtm_path")).otherwise(F.col("_f.dtm_path"))).drop("_f")


TILE = "raster_id string, tile_r int, tile_c int, x0 double, y0 double, dx double, dy double, h int, w int, pixels array<float>"


def _bilinear(a: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Values at fractional places; NaN outside or where a needed neighbour is missing."""
    ok = (r >= 0) & (c >= 0) & (r <= a.shape[0] - 1) & (c <= a.shape[1] - 1)
    r0, c0 = np.clip(np.floor(r).astype(int), 0, a.shape[0] - 1), np.clip(np.floor(c).astype(int), 0, a.shape[1] - 1)
    r1, c1 = np.minimum(r0 + 1, a.shape[0] - 1), np.minimum(c0 + 1, a.shape[1] - 1)
    fr, fc = r - r0, c - c0
    mixed = 0.0
    for rr, wr in ((r0, 1 - fr), (r1, fr)):
        for cc, wc in ((c0, 1 - fc), (c1, fc)):
            mixed = mixed + np.where(wr * wc > 0, a[rr, cc] * wr * wc, 0.0)
    return np.where(ok, mixed, np.nan)


def _span(start: str, step: str, n: str, halo: float = 0.0):
    """Smallest and largest coordinate of a tile along an axis, widened by so many pixels."""
    a, b = F.col(start), F.col(start) + F.col(step) * F.col(n)
    more = F.abs(F.col(step)) * halo
    return F.least(a, b) - more, F.greatest(a, b) + more


def _boxes(tiles: DataFrame, halo: float = 0.0) -> DataFrame:
    """``raster_id, tile_r, tile_c, x1, x2, y1, y2``: tiles without their pixels."""
    (x1, x2), (y1, y2) = _span("x0", "dx", "w", halo), _span("y0", "dy", "h", halo)
    return tiles.select("raster_id", "tile_r", "tile_c", x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2"))


def _level(x1, x2, y1, y2):
    """The least level whose cells, of side 2 ** level, are no shorter than the box; a box touches four of them at most."""
    side = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1), F.lit(1e-9))
    return F.ceil(F.log2(side)).cast("int")


def _cells(boxes: DataFrame, levels: DataFrame, tags) -> DataFrame:
    """A row for each cell that a box touches on its own level and on every higher one that ``levels`` holds, once for each of its ``tags``."""
    up = boxes.join(F.broadcast(levels)).withColumn("level", F.explode(F.filter("_levels", lambda x: x >= F.col("_own")))).drop("_levels")  # one row
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.pow(F.lit(2.0), "level")), F.floor(F.col(b) / F.pow(F.lit(2.0), "level"))))
    up = up.withColumn("cell_x", span("x1", "x2")).withColumn("cell_y", span("y1", "y2"))
    return up.withColumn("tag", F.explode(tags(F.col("level") == F.col("_own")))).drop("_own")


def _candidates(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of boxes that share a cell of the level of the larger one; the right one's sides are called ``r_``.

    Cells form a quadtree. With tag 0 a left box stands on its own level and right boxes
    climb to it, with tag 1 the other way round, so small boxes never meet in the cells of
    a large one. The levels of one side are an array of some tens of numbers.
    """
    box = ["x1", "x2", "y1", "y2"]
    left, right = (df.withColumn("_own", _level(*box)) for df in (left, right))
    levels = left.select("_own").union(right.select("_own")).agg(F.collect_set("_own").alias("_levels"))
    at = _cells(left, levels, lambda own: F.array(F.when(own, 0).otherwise(1)))
    to = _cells(right, levels, lambda own: F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return at.join(to.withColumnsRenamed({c: f"r_{c}" for c in box}), [*keys, "tag", "level", "cell_x", "cell_y"])


def _overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of boxes (the right one's other columns come as they are) with a common inside, each once.

    Boxes meet in the cell that holds the corner of their common part, so no pair is made twice.
    """
    met = _candidates(left, right, keys)
    inside = (F.col("x1") < F.col("r_x2")) & (F.col("r_x1") < F.col("x2")) & (F.col("y1") < F.col("r_y2")) & (F.col("r_y1") < F.col("y2"))
    at = lambda a, b: F.floor(F.greatest(a, b) / F.pow(F.lit(2.0), "level"))
    corner = (at("x1", "r_x1") == F.col("cell_x")) & (at("y1", "r_y1") == F.col("cell_y"))
    return met.where(inside & corner).drop(*(f"{r}{c}" for c in ("x1", "x2", "y1", "y2") for r in ("", "r_")), "tag", "level", "cell_x", "cell_y")


def _mosaic(tiles: pd.DataFrame) -> tuple[np.ndarray, float, float, float, float]:
    """The tiles of one raster's grid in one array, with its corner and steps; missing places are NaN."""
    dx, dy = tiles.dx.iloc[0], tiles.dy.iloc[0]
    x0, y0 = (tiles.x0.min() if dx > 0 else tiles.x0.max()), (tiles.y0.min() if dy > 0 else tiles.y0.max())
    at = [(int(round((t.y0 - y0) / dy)), int(round((t.x0 - x0) / dx)), t) for t in tiles.itertuples()]
    out = np.full((max(r + t.h for r, _, t in at), max(c + t.w for _, c, t in at)), np.nan)
    for r, c, t in at:
        a = np.array(t.pixels, np.float64).reshape(t.h, t.w)
        if t.nodata is not None and t.nodata == t.nodata:
            a[a == t.nodata] = np.nan
        out[r : r + t.h, c : c + t.w] = a
    return out, x0, y0, dx, dy


def _plot_boxes(polygons: DataFrame) -> DataFrame:
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return polygons.select("field", "plot", F.array_min(xs).alias("x1"), F.array_max(xs).alias("x2"), F.array_min(ys).alias("y1"), F.array_max(ys).alias("y2"))


def canopy_height(surface: DataFrame, terrain: DataFrame, pairs: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """Height tiles on the terrain's grid: surface minus terrain, NaN where either is missing.

    ``pairs``: surface_id, terrain_id. A terrain tile meets the surface tiles that overlap
    it or come within a pixel of it; boxes are joined on cells of a quadtree
    and compared before any pixel moves. The surface tiles of a terrain tile are laid side
    by side (tiles of one raster share its grid), so values are read bilinearly across
    their borders. A terrain tile without surface gives no tile. With ``polygons``, whose
    ``field`` the pairs then hold too, only tiles that a plot's box meets are made.
    """
    s_boxes, t_boxes = _boxes(surface, 1.0), _boxes(terrain)
    if polygons is not None:
        fields = pairs.select(F.col("terrain_id").alias("raster_id"), "field").distinct()
        under = _overlapping(t_boxes.join(fields, "raster_id"), _plot_boxes(polygons), ["field"]).select("raster_id", "tile_r", "tile_c").distinct()
        t_boxes = t_boxes.join(under, ["raster_id", "tile_r", "tile_c"], "left_semi")
    s_boxes = s_boxes.toDF("surface_id", "s_tile_r", "s_tile_c", "x1", "x2", "y1", "y2")
    t_boxes = t_boxes.join(pairs.select("surface_id", "terrain_id").distinct(), F.col("raster_id") == F.col("terrain_id")).drop("raster_id")
    met = _overlapping(t_boxes, s_boxes, ["surface_id"])
    key = ["surface_id", "terrain_id", "tile_r", "tile_c"]
    tops = met.join(surface.select(*(F.col(c).alias({"raster_id": "surface_id", "tile_r": "s_tile_r", "tile_c": "s_tile_c"}.get(c, c)) for c in surface.columns)), ["surface_id", "s_tile_r", "s_tile_c"])
    ground = terrain.withColumnRenamed("raster_id", "terrain_id").join(met.select(*key).distinct(), ["terrain_id", "tile_r", "tile_c"])
    ground, tops = ground.toDF(*ground.columns), tops.toDF(*tops.columns)

    def run(names: tuple, low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in low.drop_duplicates(["terrain_id", "tile_r", "tile_c"]).itertuples():
            base, *_ = _mosaic(low[(low.tile_r == row.tile_r) & (low.tile_c == row.tile_c)].head(1))
            top, x0, y0, dx, dy = _mosaic(high.sort_values(["s_tile_r", "s_tile_c"], ascending=False))
            y, x = row.y0 + row.dy * (np.arange(row.h) + 0.5), row.x0 + row.dx * (np.arange(row.w) + 0.5)
            got = _bilinear(top, *np.meshgrid((y - y0) / dy - 0.5, (x - x0) / dx - 0.5, indexing="ij"))
            out.append([names[0], row.tile_r, row.tile_c, row.x0, row.y0, row.dx, row.dy, row.h, row.w, (got - base).astype(np.float32).ravel()])
        return pd.DataFrame(out, columns=[x.split()[0] for x in TILE.split(", ")])

    return ground.groupBy(*key).cogroup(tops.groupBy(*key)).applyInPandas(run, TILE)


def _inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule for many points and one ring."""
    out = np.zeros(x.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def zonal(heights: DataFrame, polygons: DataFrame, rasters: DataFrame) -> DataFrame:
    """``raster_id, field, plot, px_valid, px_weed, frac_weed``: pixels whose centre lies in a plot.

    ``rasters``: raster_id, field. Boxes of tiles and plots are joined on cells
    of a quadtree and compared before any pixel moves; a tile then meets all its plots at once and gives a
    pair of sums for each. Negative heights count as ground. A plot that no tile's pixels
    fill has a null fraction.
    """
    boxes = _boxes(heights)
    plots = _plot_boxes(polygons)
    key = ["raster_id", "tile_r", "tile_c"]
    met = _overlapping(boxes.join(rasters.select("raster_id", "field").distinct(), "raster_id"), plots, ["field"]).distinct()
    asked = met.join(polygons.select("field", "plot", "ring"), ["field", "plot"])
    tiles = heights.join(met.select(*key).distinct(), key)
    tiles, asked = tiles.toDF(*tiles.columns), asked.toDF(*asked.columns)

    def run(tile: pd.DataFrame, plots: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in tile.itertuples():
            x, y = np.meshgrid(row.x0 + row.dx * (np.arange(row.w) + 0.5), row.y0 + row.dy * (np.arange(row.h) + 0.5))
            pixels = np.array(row.pixels, float).reshape(row.h, row.w)
            for p in plots.itertuples():
                h = pixels[_inside(x, y, np.array([[q["x"], q["y"]] for q in p.ring]))]
                h = np.maximum(h[~np.isnan(h)], 0)
                out.append((row.raster_id, p.field, p.plot, len(h), int(((h >= WEED_FROM) & (h <= WEED_TO)).sum())))
        return pd.DataFrame(out, columns=["raster_id", "field", "plot", "px_valid", "px_weed"])

    parts = tiles.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "raster_id string, field string, plot int, px_valid long, px_weed long")
    sums = parts.groupBy("raster_id", "field", "plot").agg(F.sum("px_valid").alias("px_valid"), F.sum("px_weed").alias("px_weed"))
    return sums.withColumn("frac_weed", F.when(F.col("px_valid") > 0, F.col("px_weed") / F.col("px_valid")))
