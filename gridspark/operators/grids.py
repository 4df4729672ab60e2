"""Grids of their own: boxes, new grids, warping, aligning stacks, mosaics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import crs as projections
from gridspark.operators.focal import AGGREGATES
from gridspark.operators.model import GeoTransform, Grid, cells, check_pixel_size, spark_of

Box = list[float]


# ---------------------------------------------------------------- boxes
def merge_bounding_boxes(boxes: Sequence[Box], mode: str) -> Box:
    """Union or intersection; ValueError where an intersection is empty."""
    if mode not in ("union", "intersection"):
        raise ValueError(f"mode must be union or intersection, not {mode!r}")
    low, high = (min, max) if mode == "union" else (max, min)
    out = [low(b[0] for b in boxes), low(b[1] for b in boxes), high(b[2] for b in boxes), high(b[3] for b in boxes)]
    if out[0] > out[2] or out[1] > out[3]:
        raise ValueError(f"the boxes don't meet: {boxes}")
    return out


def boxes_of(features: DataFrame, mode: str = "union") -> DataFrame:
    """(minx, miny, maxx, maxy) over a column ``bbox`` of any number of features."""
    low, high = (F.min, F.max) if mode == "union" else (F.max, F.min)
    return features.agg(low("bbox.minx").alias("minx"), low("bbox.miny").alias("miny"), high("bbox.maxx").alias("maxx"), high("bbox.maxy").alias("maxy"))


def align_bbox(gt: GeoTransform, box: Box) -> Box:
    """The box grown outward to the lines of a grid; rotation is ignored."""
    if gt[1] == 0 or gt[5] == 0:
        raise ValueError("the geotransform has a zero pixel size")
    if box[0] > box[2] or box[1] > box[3]:
        raise ValueError(f"the box is turned inside out: {box}")
    for low, origin, size in ((box[0], gt[0], gt[1]), (box[1], gt[3], gt[5])):
        if (low - origin) * size < 0:  # before the origin, as the axis runs
            raise ValueError(f"the box {box} isn't within the grid")
    out = []
    for i, (o, p) in enumerate(((gt[0], abs(gt[1])), (gt[3], abs(gt[5])), (gt[0], abs(gt[1])), (gt[3], abs(gt[5])))):
        steps = (box[i] - o) / p
        near = round(steps)
        steps = near if math.isclose(steps, near, rel_tol=0, abs_tol=1e-9) else math.floor(steps) if i < 2 else math.ceil(steps)
        out.append(o + steps * p)
    return out


def transform_bounding_box(box: Box, source: str, target: str, edge_samples: int = 11) -> Box:
    """Extremes of the box's edges, sampled and transformed; ValueError where a point has no image."""
    t = np.linspace(0, 1, edge_samples)
    xs, ys = box[0] + t * (box[2] - box[0]), box[1] + t * (box[3] - box[1])
    edges = [(np.full_like(t, box[0]), ys), (xs, np.full_like(t, box[1])), (np.full_like(t, box[2]), ys), (xs, np.full_like(t, box[3]))]
    moved = [projections.transform(x, y, source, target) for x, y in edges]
    if not all(np.isfinite(a).all() for m in moved for a in m):
        raise ValueError(f"a point of {box} has no image in {target}")
    a = [moved[0][0].min(), moved[1][1].min(), moved[2][0].max(), moved[3][1].max()]
    return [float(min(a[0], a[2])), float(min(a[1], a[3])), float(max(a[0], a[2])), float(max(a[1], a[3]))]


def size_of(extent: float, pixel: float) -> int:
    """Pixels that an extent needs: whole ones, one more for a rest, at least one."""
    n = int(abs(extent / pixel))
    if not np.isclose(abs(n * pixel) - abs(extent), 0.0):
        n += 1
    return max(n, 1)


# ---------------------------------------------------------------- new grids
def new_grid(base: Grid, nodata: float | None, fill: float | None = None, dtype: str | None = None, n_rows: int | None = None, n_cols: int | None = None) -> Grid:
    """An empty grid with the place and pixel size of ``base``, or one filled with a number."""
    h, w = n_rows or base.n_rows, n_cols or base.n_cols
    px = cells(spark_of(base), h, w).withColumn("v", F.lit(fill).cast("double"))
    return replace(base, px=px, n_rows=h, n_cols=w, dtype=dtype or base.dtype, nodata=nodata)


def grid_from_box(spark: SparkSession, box: Box, pixel_size: tuple[float, float], dtype: str = "float64", crs: str | None = None, nodata: float | None = None, fill: float | None = None) -> Grid:
    check_pixel_size(pixel_size)
    px, py = pixel_size
    w, h = size_of(box[2] - box[0], px), size_of(box[3] - box[1], py)
    gt = (box[2] if px < 0 else box[0], px, 0.0, box[3] if py < 0 else box[1], 0.0, py)
    return Grid(cells(spark, h, w).withColumn("v", F.lit(fill).cast("double")), h, w, gt, crs, dtype, nodata)


def grid_from_features(features: DataFrame, pixel_size: tuple[float, float], dtype: str = "float64", crs: str | None = None, nodata: float | None = None, fill: float | None = None) -> Grid:
    """A grid over all features' boxes; features without geometry are passed over."""
    box = boxes_of(features.filter("bbox is not null")).first()
    if box.minx is None:
        raise ValueError("no feature has a geometry")
    return grid_from_box(features.sparkSession, list(box), pixel_size, dtype, crs, nodata, fill)


# ---------------------------------------------------------------- warping
def _taps(method: str) -> tuple[int, int, Callable[[Column], Column]]:
    """First and last tap beside the cell, and the weight of a tap at distance d."""
    if method == "bilinear":
        return 0, 1, lambda d: F.greatest(F.lit(0.0), 1 - F.abs(d))
    if method in ("cubic", "cubicspline"):
        a = -0.5
        near = lambda d: (a + 2) * F.pow(d, F.lit(3)) - (a + 3) * d * d + 1
        far = lambda d: a * F.pow(d, F.lit(3)) - 5 * a * d * d + 8 * a * d - 4 * a
        if method == "cubicspline":
            near = lambda d: (4 - 6 * d * d + 3 * F.pow(d, F.lit(3))) / 6
            far = lambda d: F.pow(2 - d, F.lit(3)) / 6
        return -1, 2, lambda d: F.when(F.abs(d) <= 1, near(F.abs(d))).when(F.abs(d) < 2, far(F.abs(d))).otherwise(0.0)
    if method == "lanczos":
        sinc = lambda d: F.when(d == 0, 1.0).otherwise(F.sin(np.pi * d) / (np.pi * F.nullif(d, F.lit(0.0))))
        return -2, 3, lambda d: F.when(F.abs(d) < 3, sinc(d) * sinc(d / 3)).otherwise(0.0)
    raise ValueError(f"unknown resampling {method!r}")


def warp(grid: Grid, pixel_size: tuple[float, float], method: str = "near", box: Box | None = None, crs: str | None = None) -> Grid:
    """The grid resampled to another pixel size, box or coordinate system.

    ``near`` and the aggregates are an equi-join of target and source cells, the interpolating
    methods one with 4, 16 or 36 weighted taps; NULL cells carry no weight.
    """
    check_pixel_size(pixel_size)
    spark = spark_of(grid)
    moved = crs is not None and grid.crs is not None and crs != grid.crs
    target = box or (transform_bounding_box(grid.bounding_box, grid.crs, crs) if moved else grid.bounding_box)
    out = grid_from_box(spark, target, pixel_size, grid.dtype, crs or grid.crs, grid.nodata)
    g, t = grid.gt, out.gt
    cx, cy = t[0] + (F.col("x") + 0.5) * t[1], t[3] + (F.col("y") + 0.5) * t[5]
    place = out.px.select("y", "x", cx.alias("cx"), cy.alias("cy"))
    if moved:
        place = projections.transform_columns(place, "cx", "cy", crs, grid.crs)
    col, row = (F.col("cx") - g[0]) / g[1], (F.col("cy") - g[3]) / g[5]
    source = grid.px.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    if method in AGGREGATES:
        if moved:
            raise ValueError("aggregates need one coordinate system")
        # each source cell belongs to the target cell that holds its centre
        sx = g[0] + (F.col("sx") + 0.5) * g[1]
        sy = g[3] + (F.col("sy") + 0.5) * g[5]
        to = source.select(F.floor((sx - t[0]) / t[1]).alias("x"), F.floor((sy - t[3]) / t[5]).alias("y"), "v")
        px = out.px.select("y", "x").join(to.groupBy("y", "x").agg(AGGREGATES[method](F.col("v").cast("double")).alias("v")), ["y", "x"], "left")
        return out.with_px(px)
    if method == "near":
        near = place.select("y", "x", F.floor(row).alias("sy"), F.floor(col).alias("sx"))
        return out.with_px(near.join(source, ["sy", "sx"], "left").select("y", "x", "v"))
    lo, hi, weight = _taps(method)
    base = place.select("y", "x", (row - 0.5).alias("r"), (col - 0.5).alias("c"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(lo, hi + 1) for j in range(lo, hi + 1))))
    taps = base.select("y", "x", "r", "c", steps.alias("s"))
    ty = F.least(F.greatest(F.floor("r") + F.col("s.i"), F.lit(0)), F.lit(grid.n_rows - 1))
    tx = F.least(F.greatest(F.floor("c") + F.col("s.j"), F.lit(0)), F.lit(grid.n_cols - 1))
    w = weight(F.col("r") - F.floor("r") - F.col("s.i")) * weight(F.col("c") - F.floor("c") - F.col("s.j"))
    inside = (F.col("r") >= -0.5) & (F.col("r") < grid.n_rows - 0.5) & (F.col("c") >= -0.5) & (F.col("c") < grid.n_cols - 0.5)
    weighted = taps.filter(inside).select("y", "x", ty.alias("sy"), tx.alias("sx"), w.alias("w")).join(source.filter("v is not null"), ["sy", "sx"])
    total = weighted.groupBy("y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("v"))
    return out.with_px(out.px.select("y", "x").join(total, ["y", "x"], "left"))


def align_stack(grids: Sequence[Grid], methods: Sequence[str], pixel_size: tuple[float, float], box: str | Box, align_to: int | None = None) -> list[Grid]:
    """All grids on one common grid over their union, their intersection or a given box."""
    if not grids or len(grids) != len(methods):
        raise ValueError("as many resampling methods as grids are needed")
    if align_to is not None and not 0 <= align_to < len(grids):
        raise ValueError(f"no grid {align_to} to align to")
    common = merge_bounding_boxes([g.bounding_box for g in grids], box) if isinstance(box, str) else list(box)
    if align_to is not None:
        own, size = grids[align_to].bounding_box, grids[align_to].gt
        for i, step in ((0, abs(size[1])), (1, abs(size[5]))):
            common[i] = int((common[i] - own[i]) / step) * step + own[i]
    return [warp(g, pixel_size, m, common) for g, m in zip(grids, methods, strict=True)]


# ---------------------------------------------------------------- mosaics
def stitch(target: Grid, sources: Sequence[Grid], overlap: str = "etch", weigh_by_area: bool = False) -> Grid:
    """Sources laid onto the target in order: into gaps (etch), over it (replace), or summed (add).

    Grids of the target's pixel size are shifted, others resampled (nearest); what lies beside
    the target is cut off.  All sources are one union with their rank, so one shuffle resolves
    every overlap.
    """
    if overlap not in ("etch", "replace", "add"):
        raise ValueError(f"overlap must be etch, replace or add, not {overlap!r}")
    parts = [target.px.select("y", "x", F.col("v").cast("double").alias("v"), F.lit(0).alias("rank"))]
    for i, s in enumerate(sources):
        if (s.gt[1], s.gt[5]) != (target.gt[1], target.gt[5]) or (s.crs and target.crs and s.crs != target.crs):
            s = warp(s, (target.gt[1], target.gt[5]), "near", crs=target.crs)
        dx, dy = _whole_steps(s.gt[0] - target.gt[0], target.gt[1]), _whole_steps(s.gt[3] - target.gt[3], target.gt[5])
        v = F.col("v").cast("double")
        if weigh_by_area:
            v = v * pixel_area_m2(abs(target.gt[1]), F.lit(target.gt[3]) + (F.col("y") + dy + 0.5) * target.gt[5])
        moved = s.px.select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), v.alias("v"), F.lit(i + 1).alias("rank"))
        parts.append(moved.filter(F.col("y").between(0, target.n_rows - 1) & F.col("x").between(0, target.n_cols - 1)))
    every = reduce(DataFrame.unionByName, parts)
    valid = F.when(F.col("v").isNotNull(), F.col("rank"))
    agg = {"etch": F.min_by("v", valid), "replace": F.max_by("v", valid), "add": F.sum("v")}[overlap]
    return target.with_px(every.groupBy("y", "x").agg(agg.alias("v")), dtype="float64")


def _whole_steps(offset: float, size: float) -> int:
    """How many pixels ``offset`` is; ValueError for a grid between the pixels of the other."""
    steps = offset / size
    if not math.isclose(steps, round(steps), rel_tol=0, abs_tol=1e-3):
        raise ValueError(f"the grids are {steps} pixels apart; warp one to the other first")
    return round(steps)


def pixel_area_m2(size: float, lat: Column) -> Column:
    """Area of a WGS84 pixel of ``size`` degrees whose centre is at ``lat``."""
    a, b = 6378137.0, 6356752.3142  # fixed values: semi-axes of the ellipsoid in metres
    e = math.sqrt(1 - (b / a) ** 2)

    def zone(at: Column) -> Column:
        s = F.sin(F.radians(at))
        up, down = 1 + e * s, 1 - e * s
        return math.pi * b**2 * (F.log(up / down) / (2 * e) + s / (up * down))

    return F.abs((zone(lat + size / 2) - zone(lat - size / 2)) * (size / 360.0))


def latitude_areas(spark: SparkSession, lat_min: float, lat_max: float, n: int) -> DataFrame:
    """(y, area) of ``n`` pixel rows from north to south."""
    size = (lat_max - lat_min) / n
    return spark.range(n).select(F.col("id").alias("y"), pixel_area_m2(size, F.lit(lat_max) - (F.col("id") + 0.5) * size).alias("area"))
