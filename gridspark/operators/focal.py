"""Neighbourhood operators: stencils, slope, convolution, kernels, distance transform, overviews."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions.expressions import compile_expression
from gridspark.operators.model import Grid

#: Row and column offsets of the eight directions E, NE, N, NW, W, SW, S, SE.
OFFSETS = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
SQRT2 = 2.0**0.5


def stencil(px: DataFrame, v: str = "v", prefix: str = "n") -> DataFrame:
    """``px`` (dense) with the eight neighbours' values n0..n7, NULL beyond the edge or without data.

    One window along rows carries each cell's two side neighbours, one along columns then takes
    all three from the rows above and below: two shuffles, whatever the number of neighbours.
    """
    along, down = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    sides = px.withColumns({"__e": F.lead(v).over(along), "__w": F.lag(v).over(along)})
    three = F.struct(F.col("__w").alias("w"), F.col(v).alias("c"), F.col("__e").alias("e"))
    out = sides.withColumns({"__up": F.lag(three).over(down), "__down": F.lead(three).over(down)})
    named = ["__e", "__up.e", "__up.c", "__up.w", "__w", "__down.w", "__down.c", "__down.e"]
    return out.select(*px.columns, *(F.col(c).alias(f"{prefix}{k}") for k, c in enumerate(named)))


def _gradient(rows: list[tuple[Column, Column, Column, int]], centre: Column) -> tuple[Column, Column]:
    """Numerator and denominator of a one-axis difference: (first, middle, last, weight) of three lines."""
    num, den = F.lit(0.0), F.lit(0.0)
    for a, b, c, weight in rows:
        both = a.isNotNull() & c.isNotNull()
        if weight == 2:  # the line through the centre
            n = F.when(both, 2 * (a - c)).when(a.isNotNull(), 2 * (a - centre)).when(c.isNotNull(), 2 * (centre - c)).otherwise(0.0)
            d = F.when(both, 4).when(a.isNotNull() | c.isNotNull(), 2).otherwise(0)
        else:
            n = F.when(both, a - c).when(a.isNotNull() & b.isNotNull(), a - b).when(b.isNotNull() & c.isNotNull(), b - c)
            n = n.when(a.isNotNull(), (a - centre) * SQRT2).when(c.isNotNull(), (centre - c) * SQRT2).otherwise(0.0)
            d = F.when(both, 2).when(a.isNotNull() | c.isNotNull(), 1).otherwise(0)
        num, den = num + n, den + d
    return num, den


def slope(dem: Grid) -> Grid:
    """Slope in percent by finite differences over 3x3 cells; missing neighbours fall back to what is there."""
    df = stencil(dem.px.select("y", "x", F.col("v").cast("double").alias("v")))
    e = F.col("v")
    f, c, b, a, d, g, h, i = (F.col(f"n{k}") for k in range(8))
    parts = []
    for rows, size in (([(a, b, c, 1), (d, e, f, 2), (g, h, i, 1)], dem.gt[1]), ([(a, d, g, 1), (b, e, h, 2), (c, f, i, 1)], dem.gt[5])):
        num, den = _gradient(rows, e)
        parts.append(F.when(den == 0, 0.0).otherwise(num / F.nullif(den * F.lit(float(size)), F.lit(0.0))))
    out = F.when(e.isNotNull(), 100.0 * F.sqrt(parts[0] * parts[0] + parts[1] * parts[1]))
    return dem.with_px(df.select("y", "x", out.alias("v")), dtype="float32", nodata=float(np.finfo(np.float32).min))


# ---------------------------------------------------------------- kernels
def kernel(spark: SparkSession, function: Callable[[Column], Column] | str, max_distance: float, normalize: bool = True) -> DataFrame:
    """(ky, kx, w): ``function`` of the distance in pixels to the centre, 0 beyond ``max_distance``.

    The size is ``2 * floor(max_distance) + 1``; a text is compiled with the symbol ``dist``.
    """
    r = int(np.floor(max_distance))
    n = 2 * r + 1
    ky, kx = F.expr(f"id div {n}"), F.expr(f"id % {n}")
    dist = F.sqrt((ky - r) * (ky - r) + (kx - r) * (kx - r)).cast("double")
    value = compile_expression(function, {"dist": F.col("dist")}) if isinstance(function, str) else function(F.col("dist"))
    out = spark.range(n * n).select(ky.alias("ky"), kx.alias("kx"), dist.alias("dist")).select("ky", "kx", F.when(F.col("dist") <= max_distance, value.cast("double")).otherwise(0.0).alias("w"))
    if normalize:
        total = out.agg(F.sum("w").alias("total"))
        out = out.crossJoin(F.broadcast(total)).select("ky", "kx", (F.col("w") / F.col("total")).alias("w"))
    return out


def dichotomous_kernel(spark: SparkSession, max_distance: float, normalize: bool = True) -> DataFrame:
    return kernel(spark, lambda d: F.lit(1.0), max_distance, normalize)


def exponential_decay_kernel(spark: SparkSession, max_distance: float, expected_distance: float, normalize: bool = True) -> DataFrame:
    return kernel(spark, lambda d: F.exp(-d / expected_distance), max_distance, normalize)


def linear_decay_kernel(spark: SparkSession, max_distance: float, normalize: bool = True) -> DataFrame:
    return kernel(spark, lambda d: (max_distance - d) / max_distance, max_distance, normalize)


def normal_distribution_kernel(spark: SparkSession, sigma: float, n_std_dev: float = 3.0, normalize: bool = True) -> DataFrame:
    return kernel(spark, lambda d: F.exp(-(d * d) / (2 * sigma**2)) / (2 * np.pi * sigma**2), sigma * n_std_dev, normalize)


def kernel_from_array(spark: SparkSession, array: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(y), int(x), float(w)) for (y, x), w in np.ndenumerate(array)], "ky long, kx long, w double")


def next_regular(n: int) -> int:
    """The least number from ``n`` on whose prime factors are 2, 3 and 5 only."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m > 1 and m % p == 0:
                m //= p
        if m <= 1:
            return max(n, 1)
        n += 1


# ---------------------------------------------------------------- convolution
SCATTER = 121


def convolve_2d(signal: Grid, kernel: DataFrame, ignore_nodata_and_edges: bool = False, mask_nodata: bool = True, normalize_kernel: bool = False, set_tol_to_zero: float | None = 1e-8, nodata: float | None = None, tile: int = 256) -> Grid:
    """Convolution with the kernel centred at n // 2; nodata counts as 0.

    A kernel is a small table by contract and is collected.  Up to ``SCATTER`` weights every
    cell is sent to the cells it reaches and summed there, in SQL with partial sums before the
    shuffle; larger kernels convolve tiles with a halo of half a kernel by FFT.
    """
    k = [(int(r.ky), int(r.kx), float(r.w)) for r in kernel.select("ky", "kx", "w").collect()]
    kh, kw = 1 + max(r[0] for r in k), 1 + max(r[1] for r in k)
    weights = np.zeros((kh, kw))
    for y, x, w in k:
        weights[y, x] = w
    total = weights.sum()
    if normalize_kernel:
        weights = weights / total
    if len(k) <= SCATTER:
        sums = _scatter(signal, weights)
    else:
        sums = _tiles(signal, weights, tile)
    out = F.col("s")
    if ignore_nodata_and_edges:
        out = F.when(F.col("m") > 0, F.col("s") / F.nullif(F.col("m"), F.lit(0.0)) * (1.0 if normalize_kernel else float(total))).otherwise(F.col("s"))
    if set_tol_to_zero is not None:
        out = F.when(F.abs(out) <= set_tol_to_zero, 0.0).otherwise(out)
    joined = signal.px.select("y", "x", "v").join(sums, ["y", "x"])
    if mask_nodata:
        out = F.when(F.col("v").isNotNull(), out)
    return signal.with_px(joined.select("y", "x", out.alias("v")), dtype="float64", nodata=nodata if nodata is not None else float(np.finfo(np.float64).max))


def _scatter(signal: Grid, weights: np.ndarray) -> DataFrame:
    """(y, x, s, m): sums of values and of weights on valid cells."""
    cy, cx = weights.shape[0] // 2, weights.shape[1] // 2
    taps = F.array(*(F.struct(F.lit(int(y - cy)).cast("long").alias("dy"), F.lit(int(x - cx)).cast("long").alias("dx"), F.lit(float(w)).alias("w")) for (y, x), w in np.ndenumerate(weights)))
    v = F.coalesce(F.col("v").cast("double"), F.lit(0.0))
    sent = signal.px.select("y", "x", v.alias("v"), F.col("v").isNotNull().cast("double").alias("ok"), F.explode(taps).alias("t"))
    to = sent.select((F.col("y") + F.col("t.dy")).alias("y"), (F.col("x") + F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.w")).alias("s"), (F.col("ok") * F.col("t.w")).alias("m"))
    inside = to.filter(F.col("y").between(0, signal.n_rows - 1) & F.col("x").between(0, signal.n_cols - 1))
    return inside.groupBy("y", "x").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))


def _tiles(signal: Grid, weights: np.ndarray, tile: int) -> DataFrame:
    """The same sums from tiles: a cell goes to every tile whose halo it is in."""
    kh, kw = weights.shape
    cy, cx = kh // 2, kw // 2
    n_rows, n_cols = signal.n_rows, signal.n_cols
    size = max(tile, kh, kw)

    def reach(at: str, before: int, after: int, n: int) -> Column:
        lo = F.greatest(F.lit(0), F.floor((F.col(at) - after) / size))
        hi = F.least(F.lit((n - 1) // size), F.floor((F.col(at) + before) / size))
        return F.explode(F.sequence(lo.cast("long"), hi.cast("long")))

    px = signal.px.select("y", "x", F.col("v").cast("double").alias("v"))
    halo = px.withColumn("ty", reach("y", kh, kh, n_rows)).withColumn("tx", reach("x", kw, kw, n_cols))

    def convolve(key: tuple, table: pa.Table) -> pa.Table:
        ty, tx = (k.as_py() for k in key)
        y0, x0 = ty * size, tx * size
        h, w = min(size, n_rows - y0), min(size, n_cols - x0)
        y, x, v = (table[c].to_numpy() for c in ("y", "x", "v"))
        ok = ~np.isnan(v)
        shape = [next_regular(h + 3 * kh), next_regular(w + 3 * kw)]
        ft = np.fft.rfft2(weights, shape)
        out = []
        for values in (np.where(ok, v, 0), ok.astype(float)):
            block = np.zeros((h + 2 * kh, w + 2 * kw))
            yy, xx = y - y0 + kh, x - x0 + kw
            use = (yy >= 0) & (yy < block.shape[0]) & (xx >= 0) & (xx < block.shape[1])
            block[yy[use], xx[use]] = values[use]
            full = np.fft.irfft2(np.fft.rfft2(block, shape) * ft, shape)
            out.append(full[kh + cy : kh + cy + h, kw + cx : kw + cx + w])
        gy, gx = np.mgrid[y0 : y0 + h, x0 : x0 + w]
        return pa.table({"y": gy.ravel(), "x": gx.ravel(), "s": out[0].ravel(), "m": out[1].ravel()})

    return halo.groupBy("ty", "tx").applyInArrow(convolve, "y long, x long, s double, m double")


# ---------------------------------------------------------------- distance transform
#: Cells of a strip of whole rows that one task settles.
STRIP = 1 << 16


def distance_transform_edt(region: Grid, sampling: tuple[float, float] = (1.0, 1.0)) -> Grid:
    """Exact Euclidean distance to the nearest cell that is neither 0 nor nodata.

    Strips of whole rows are settled each in one go: along columns the nearest region row lies in
    the strip, or is the last one above or the first one below it; along rows the lower envelope of
    parabolas.  What lies above and below is found on a row per strip and column.  Without any
    region cell all values are NULL.
    """
    if not (isinstance(sampling, tuple) and len(sampling) == 2 and all(s > 0 for s in sampling)):
        raise ValueError("sampling must be a tuple of two positive numbers (x, y)")
    sx, sy = float(sampling[0]), float(sampling[1])
    n_rows, n_cols, rows = region.n_rows, region.n_cols, max(1, STRIP // region.n_cols)
    last = (n_rows - 1) // rows
    cells = region.px.select(F.expr(f"y div {rows}").alias("strip"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.col("v").isNotNull() & (F.col("v") != 0)).cast("int").alias("kind"))
    own = cells.filter("kind = 1").groupBy("x", "strip").agg(F.min("y").alias("first"), F.max("y").alias("last"))
    order = Window.partitionBy("x").orderBy("strip")
    own = own.withColumns({"before": F.coalesce(F.lag("strip").over(order), F.lit(0)), "after": F.coalesce(F.lead("strip").over(order), F.lit(last))})
    below = own.filter("strip > before").select(F.explode(F.sequence("before", F.col("strip") - 1)).alias("strip"), F.col("first").alias("y"), "x", F.lit(2).alias("kind"))
    above = own.filter("after > strip").select(F.explode(F.sequence(F.col("strip") + 1, "after")).alias("strip"), F.col("last").alias("y"), "x", F.lit(2).alias("kind"))

    def nearest(key: tuple, table: pa.Table) -> pa.Table:
        y, x, kind = (table[c].to_numpy() for c in ("y", "x", "kind"))
        y0 = key[0].as_py() * rows
        h = min(rows, n_rows - y0)
        at_row = np.arange(y0, y0 + h, dtype=float)[:, None]
        up, down = np.full((h + 1, n_cols), -np.inf), np.full((h + 1, n_cols), np.inf)
        hit, far = kind == 1, kind == 2
        up[y[hit] - y0 + 1, x[hit]] = down[y[hit] - y0, x[hit]] = y[hit]
        over, under = far & (y < y0), far & (y >= y0 + h)
        up[0, x[over]], down[h, x[under]] = y[over], y[under]
        g = np.minimum(at_row - np.maximum.accumulate(up)[1:], np.minimum.accumulate(down[::-1])[::-1][:-1] - at_row)
        some = np.flatnonzero(np.isfinite(g[0]))  # a column has a region cell or not, in all rows alike
        mine = kind < 2
        if not len(some):
            return pa.table({"y": y[mine], "x": x[mine], "v": pa.nulls(int(mine.sum()), pa.float64())})
        where, at = np.arange(n_cols) * sx, some * sx
        height = (g[:, some] * sy) ** 2
        v = np.empty((h, n_cols))
        for r in range(h):
            kept = _envelope(at, height[r])
            own = kept[0][np.searchsorted(kept[1], where, side="right") - 1]
            v[r] = np.sqrt((where - at[own]) ** 2 + height[r][own])
        return pa.table({"y": y[mine], "x": x[mine], "v": v[y[mine] - y0, x[mine]]})

    px = cells.unionByName(below).unionByName(above).groupBy("strip").applyInArrow(nearest, "y long, x long, v double")
    return region.with_px(px, dtype="float32", nodata=-1.0)


def _envelope(at: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which parabolas over ``at`` are lowest somewhere, and from where on each is."""
    x, square, high = at.tolist(), (at**2).tolist(), height.tolist()
    kept, cuts = [0], [-math.inf]
    for i in range(1, len(x)):
        while True:
            j = kept[-1]
            cut = (high[i] + square[i] - high[j] - square[j]) / (2 * (x[i] - x[j]))
            if cut > cuts[-1]:
                break
            kept.pop()
            cuts.pop()
        kept.append(i)
        cuts.append(cut)
    return np.array(kept), np.array(cuts)


# ---------------------------------------------------------------- overviews
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "average": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "mode": lambda v: F.mode(v, True),
    "med": lambda v: F.percentile(v, 0.5),
    "q1": lambda v: F.percentile(v, 0.25),
    "q3": lambda v: F.percentile(v, 0.75),
    "rms": lambda v: F.sqrt(F.avg(v * v)),
}


def overview(grid: Grid, factor: int, method: str = "near") -> Grid:
    """The grid at 1/factor of its size, each cell an aggregate of the valid cells it covers."""
    v = F.col("v")
    agg = F.min_by(v, F.struct("y", "x")) if method == "near" else AGGREGATES[method](v.cast("double"))
    key = [F.expr(f"y div {factor}").alias("oy"), F.expr(f"x div {factor}").alias("ox")]
    px = grid.px.groupBy(*key).agg(agg.alias("v")).select(F.col("oy").alias("y"), F.col("ox").alias("x"), "v")
    g = grid.gt
    return grid.with_px(px, n_rows=-(-grid.n_rows // factor), n_cols=-(-grid.n_cols // factor), gt=(g[0], g[1] * factor, g[2] * factor, g[3], g[4] * factor, g[5] * factor))


def overview_levels(n_cols: int, n_rows: int, least: int = 256) -> list[int]:
    """Factors 2, 4, ... while a side of the grid at that factor is longer than ``least``."""
    out, factor = [], 2
    while max(-(-n_cols // factor), -(-n_rows // factor)) > least:
        out.append(factor)
        factor *= 2
    return out


def build_overviews(grid: Grid, method: str = "near", levels: list[int] | str = "auto") -> dict[int, Grid]:
    chosen = overview_levels(grid.n_cols, grid.n_rows) if levels == "auto" else list(levels)
    return {f: overview(grid, f, method) for f in chosen}


def iterblocks(grid: Grid, block: int = 256, largest: int = 1 << 16) -> Iterator[dict]:
    """Windows of the grid in row-major order: blocks widened to at most ``largest`` cells, then made taller."""
    w = min(grid.n_cols, block * max(1, int(largest / block**2)))
    h = min(grid.n_rows, block * max(1, int(largest / (block * w))) if w >= grid.n_cols else block)
    for y in range(0, grid.n_rows, h):
        for x in range(0, grid.n_cols, w):
            yield {"xoff": x, "yoff": y, "win_xsize": min(w, grid.n_cols - x), "win_ysize": min(h, grid.n_rows - y)}
