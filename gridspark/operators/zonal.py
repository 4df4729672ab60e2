"""Zonal statistics: cells of a grid summed up per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.model import Grid
from gridspark.operators.vector import spans, with_bbox

STATS = ("v_min", "v_max", "v_sum", "v_count", "v_avg", "nodata_count")


def _aggregates(v: Column) -> list[Column]:
    return [F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.coalesce(F.sum(v), F.lit(0.0)).alias("v_sum"), F.count(v).alias("v_count"), F.avg(v).alias("v_avg"), F.count_if(v.isNull()).alias("nodata_count")]


def zone_cells(zones: DataFrame, grid: Grid) -> DataFrame:
    """(fid, y, x) by cell centres; a zone without any centre takes the cells that its box meets.

    Overlapping zones need no separation: a cell simply belongs to several.
    """
    centre = spans(zones, grid).select("fid", "y", "x0", "x1")
    g = grid.gt
    missed = with_bbox(zones).filter("bbox is not null").join(centre.select("fid").distinct(), "fid", "left_anti")
    ends = [((F.col(f"bbox.{a}") - o) / p) for a, o, p in (("minx", g[0], g[1]), ("maxx", g[0], g[1]), ("miny", g[3], g[5]), ("maxy", g[3], g[5]))]
    x0, x1 = F.least(ends[0], ends[1]), F.greatest(ends[0], ends[1])
    y0, y1 = F.least(ends[2], ends[3]), F.greatest(ends[2], ends[3])
    window = missed.select(
        "fid",
        F.greatest(F.floor(y0), F.lit(0)).alias("y0"),
        F.least(F.ceil(y1) - 1, F.lit(grid.n_rows - 1)).alias("y1"),
        F.greatest(F.floor(x0), F.lit(0)).alias("x0"),
        F.least(F.ceil(x1) - 1, F.lit(grid.n_cols - 1)).alias("x1"),
    ).filter("y0 <= y1 and x0 <= x1")
    boxed = window.select("fid", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    return centre.unionByName(boxed).select("fid", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def zonal_statistics(grids: Grid | Sequence[Grid], zones: DataFrame, include_value_counts: bool = False) -> DataFrame:
    """One row per zone (and grid): min, max, sum, count, mean and nodata count of its cells.

    Zones without any cell have NULL min, max and mean, and zeros.  Grids must share size, place
    and coordinate system.
    """
    stack = [grids] if isinstance(grids, Grid) else list(grids)
    for g in stack[1:]:
        for name in ("gt", "bounding_box", "crs"):
            if getattr(g, name) != getattr(stack[0], name):
                raise ValueError(f"grids differ in {name}")
    cells = zone_cells(zones, stack[0])
    out = []
    for band, g in enumerate(stack):
        joined = cells.join(g.px.select("y", "x", F.col("v").cast("double").alias("v")), ["y", "x"])
        stats = joined.groupBy("fid").agg(*_aggregates(F.col("v")))
        if include_value_counts:
            counted = joined.filter("v is not null").groupBy("fid", "v").agg(F.count("*").alias("n"))
            histogram = counted.groupBy("fid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("value_counts"))
            stats = stats.join(histogram, "fid", "left")
        row = zones.select("fid").join(stats, "fid", "left").fillna({"v_sum": 0.0, "v_count": 0, "nodata_count": 0})
        out.append(row.withColumn("band", F.lit(band)) if len(stack) > 1 else row)
    for extra in out[1:]:
        out[0] = out[0].unionByName(extra)
    return out[0]
