"""Registered queries of the raster, vector and flow operators, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import wkb
from gridspark.operators import algebra, flow, focal, grids, hydrography, vector, zonal
from gridspark.operators.model import Grid, is_close
from gridspark.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` may use the views of ``views.SQL``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {views.SQL.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register


def rounded(grid: Grid, name: str = "v", digits: int = 6, off: float = 0.0) -> DataFrame:
    """``off`` moves sums of binary fractions, whose last bits follow the order of summation, off the edge between two roundings."""
    return grid.px.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.round(F.col("v").cast("double") + off, digits) + 0.0).alias(name))


def whole(grid: Grid, name: str = "v") -> DataFrame:
    return grid.px.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias(name))


# ---------------------------------------------------------------- pixel algebra
@query("SELECT q.y, q.x, CASE WHEN q.v IS NULL OR r.v IS NULL THEN NULL ELSE q.v + r.v * 2 END AS v FROM qty q JOIN qty r ON r.y = q.y AND r.x = 63 - q.x")
def raster_map_sum(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    mirrored = q.with_px(q.px.select("y", (63 - F.col("x")).alias("x"), "v"))
    return whole(algebra.raster_map(lambda a, b: a + b * 2, q, mirrored))


@query("SELECT y, x, CAST(coalesce(v, -1) * 3 + x AS DOUBLE) AS v FROM qty")
def raster_calc_broadcast(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return rounded(algebra.raster_calculator([q, 3.0, np.arange(64.0)], lambda a, b, c: a * b + c, "float64", None))


@query("SELECT y, x, CASE WHEN v IS NULL THEN NULL WHEN v = 100 THEN -9999.0 ELSE round((v + 100.0) / (v - 100.0), 6) + 0.0 END AS v FROM qty")
def expr_ndvi_default_inf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(algebra.evaluate_expression("(a + 100) / (a - 100)", {"a": views.qty(spark, d)}, nodata=-1, default_inf=-9999.0, default_nan=-9998.0))


@query("SELECT y, x, CASE WHEN v IS NULL THEN NULL WHEN v > 1000 AND x < 32 OR x >= 60 THEN 2 * v ELSE -v END AS v FROM qty")
def expr_logic(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    cols = q.with_px(q.px.select("y", "x", F.col("x").alias("v")))
    out = algebra.evaluate_expression("where((a > 1000) & (c < 32) | (c >= 60), 2 * a, -a)", {"a": q, "c": cols}, nodata=-1)
    return whole(algebra.raster_map(lambda v, q: v, out, q))


CLASSES = {float(k): float(k % 5) for k in range(10)}


@query("SELECT y, x, CAST(CASE WHEN v IS NULL THEN 9 ELSE (v % 10) % 5 END AS DOUBLE) AS v FROM qty")
def reclassify_strict(spark: SparkSession, d: str) -> DataFrame:
    digit = algebra.raster_map(lambda v: v % 10, views.qty(spark, d), nodata=-1, dtype="int64")
    return rounded(algebra.reclassify(digit, CLASSES | {-1.0: 9.0}))


@query("SELECT y, x, CAST(CASE WHEN v % 10 < 5 THEN v % 10 ELSE NULL END AS DOUBLE) AS v FROM qty")
def reclassify_missing(spark: SparkSession, d: str) -> DataFrame:
    digit = algebra.raster_map(lambda v: v % 10, views.qty(spark, d), nodata=-1, dtype="int64")
    return rounded(algebra.reclassify(digit, {k: v for k, v in CLASSES.items() if k < 5}, nodata=-1.0, required=False))


@query("SELECT CAST(min(v) AS DOUBLE) AS v_min, CAST(max(v) AS DOUBLE) AS v_max, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, round(100.0 * count(v) / count(*), 2) AS valid_percent FROM qty")
def stats_observe(spark: SparkSession, d: str) -> DataFrame:
    return algebra.statistics(views.qty(spark, d)).select("v_min", "v_max", F.round("v_mean", 6).alias("v_mean"), F.round("v_std", 6).alias("v_std"), "valid_percent")


@query("SELECT CAST(sum(v) AS DOUBLE) AS total, count(v) AS n FROM qty")
def reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    """A mergeable reducer over partitions: sum and count of the cells with data."""
    q = views.qty(spark, d)
    total = algebra.raster_reduce(lambda a, b: a + b, q, 0.0, merge=lambda a, b: a + b)
    n = algebra.raster_reduce(lambda a, b: a + 1, q, 0, merge=lambda a, b: a + b)
    return spark.createDataFrame([(float(total), int(n))], "total double, n long")


@query(
    """, ranked AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM qty WHERE v IS NOT NULL),
cuts AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([0.0, 22.5, 50.0, 72.1, 99.0]) AS p)
SELECT k, CAST(min(v) AS DOUBLE) AS v FROM cuts, ranked WHERE (CAST(100.0 AS DOUBLE) / n) * i >= p GROUP BY k"""
)
def percentile_higher(spark: SparkSession, d: str) -> DataFrame:
    return algebra.percentiles(views.qty(spark, d), [0, 22.5, 50, 72.1, 99])


@query("SELECT v, count(*) AS n FROM qty WHERE v IS NOT NULL GROUP BY v")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return algebra.value_counts(views.qty(spark, d))


@query("SELECT q.y, q.x, CASE WHEN (q.x + q.y) % 3 = 1 THEN q.v END AS v FROM qty q")
def mask_by_grid(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return whole(algebra.mask_by_grid(q, q.with_px(q.px.select("y", "x", ((F.col("x") + F.col("y")) % 3).alias("v")))))


@query("SELECT y, x, CASE WHEN v IS NULL THEN NULL WHEN v > 1500 THEN 1 ELSE 0 END AS v FROM qty")
def streams_d8(spark: SparkSession, d: str) -> DataFrame:
    return whole(algebra.extract_streams_d8(views.qty(spark, d), 1500))


# ---------------------------------------------------------------- zones and features
IN_ZONE = "JOIN qty q ON q.y BETWEEN z.y0 AND z.y0 + 5 AND q.x BETWEEN z.x0 AND z.x0 + 11"


@query(f"SELECT z.fid, CAST(min(v) AS DOUBLE) AS v_min, CAST(max(v) AS DOUBLE) AS v_max, CAST(sum(v) AS DOUBLE) AS v_sum, count(v) AS v_count, round(avg(v), 6) AS v_avg, count(*) - count(v) AS nodata_count FROM zones z {IN_ZONE} GROUP BY z.fid")
def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return zonal.zonal_statistics(q, views.zones(spark, d, q)).withColumn("v_avg", F.round("v_avg", 6))


@query(f"SELECT z.fid, b.band, CAST(sum(CASE WHEN b.band = 0 THEN v ELSE 2 * v END) AS DOUBLE) AS v_sum, count(v) AS v_count FROM zones z {IN_ZONE}, (SELECT unnest([0, 1]) AS band) b GROUP BY z.fid, b.band")
def zonal_multi_band(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return zonal.zonal_statistics([q, algebra.raster_map(lambda v: 2 * v, q)], views.zones(spark, d, q)).select("fid", "band", "v_sum", "v_count")


@query(f"SELECT z.fid, q.v, count(*) AS n FROM zones z {IN_ZONE} WHERE q.v IS NOT NULL GROUP BY z.fid, q.v")
def zonal_value_counts(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    rows = zonal.zonal_statistics(q, views.zones(spark, d, q), include_value_counts=True)
    return rows.select("fid", F.explode("value_counts").alias("v", "n")).select("fid", F.col("v").cast("long").alias("v"), "n")


@query("SELECT CAST(n_nationkey AS BIGINT) AS fid, q.v AS v_sum FROM nation JOIN qty q ON q.y = n_nationkey AND q.x = 3")
def zonal_envelope_fallback(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)

    @F.pandas_udf("binary")
    def sliver(y):
        return y.map(lambda k: wkb.box(3.1, -(k + 0.3), 3.2, -(k + 0.1)))

    small = views.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("fid")).withColumn("geom", sliver("fid"))
    return zonal.zonal_statistics(q, small).select("fid", F.col("v_sum").cast("long").alias("v_sum"))


@query("SELECT q.y, q.x, CASE WHEN EXISTS (SELECT 1 FROM zones z WHERE q.y BETWEEN z.y0 AND z.y0 + 5 AND q.x BETWEEN z.x0 AND z.x0 + 11) THEN q.v END AS v FROM qty q")
def mask_rect(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return whole(vector.mask(q, views.zones(spark, d, q)))


@query("SELECT q.y, q.x, CASE WHEN max(z.fid) IS NULL THEN q.v ELSE coalesce(q.v, 0) + sum(z.fid) END AS v FROM qty q LEFT JOIN zones z ON q.y BETWEEN z.y0 AND z.y0 + 5 AND q.x BETWEEN z.x0 AND z.x0 + 11 GROUP BY q.y, q.x, q.v")
def rasterize_add(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return whole(vector.rasterize(views.zones(spark, d, q), q, "fid", merge="add"))


@query("SELECT q.y, q.x, coalesce(max(CASE WHEN z.fid % 2 = 0 THEN z.fid END), q.v) AS v FROM qty q LEFT JOIN zones z ON q.y BETWEEN z.y0 AND z.y0 + 5 AND q.x BETWEEN z.x0 AND z.x0 + 11 GROUP BY q.y, q.x, q.v")
def rasterize_replace(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return whole(vector.rasterize(views.zones(spark, d, q), q, "fid", where="fid % 2 = 0"))


@query("SELECT a.fid AS a, b.fid AS b FROM zones a JOIN zones b ON a.fid < b.fid AND a.y0 <= b.y0 + 6 AND b.y0 <= a.y0 + 6 AND a.x0 <= b.x0 + 12 AND b.x0 <= a.x0 + 12")
def zone_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return vector.conflicts(views.zones(spark, d, views.qty(spark, d)), 10.0)


@query()
def disjoint_sets(spark: SparkSession, d: str) -> DataFrame:
    found = vector.disjoint_sets(views.zones(spark, d, views.qty(spark, d)))
    return spark.createDataFrame([(k, int(fid)) for k, s in enumerate(found) for fid in sorted(s)], "set_id long, fid long")


@query("SELECT CAST(v // 400 AS BIGINT) AS label, CAST(count(*) AS DOUBLE) AS area FROM qty WHERE v IS NOT NULL GROUP BY 1")
def polygonize_area(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return vector.polygonize(q.px.filter("v is not null").select("y", "x", F.expr("v div 400").alias("c")), "c", q).select("label", "area")


@query(
    """, p AS (SELECT CAST(n_nationkey AS DOUBLE) AS k, (n_nationkey * 7) % 64 AS px, n_nationkey * 3 + 0.25 AS py FROM nation)
SELECT y, x, k AS v FROM (SELECT q.y, q.x, k, row_number() OVER (PARTITION BY q.y, q.x ORDER BY (q.x - px) * (q.x - px) + (q.y - py) * (q.y - py), px, -py) AS r FROM qty q, p) WHERE r = 1"""
)
def interpolate_near(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    points = views.table(spark, d, "nation").select(((F.col("n_nationkey") * 7) % 64).alias("x"), (-(F.col("n_nationkey") * 3 + 0.25)).alias("y"), F.col("n_nationkey").alias("v"))
    return rounded(vector.interpolate_points(points, "v", q))


# ---------------------------------------------------------------- grids
def _mosaic(spark: SparkSession, d: str, overlap: str) -> DataFrame:
    q = views.qty(spark, d)
    blank = grids.new_grid(q, -1, n_rows=q.n_rows, n_cols=64)
    shifted = Grid(q.px.select("y", "x", (F.col("v") * 10).alias("v")), q.n_rows, 64, (8.0, 1.0, 0.0, -4.0, 0.0, -1.0), dtype="int64", nodata=-1)
    cropped = q.with_px(q.px.filter("x < 40").select("y", "x", "v"), n_cols=40)
    return whole(grids.stitch(blank, [cropped, shifted], overlap))


MOSAIC = "FROM qty g LEFT JOIN qty a ON a.y = g.y AND a.x = g.x AND a.x < 40 LEFT JOIN qty b ON b.y = g.y - 4 AND b.x = g.x - 8"


@query(f"SELECT g.y, g.x, coalesce(a.v, b.v * 10) AS v {MOSAIC}")
def stitch_etch(spark: SparkSession, d: str) -> DataFrame:
    return _mosaic(spark, d, "etch")


@query(f"SELECT g.y, g.x, coalesce(b.v * 10, a.v) AS v {MOSAIC}")
def stitch_replace(spark: SparkSession, d: str) -> DataFrame:
    return _mosaic(spark, d, "replace")


@query(f"SELECT g.y, g.x, CASE WHEN a.v IS NULL AND b.v IS NULL THEN NULL ELSE coalesce(a.v, 0) + coalesce(b.v * 10, 0) END AS v {MOSAIC}")
def stitch_add(spark: SparkSession, d: str) -> DataFrame:
    return _mosaic(spark, d, "add")


@query("SELECT CAST(min(x0) AS DOUBLE) AS minx, CAST(-max(y0 + 6) AS DOUBLE) AS miny, CAST(max(x0 + 12) AS DOUBLE) AS maxx, CAST(-min(y0) AS DOUBLE) + 0.0 AS maxy FROM zones")
def bbox_union(spark: SparkSession, d: str) -> DataFrame:
    found = vector.vector_info(views.zones(spark, d, views.qty(spark, d)))
    return found.select(*((F.col(c) + 0.0).alias(c) for c in found.columns))


@query("SELECT CAST(max(x0) AS DOUBLE) AS minx, CAST(-min(y0 + 6) AS DOUBLE) AS miny, CAST(min(x0 + 12) AS DOUBLE) AS maxx, CAST(-max(y0) AS DOUBLE) AS maxy FROM zones WHERE fid BETWEEN 1 AND 2")
def bbox_intersection(spark: SparkSession, d: str) -> DataFrame:
    two = vector.with_bbox(views.zones(spark, d, views.qty(spark, d)).filter("fid between 1 and 2"))
    return grids.boxes_of(two, "intersection")


@query("SELECT g.y, g.x, q.v FROM (SELECT y, x FROM qty WHERE x < 32 AND y < (SELECT n FROM qrows) // 2) g JOIN qty q ON q.y = g.y * 2 + 1 AND q.x = g.x * 2 + 1")
def align_near(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    n = 2 * (q.n_rows // 2)
    return whole(grids.align_stack([q], ["near"], (2.0, -2.0), [0.0, -float(n), 64.0, 0.0])[0])


@query("SELECT g.y // 2 AS y, g.x // 2 AS x, round(avg(v), 6) + 0.0 AS v FROM qty g WHERE y < 2 * ((SELECT n FROM qrows) // 2) GROUP BY 1, 2")
def warp_average(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    n = 2 * (q.n_rows // 2)
    return rounded(grids.warp(q, (2.0, -2.0), "average", [0.0, -float(n), 64.0, 0.0]))


@query(
    """, taps AS (SELECT unnest([0, 1]) AS d), px AS (SELECT y, x FROM emb),
w AS (SELECT p.y, p.x, CASE WHEN a.d = 0 THEN 0.5 ELSE 0.5 END * 0.5 AS w, least(p.y + a.d, (SELECT max(y) FROM emb)) AS sy, least(p.x + b.d, 63) AS sx FROM px p, taps a, taps b WHERE p.x < 63 AND p.y < (SELECT max(y) FROM emb))
SELECT w.y, w.x, round(sum(w.w * e.v) / sum(w.w), 6) + 0.0 AS v FROM w JOIN emb e ON e.y = w.sy AND e.x = w.sx GROUP BY 1, 2"""
)
def warp_bilinear(spark: SparkSession, d: str) -> DataFrame:
    e = views.emb(spark, d)
    out = grids.warp(e, (1.0, -1.0), "bilinear", [0.5, -(e.n_rows - 0.5), 63.5, -0.5])
    return rounded(out)


@query("SELECT y // 4 AS y, x // 4 AS x, round(avg(v), 6) + 0.0 AS v FROM qty GROUP BY 1, 2")
def overview_avg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(focal.overview(views.qty(spark, d), 4, "average"))


@query(
    """, c AS (SELECT y // 4 AS y, x // 4 AS x, v // 300 AS v, count(*) AS n FROM qty WHERE v IS NOT NULL GROUP BY 1, 2, 3)
SELECT y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, v) AS r FROM c) WHERE r = 1"""
)
def overview_mode(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    return whole(focal.overview(algebra.raster_map(lambda v: F.expr("v0 div 300"), q), 4, "mode"))


@query("SELECT y // 4 AS y, x // 4 AS x, round(quantile_cont(v, 0.5), 6) + 0.0 AS med, round(quantile_cont(v, 0.25), 6) + 0.0 AS q1, round(sqrt(avg(v * v)), 6) + 0.0 AS rms FROM emb GROUP BY 1, 2")
def overview_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = views.emb(spark, d)
    parts = [rounded(focal.overview(e, 4, m), m) for m in ("med", "q1", "rms")]
    return parts[0].join(parts[1], ["y", "x"]).join(parts[2], ["y", "x"])


@query("SELECT y // 4 AS y, x // 4 AS x, round(first(v ORDER BY y, x), 6) + 0.0 AS near, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high, round(sum(v), 6) + 0.0 AS total, round(quantile_cont(v, 0.75), 6) + 0.0 AS q3 FROM emb GROUP BY 1, 2")
def overview_rest(spark: SparkSession, d: str) -> DataFrame:
    e = views.emb(spark, d)
    parts = [rounded(focal.overview(e, 4, m), name) for m, name in (("near", "near"), ("min", "low"), ("max", "high"), ("sum", "total"), ("q3", "q3"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, ["y", "x"])
    return out


#: The ellipsoid's area between the equator and a latitude, per radian of longitude, in closed form.
_ZONE = "pi() * pow(6356752.3142, 2) * (ln((1 + e * sin(radians({0}))) / (1 - e * sin(radians({0})))) / (2 * e) + sin(radians({0})) / ((1 + e * sin(radians({0}))) * (1 - e * sin(radians({0})))))"


@query(f"SELECT y, round(abs({_ZONE.format('top')} - {_ZONE.format('(top - 0.5)')}) * 0.5 / 360, 2) AS area FROM (SELECT CAST(i AS BIGINT) AS y, 60 - i * 0.5::DOUBLE AS top, sqrt(1 - pow(6356752.3142 / 6378137.0, 2)) AS e FROM (SELECT unnest(range(240)) AS i))")
def pixel_areas(spark: SparkSession, d: str) -> DataFrame:
    return grids.latitude_areas(spark, -60.0, 60.0, 240).select("y", F.round("area", 2).alias("area"))


@query("SELECT n, min(m) AS regular FROM (SELECT unnest(range(1, 400)) AS n), (SELECT CAST(pow(2, a) * pow(3, b) * pow(5, c) AS BIGINT) AS m FROM (SELECT unnest(range(10)) AS a), (SELECT unnest(range(7)) AS b), (SELECT unnest(range(5)) AS c)) WHERE m >= n GROUP BY n")
def regular_sizes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, focal.next_regular(n)) for n in range(1, 400)], "n long, regular long")


@query("SELECT y, x, v IS NOT NULL AND abs(v - w) <= 1e-8 + 1e-5 * abs(w) AS same FROM (SELECT y, x, CAST(v AS DOUBLE) AS v, v * (1 + 0.000004::DOUBLE * (x % 5)) AS w FROM qty)")
def close_cells(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v").cast("double")
    return views.qty(spark, d).px.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(is_close(v, v * (1 + 0.000004 * (F.col("x") % 5))), F.lit(False)).alias("same"))


@query("SELECT CAST(ceil((max(x0) + 12 - min(x0)) / 2.0) AS BIGINT) AS n_cols, CAST(ceil((max(y0) + 6 - min(y0)) / 2.0) AS BIGINT) AS n_rows, CAST(min(x0) AS DOUBLE) AS left_x, CAST(-min(y0) AS DOUBLE) AS top_y, ceil((max(x0) + 12 - min(x0)) / 2.0)::BIGINT * ceil((max(y0) + 6 - min(y0)) / 2.0)::BIGINT AS cells FROM zones")
def grid_of_zones(spark: SparkSession, d: str) -> DataFrame:
    made = grids.grid_from_features(vector.with_bbox(views.zones(spark, d, views.qty(spark, d))), (2.0, -2.0), fill=1.0)
    return made.px.agg(F.count("v").alias("cells")).select(F.lit(made.n_cols).cast("long").alias("n_cols"), F.lit(made.n_rows).cast("long").alias("n_rows"), F.lit(float(made.gt[0])).alias("left_x"), F.lit(float(made.gt[3])).alias("top_y"), "cells")


@query("SELECT fid, name, CAST(72 AS DOUBLE) AS area FROM zones")
def layer_of_geometries(spark: SparkSession, d: str) -> DataFrame:
    """A layer made of local geometries and their attributes, and the areas of what it holds."""
    rows = views.zones(spark, d, views.qty(spark, d)).orderBy("fid").collect()  # a row per nation
    layer = vector.from_geometries(spark, [bytes(r.geom) for r in rows], {"name": "string"}, [{"name": r["name"]} for r in rows])
    area = F.pandas_udf(lambda geoms: geoms.map(lambda g: wkb.area(*wkb.read(g))), "double")
    return layer.select("fid", "name", area("geom").alias("area"))


@query("SELECT fid, floor((x0 + 0.3) / 2.5) * 2.5 AS minx, floor((-y0 - 5.6) / 1.5) * 1.5 AS miny, ceil((x0 + 11.7) / 2.5) * 2.5 AS maxx, ceil((-y0 - 0.4) / 1.5) * 1.5 AS maxy FROM zones")
def aligned_boxes(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    boxes = vector.with_bbox(views.zones(spark, d, q)).select("fid", "bbox.*").collect()  # a row per nation
    rows = [(r.fid, *map(float, grids.align_bbox((0.0, 2.5, 0.0, 0.0, 0.0, -1.5), [r.minx + 0.3, r.miny + 0.4, r.maxx - 0.3, r.maxy - 0.4]))) for r in boxes]
    return spark.createDataFrame(rows, "fid long, minx double, miny double, maxx double, maxy double")


# ---------------------------------------------------------------- focal
def _line(a: str, b: str, c: str, weight: int) -> tuple[str, str]:
    """Numerator and denominator of the difference along one line of three cells, as far as they have data."""
    both, root = f"{a} IS NOT NULL AND {c} IS NOT NULL", f"{focal.SQRT2!r}::DOUBLE"
    if weight == 2:
        return f"CASE WHEN {both} THEN 2 * ({a} - {c}) WHEN {a} IS NOT NULL THEN 2 * ({a} - z) WHEN {c} IS NOT NULL THEN 2 * (z - {c}) ELSE 0 END", f"CASE WHEN {both} THEN 4 WHEN {a} IS NOT NULL OR {c} IS NOT NULL THEN 2 ELSE 0 END"
    number = f"CASE WHEN {both} THEN {a} - {c} WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} - {b} WHEN {b} IS NOT NULL AND {c} IS NOT NULL THEN {b} - {c} WHEN {a} IS NOT NULL THEN ({a} - z) * {root} WHEN {c} IS NOT NULL THEN (z - {c}) * {root} ELSE 0 END"
    return number, f"CASE WHEN {both} THEN 2 WHEN {a} IS NOT NULL OR {c} IS NOT NULL THEN 1 ELSE 0 END"


def _axis(lines: list[tuple[str, str, str, int]]) -> str:
    parts = [_line(*x) for x in lines]
    num, den = (" + ".join(f"({p[k]})" for p in parts) for k in (0, 1))
    return f"coalesce(({num}) / nullif(CAST({den} AS DOUBLE), 0), 0)"


_SLOPES = (_axis([("n3", "n2", "n1", 1), ("n4", "z", "n0", 2), ("n5", "n6", "n7", 1)]), _axis([("n3", "n4", "n5", 1), ("n2", "z", "n6", 2), ("n1", "n0", "n7", 1)]))


@query()
def slope_pct(spark: SparkSession, d: str) -> DataFrame:
    """All cells of a grid with nodata, edges included."""
    return rounded(focal.slope(views.qty(spark, d)))


KERNEL = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]])
TAPS = ", k AS (SELECT i // 3 AS ky, i % 3 AS kx, CAST(i + 1 AS DOUBLE) AS w FROM (SELECT unnest(range(9)) AS i))"
REACH = "FROM qty q JOIN k ON true JOIN qty s ON s.y = q.y + 1 - k.ky AND s.x = q.x + 1 - k.kx"


@query(f"{TAPS} SELECT q.y, q.x, CASE WHEN q.v IS NULL THEN NULL ELSE round(sum(coalesce(s.v, 0) * w), 6) END AS v {REACH} GROUP BY q.y, q.x, q.v")
def convolve_3x3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(focal.convolve_2d(views.qty(spark, d), focal.kernel_from_array(spark, KERNEL)))


@query(f"{TAPS} SELECT q.y, q.x, CASE WHEN q.v IS NULL THEN NULL ELSE round(45 * sum(coalesce(s.v, 0) * w) / sum(CASE WHEN s.v IS NOT NULL THEN w END), 6) END AS v {REACH} GROUP BY q.y, q.x, q.v")
def convolve_ignore_nodata(spark: SparkSession, d: str) -> DataFrame:
    return rounded(focal.convolve_2d(views.qty(spark, d), focal.kernel_from_array(spark, KERNEL), ignore_nodata_and_edges=True))


@query(
    """, k AS (SELECT i // 13 AS ky, i % 13 AS kx, CASE WHEN sqrt(pow(i // 13 - 6, 2) + pow(i % 13 - 6, 2)) <= 6 THEN 1.0 ELSE 0.0 END AS w FROM (SELECT unnest(range(169)) AS i))
SELECT q.y, q.x, CASE WHEN q.v IS NULL THEN NULL ELSE CAST(round(sum(coalesce(s.v, 0) * w)) AS BIGINT) END AS v FROM qty q JOIN k ON w > 0 JOIN qty s ON s.y = q.y + 6 - k.ky AND s.x = q.x + 6 - k.kx GROUP BY q.y, q.x, q.v"""
)
def convolve_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A kernel beyond the scatter limit: FFT over tiles with halos."""
    q = views.qty(spark, d)
    out = focal.convolve_2d(q, focal.dichotomous_kernel(spark, 6, normalize=False), tile=40)
    return out.px.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("v").cast("long").alias("v"))


@query(
    """, k AS (SELECT i // 9 AS ky, i % 9 AS kx, greatest(4.5 - sqrt(pow(i // 9 - 4, 2) + pow(i % 9 - 4, 2)), 0) / 4.5 AS w FROM (SELECT unnest(range(81)) AS i))
SELECT ky, kx, round(w / (SELECT sum(w) FROM k), 9) AS w FROM k"""
)
def kernel_linear_decay(spark: SparkSession, d: str) -> DataFrame:
    return focal.linear_decay_kernel(spark, 4.5).select("ky", "kx", F.round("w", 9).alias("w"))


@query("SELECT ky, kx, round(w / sum(w) OVER (), 9) AS w FROM (SELECT i // 11 AS ky, i % 11 AS kx, CASE WHEN sqrt(pow(i // 11 - 5, 2) + pow(i % 11 - 5, 2)) <= 5.5 THEN exp(-sqrt(pow(i // 11 - 5, 2) + pow(i % 11 - 5, 2)) / 2) ELSE 0 END AS w FROM (SELECT unnest(range(121)) AS i))")
def kernel_exponential(spark: SparkSession, d: str) -> DataFrame:
    return focal.exponential_decay_kernel(spark, 5.5, 2.0).select("ky", "kx", F.round("w", 9).alias("w"))


@query("SELECT ky, kx, round(CASE WHEN d <= 4 THEN 1 / (1 + d) ELSE 0 END, 9) AS w FROM (SELECT i // 9 AS ky, i % 9 AS kx, sqrt(pow(i // 9 - 4, 2) + pow(i % 9 - 4, 2)) AS d FROM (SELECT unnest(range(81)) AS i))")
def kernel_text(spark: SparkSession, d: str) -> DataFrame:
    return focal.kernel(spark, "1 / (1 + dist)", 4.0, normalize=False).select("ky", "kx", F.round("w", 9).alias("w"))


@query("SELECT ky, kx, round(CASE WHEN d <= 6 THEN exp(-d * d / 8) / (8 * pi()) ELSE 0 END, 9) AS w FROM (SELECT i // 13 AS ky, i % 13 AS kx, sqrt(pow(i // 13 - 6, 2) + pow(i % 13 - 6, 2)) AS d FROM (SELECT unnest(range(169)) AS i))")
def kernel_normal(spark: SparkSession, d: str) -> DataFrame:
    return focal.normal_distribution_kernel(spark, 2.0, normalize=False).select("ky", "kx", F.round("w", 9).alias("w"))


@query("SELECT q.y, q.x, (SELECT round(sqrt(min(pow((q.x - r.x) * 2, 2) + pow(q.y - r.y, 2))), 6) FROM qty r WHERE r.v > 2200) AS v FROM qty q")
def edt_exact(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    region = q.with_px(q.px.select("y", "x", (F.col("v") > 2200).cast("int").alias("v")))
    return rounded(focal.distance_transform_edt(region, (2.0, 1.0)))


# ---------------------------------------------------------------- flow
#: Steepest descent on the qty grid in SQL: dd(y, x, d, ny, nx).
D8 = """, off AS (SELECT unnest(range(8)) AS k, unnest([0, -1, -1, -1, 0, 1, 1, 1]) AS dy, unnest([1, 1, 0, -1, -1, -1, 0, 1]) AS dx, unnest([1, 2, 1, 2, 1, 2, 1, 2]) AS s),
dd AS (SELECT y, x, d, y + dy AS ny, x + dx AS nx FROM (SELECT q.y, q.x, k AS d, dy, dx, row_number() OVER (PARTITION BY q.y, q.x ORDER BY CAST((q.v - n.v) * (q.v - n.v) AS DOUBLE) / s DESC, k) AS r FROM qty q JOIN off ON true JOIN qty n ON n.y = q.y + dy AND n.x = q.x + dx WHERE q.v > n.v) WHERE r = 1)"""


def _local(spark: SparkSession, d: str) -> Grid:
    q = views.qty(spark, d)
    return q.with_px(flow.d8_local(q).select("y", "x", F.col("d").alias("v")), dtype="uint8", nodata=128)


@query(f"{D8} SELECT q.y, q.x, d AS v FROM qty q LEFT JOIN dd USING (y, x)")
def d8_local(spark: SparkSession, d: str) -> DataFrame:
    return whole(_local(spark, d))


@query(f"{D8} SELECT row_number() OVER (ORDER BY d.y, d.x) - 1 AS id, d.y, d.x FROM dd d LEFT JOIN dd n ON n.y = d.ny AND n.x = d.nx WHERE n.d IS NULL")
def outlets_d8(spark: SparkSession, d: str) -> DataFrame:
    return flow.detect_outlets(_local(spark, d), "d8")


def _recursive(body: str) -> str:
    """A query with the downstream closure ``up(y, x, ty, tx, n)`` of the D8 graph of ``dd``."""
    return f"WITH RECURSIVE {views.SQL.strip()}{D8}, up(y, x, ty, tx, n) AS (SELECT y, x, y, x, 0 FROM dd UNION ALL SELECT up.y, up.x, dd.ny, dd.nx, n + 1 FROM up JOIN dd ON dd.y = up.ty AND dd.x = up.tx WHERE EXISTS (SELECT 1 FROM dd e WHERE e.y = dd.ny AND e.x = dd.nx)) {body}"


@query()
def accum_d8(spark: SparkSession, d: str) -> DataFrame:
    return whole(flow.flow_accumulation_d8(_local(spark, d))).filter("v is not null")


ORACLES["accum_d8"] = _recursive("SELECT ty AS y, tx AS x, count(*) AS v FROM up GROUP BY 1, 2")


@query()
def accum_d8_decay(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flow.flow_accumulation_d8(_local(spark, d), decay=0.5)).filter("v is not null")


ORACLES["accum_d8_decay"] = _recursive("SELECT ty AS y, tx AS x, round(sum(pow(0.5, n)), 6) AS v FROM up GROUP BY 1, 2")


@query()
def accum_d8_weighted(spark: SparkSession, d: str) -> DataFrame:
    return whole(flow.flow_accumulation_d8(_local(spark, d), weight=views.qty(spark, d))).filter("v is not null")


ORACLES["accum_d8_weighted"] = _recursive("SELECT ty AS y, tx AS x, CAST(sum(q.v) AS BIGINT) AS v FROM up JOIN qty q ON q.y = up.y AND q.x = up.x GROUP BY 1, 2")


@query()
def dist_channel_d8(spark: SparkSession, d: str) -> DataFrame:
    local, q = _local(spark, d), views.qty(spark, d)
    channel = q.with_px(q.px.select("y", "x", ((F.col("x") + F.col("y")) % 5 == 0).cast("int").alias("v")))
    return rounded(flow.distance_to_channel_d8(local, channel)).filter("v is not null")


ORACLES["dist_channel_d8"] = (
    f"WITH RECURSIVE {views.SQL.strip()}{D8}, up(y, x, ty, tx, l) AS (SELECT y, x, y, x, CAST(0 AS DOUBLE) FROM dd UNION ALL SELECT up.y, up.x, dd.ny, dd.nx, l + CASE WHEN d % 2 = 0 THEN 1 ELSE sqrt(2) END FROM up JOIN dd ON dd.y = up.ty AND dd.x = up.tx WHERE EXISTS (SELECT 1 FROM dd e WHERE e.y = dd.ny AND e.x = dd.nx))"
    " SELECT y, x, round(coalesce(min(CASE WHEN (tx + ty) % 5 = 0 THEN l END), -1), 6) AS v FROM up GROUP BY 1, 2"
)


@query()
def watershed_d8(spark: SparkSession, d: str) -> DataFrame:
    local = _local(spark, d)
    seeds = local.px.filter("v is not null and x % 16 = 5 and y % 10 = 3").select(flow.number(local).alias("i")).withColumn("ws_id", F.col("i"))
    found = flow.delineate_watersheds_d8(local, seeds)
    return found.select("ws_id", F.expr("i div 64").alias("y"), F.expr("i % 64").alias("x"))


ORACLES["watershed_d8"] = _recursive("SELECT ty * 64 + tx AS ws_id, y, x FROM up WHERE tx % 16 = 5 AND ty % 10 = 3")


@query()
def discovery_finish(spark: SparkSession, d: str) -> DataFrame:
    """Both preorder numbers of every cell: upstream cells of one cell by number, outlets by number."""
    local = _local(spark, d)
    return flow.discovery_finish(local).select(F.expr("i div 64").alias("y"), F.expr("i % 64").alias("x"), "disc", "fin")


ORACLES["discovery_finish"] = (
    _recursive("").rstrip()
    + """, size AS MATERIALIZED (SELECT ty * 64 + tx AS i, count(*) AS n FROM up GROUP BY 1), par AS MATERIALIZED (SELECT d.y * 64 + d.x AS i, CASE WHEN e.y IS NOT NULL THEN d.ny * 64 + d.nx END AS p FROM dd d LEFT JOIN dd e ON e.y = d.ny AND e.x = d.nx),
off AS MATERIALIZED (SELECT par.i, par.p, CASE WHEN par.p IS NULL THEN 0 ELSE 1 END + coalesce(sum(size.n) OVER (PARTITION BY par.p ORDER BY par.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM par JOIN size ON size.i = par.i),
num AS (SELECT u.y * 64 + u.x AS i, CAST(sum(off.o) AS BIGINT) AS disc FROM up u JOIN off ON off.i = u.ty * 64 + u.tx GROUP BY 1)
SELECT num.i // 64 AS y, num.i % 64 AS x, disc, disc + n - 1 AS fin FROM num JOIN size USING (i)"""
).replace("off AS (SELECT unnest(range(8)) AS k", "off8 AS (SELECT unnest(range(8)) AS k").replace("JOIN off ON true", "JOIN off8 ON true")


#: Cell numbers i, heights z and the eight neighbours' numbers of a grid g(y, x, v): one row per cell with data, n0..n7 NULL without data.
def _neighbours(grid: str) -> str:
    joins = " ".join(f"LEFT JOIN {grid} g{k} ON g{k}.y = g.y + {dy} AND g{k}.x = g.x + {dx} AND g{k}.v IS NOT NULL" for k, (dy, dx) in enumerate(flow.OFFSETS))
    return f"SELECT g.y * 64 + g.x AS i, CAST(g.v AS DOUBLE) AS z, {', '.join(f'CAST(g{k}.v AS DOUBLE) AS n{k}' for k in range(8))} FROM {grid} g {joins} WHERE g.v IS NOT NULL"


_DOWN = [f"coalesce(CASE WHEN z > n{k} THEN (z - n{k}) * (z - n{k}) / {1 if flow.STEP[k] == 1 else 2}.0::DOUBLE END, -1)" for k in range(8)]
_SLOPE = [f"coalesce(CASE WHEN z > n{k} THEN (z - n{k}) / {flow.STEP[k]!r}::DOUBLE END, 0)" for k in range(8)]
_GONE = [f"CASE WHEN n{k} IS NULL THEN 1 / {flow.STEP[k]!r}::DOUBLE ELSE 0 END" for k in range(8)]
_STEEPEST = "CASE " + " ".join(f"WHEN {_DOWN[k]} > 0 AND {_DOWN[k]} = greatest({', '.join(_DOWN)}) THEN {k}" for k in range(8)) + " END"
_OUTWARD = "CASE " + " ".join(f"WHEN n{k} IS NULL THEN {k}" for k in (0, 2, 4, 6, 7, 5, 3, 1)) + " END"


def _sum(parts: list[str]) -> str:
    """A sum in the order of directions, so that rounding is the same everywhere."""
    return f"({' + '.join(parts)})" if len(parts) < 3 else f"({_sum(parts[:-1])} + {parts[-1]})"


def _pack(parts: list[str]) -> str:
    """Eight parts as weights of four bits in one signed 32-bit number."""
    bits = " + ".join(f"CAST(floor(0.5 + {p} / {_sum(parts)} * 15) AS BIGINT) * {16**k}" for k, p in enumerate(parts))
    return f"(SELECT CASE WHEN b >= 2147483648 THEN b - 4294967296 ELSE b END FROM (SELECT {bits} AS b))"


_LINK = f"(SELECT unnest(range(8)) AS k, unnest({[float(x) for x in flow.STEP]}::DOUBLE[]) AS step, unnest({[dy * 64 + dx for dy, dx in flow.OFFSETS]}) AS o, unnest({[dx for _, dx in flow.OFFSETS]}) AS dx)"


def _filled(grid: str) -> str:
    """filled(i, w): levels at which cells drain to the edge of the data, from the grid's neighbours ``nb``."""
    return f"""nb AS MATERIALIZED ({_neighbours(grid)}),
ways AS MATERIALIZED (SELECT a.i, b.i AS j FROM nb a, {_LINK} l JOIN nb b ON b.i = a.i + l.o AND (a.i % 64) + l.dx BETWEEN 0 AND 63),
fl(n, i, z, w, moved) AS (SELECT 0, i, z, CASE WHEN {' OR '.join(f'n{k} IS NULL' for k in range(8))} THEN z ELSE 'inf'::DOUBLE END, true FROM nb
 UNION ALL SELECT n, i, z, w, w < old FROM (SELECT f.n + 1 AS n, f.i, f.z, f.w AS old, greatest(f.z, least(f.w, coalesce(m.w, 'inf'::DOUBLE))) AS w FROM fl f LEFT JOIN (SELECT ways.i, min(g.w) AS w FROM ways JOIN fl g ON g.i = ways.j GROUP BY ways.i) m ON m.i = f.i WHERE (SELECT bool_or(moved) FROM fl))),
filled AS MATERIALIZED (SELECT i, w FROM fl WHERE n = (SELECT max(n) FROM fl))"""


def _flats(name: str, cells: str, drains: str, flat: str) -> str:
    """``name``(i, s): for the flat cells (condition ``flat``) the best way to a drain (condition) as {{dist, origin, k, a, b}}."""
    best = "min({'dist': a + b * 1.4142135623730951::DOUBLE, 'origin': origin, 'k': k, 'a': a, 'b': b})"
    return f"""{name}_w AS MATERIALIZED (SELECT p.i, q.i AS j, l.k, l.step = 1 AS straight FROM {cells} p, {_LINK} l JOIN {cells} q ON q.i = p.i + l.o AND (p.i % 64) + l.dx BETWEEN 0 AND 63 AND q.z = p.z WHERE {flat.replace('@', 'p.')} AND ({flat.replace('@', 'q.')} OR {drains.replace('@', 'q.')})),
{name}_r(n, i, s, moved) AS (SELECT 0, i, CASE WHEN {drains.replace('@', '')} THEN {{'dist': 0::DOUBLE, 'origin': i, 'k': -1, 'a': 0, 'b': 0}} END, true FROM {cells} WHERE {flat.replace('@', '')} OR {drains.replace('@', '')}
 UNION ALL SELECT n, i, s, s IS DISTINCT FROM old FROM (SELECT r.n + 1 AS n, r.i, r.s AS old, CASE WHEN r.s IS NULL OR m.s < r.s THEN coalesce(m.s, r.s) ELSE r.s END AS s FROM {name}_r r LEFT JOIN
 (SELECT i, {best} AS s FROM (SELECT w.i, w.k, t.s.origin AS origin, t.s.a + CAST(straight AS INTEGER) AS a, t.s.b + CAST(NOT straight AS INTEGER) AS b FROM {name}_w w JOIN {name}_r t ON t.i = w.j WHERE t.s IS NOT NULL) GROUP BY i) m ON m.i = r.i AND (r.s IS NULL OR r.s.k >= 0) WHERE (SELECT bool_or(moved) FROM {name}_r))),
{name} AS MATERIALIZED (SELECT i, s FROM {name}_r WHERE n = (SELECT max(n) FROM {name}_r) AND s IS NOT NULL)"""


def _routed(grid: str) -> str:
    """lo(i, z, n0.., d, out), f1 and f2: flats drained to lower cells, then off the data."""
    return f"""lo AS MATERIALIZED (SELECT *, {_STEEPEST} AS d, {_OUTWARD} AS gone FROM ({_neighbours(grid)})),
{_flats('f1', 'lo', '(@d IS NOT NULL)', '(@d IS NULL)')},
left_ AS MATERIALIZED (SELECT * FROM lo WHERE d IS NULL AND i NOT IN (SELECT i FROM f1)),
{_flats('f2', 'left_', '(@gone IS NOT NULL)', '(@gone IS NULL)')}"""


def _d8(grid: str) -> str:
    return f"{_routed(grid)}, dirs AS MATERIALIZED (SELECT lo.i, lo.z, coalesce(lo.d, CASE WHEN f1.s.k >= 0 THEN f1.s.k END, CASE WHEN f2.s.k >= 0 THEN f2.s.k ELSE lo.gone END) AS d FROM lo LEFT JOIN f1 ON f1.i = lo.i LEFT JOIN f2 ON f2.i = lo.i)"


def _mfd(grid: str) -> str:
    """mfd(i, v): packed directions; shares(i, j, k, p)."""
    near = f"SELECT lo.i, l.k, 1 / l.step AS g FROM lo JOIN dist m ON m.i = lo.i, {_LINK} l JOIN lo q ON q.i = lo.i + l.o AND (lo.i % 64) + l.dx BETWEEN 0 AND 63 AND q.z = lo.z JOIN dist t ON t.i = q.i WHERE lo.d IS NULL AND t.dist < m.dist"
    return f"""{_routed(grid)},
dist AS MATERIALIZED (SELECT i, s.dist AS dist FROM f1 UNION ALL SELECT i, s.dist FROM f2),
near AS ({near}), wide AS (SELECT i, {', '.join(f'coalesce(max(CASE WHEN k = {k} THEN g END), 0) AS w{k}' for k in range(8))} FROM near GROUP BY i),
mfd AS MATERIALIZED (SELECT i, {_pack(_SLOPE)} AS v FROM lo WHERE d IS NOT NULL UNION ALL SELECT i, {_pack([f'w{k}' for k in range(8)])} FROM wide UNION ALL SELECT lo.i, {_pack(_GONE)} FROM lo JOIN f2 ON f2.i = lo.i AND f2.s.k < 0),
fours AS MATERIALIZED (SELECT m.i, l.k, l.step, CASE WHEN (m.i % 64) + l.dx BETWEEN 0 AND 63 THEN m.i + l.o END AS j, (m.v >> (4 * l.k)) & 15 AS w FROM mfd m, {_LINK} l),
shares AS MATERIALIZED (SELECT f.i, CASE WHEN t.i IS NOT NULL THEN f.j END AS j, f.k, f.step, f.w / CAST(sum(f.w) OVER (PARTITION BY f.i) AS DOUBLE) AS p, f.w FROM fours f LEFT JOIN mfd t ON t.i = f.j AND t.v <> 0 WHERE f.i IN (SELECT i FROM mfd WHERE v <> 0)),
parts AS MATERIALIZED (SELECT * FROM shares WHERE w > 0)"""


#: Flow through each cell, settled wave by wave from cells without inflow: acc(i, v).
_ACC = """av(n, i, w) AS (SELECT 0, i, CAST(1 AS DOUBLE) FROM mfd WHERE v <> 0 UNION ALL SELECT n + 1, j, sum(p * w) FROM (SELECT a.n, s.j, s.p, a.w FROM av a JOIN parts s ON s.i = a.i WHERE s.j IS NOT NULL) GROUP BY n, j),
acc AS MATERIALIZED (SELECT i, sum(w) AS v FROM av GROUP BY i)"""


ORACLES["slope_pct"] = f"WITH {views.SQL.strip()}, nb AS ({_neighbours('qty')}) SELECT q.y, q.x, CASE WHEN q.v IS NOT NULL THEN round(100 * sqrt(pow({_SLOPES[0]}, 2) + pow({_SLOPES[1]}, 2)), 6) + 0.0 END AS v FROM qty q LEFT JOIN nb ON nb.i = q.y * 64 + q.x"


def _with(*parts: str) -> str:
    return f"WITH RECURSIVE {views.SQL.strip()}, " + ", ".join(parts)


_ALL = "(SELECT y, x, y * 64 + x AS i FROM qty)"
_QTY_FILLED = "qf AS MATERIALIZED (SELECT g.y, g.x, f.w AS v FROM qty g LEFT JOIN filled f ON f.i = g.y * 64 + g.x)"


@query()
def mfd_pack(spark: SparkSession, d: str) -> DataFrame:
    """Packed directions of all cells, flats and edges included."""
    return whole(flow.flow_dir_mfd(views.qty(spark, d)))


ORACLES["mfd_pack"] = _with(_mfd("qty")) + f" SELECT y, x, CAST(v AS BIGINT) AS v FROM {_ALL} LEFT JOIN mfd USING (i)"


@query()
def accum_mfd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flow.flow_accumulation_mfd(flow.flow_dir_mfd(views.qty(spark, d))), off=1e-9)


ORACLES["accum_mfd"] = _with(_mfd("qty"), _ACC) + f" SELECT y, x, round(v + 1e-9, 6) AS v FROM {_ALL} LEFT JOIN acc USING (i)"


@query()
def dist_channel_mfd(spark: SparkSession, d: str) -> DataFrame:
    q = views.qty(spark, d)
    channel = q.with_px(q.px.select("y", "x", ((F.col("x") + F.col("y")) % 5 == 0).cast("int").alias("v")))
    return rounded(flow.distance_to_channel_mfd(flow.flow_dir_mfd(q), channel), off=1e-9)


#: Downstream cells first: a cell is settled in the round after the last of its ways that reach a channel.
ORACLES["dist_channel_mfd"] = (
    _with(
        _mfd("qty"),
        "chan AS MATERIALIZED (SELECT y * 64 + x AS i FROM qty WHERE (x + y) % 5 = 0)",
        "go AS MATERIALIZED (SELECT * FROM parts WHERE j IS NOT NULL AND i NOT IN (SELECT i FROM chan))",
        "rc(i) AS (SELECT i FROM chan UNION SELECT go.i FROM go JOIN rc ON rc.i = go.j)",
        "useful AS MATERIALIZED (SELECT go.*, count(*) OVER (PARTITION BY go.i) AS need FROM go WHERE j IN (SELECT i FROM rc))",
        "dn(n, i, v, moved) AS (SELECT 0, i, CASE WHEN i IN (SELECT i FROM chan) THEN CAST(0 AS DOUBLE) END, true FROM rc UNION ALL SELECT n, i, v, v IS DISTINCT FROM old FROM (SELECT d.n + 1 AS n, d.i, d.v AS old, CASE WHEN d.v IS NOT NULL THEN d.v WHEN m.have = m.need THEN m.v END AS v"
        " FROM dn d LEFT JOIN (SELECT u.i, sum(u.p * (u.step + t.v)) / sum(u.p) AS v, count(t.v) AS have, max(u.need) AS need FROM useful u JOIN dn t ON t.i = u.j GROUP BY u.i) m ON m.i = d.i WHERE (SELECT bool_or(moved) FROM dn)))",
        "dl AS (SELECT i, v FROM dn WHERE n = (SELECT max(n) FROM dn))",
    )
    + f" SELECT y, x, CASE WHEN i IN (SELECT i FROM chan) OR i IN (SELECT i FROM mfd WHERE v <> 0) THEN round(coalesce(dl.v, -1) + 1e-9, 6) END AS v FROM {_ALL} LEFT JOIN dl USING (i)"
)


@query()
def outlets_mfd(spark: SparkSession, d: str) -> DataFrame:
    return flow.detect_outlets(flow.flow_dir_mfd(views.qty(spark, d)), "mfd")


ORACLES["outlets_mfd"] = _with(_mfd("qty")) + " SELECT row_number() OVER (ORDER BY i) - 1 AS id, i // 64 AS y, i % 64 AS x FROM (SELECT i FROM parts GROUP BY i HAVING count(j) = 0)"


@query()
def streams_mfd(spark: SparkSession, d: str) -> DataFrame:
    mfd = flow.flow_dir_mfd(flow.fill_pits(views.qty(spark, d)))
    return whole(flow.extract_streams_mfd(flow.flow_accumulation_mfd(mfd), mfd, 8, 0.5))


ORACLES["streams_mfd"] = (
    _with(
        _filled("qty"),
        _QTY_FILLED,
        _mfd("qf"),
        _ACC,
        "su(i) AS (SELECT a.i FROM acc a JOIN parts s ON s.i = a.i WHERE a.v >= 8 AND s.j IS NULL UNION SELECT s.i FROM parts s JOIN su ON su.i = s.j JOIN acc a ON a.i = s.i WHERE a.v >= 4)",
        "sd(i) AS (SELECT su.i FROM su JOIN acc a ON a.i = su.i WHERE a.v >= 8 UNION SELECT s.j FROM sd JOIN parts s ON s.i = sd.i WHERE s.j IN (SELECT i FROM su))",
    )
    + f" SELECT y, x, CASE WHEN acc.v IS NOT NULL THEN CAST(i IN (SELECT i FROM sd) AS BIGINT) END AS v FROM {_ALL} LEFT JOIN acc USING (i)"
)


@query(
    """, e AS (SELECT q.y, q.x, q.v, count(n.v) AS k, min(n.v) AS lo FROM qty q LEFT JOIN qty n ON abs(n.y - q.y) <= 1 AND abs(n.x - q.x) <= 1 AND (n.y <> q.y OR n.x <> q.x) AND n.v IS NOT NULL WHERE q.v IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT x AS drain_x, y AS drain_y, v AS drain_v FROM e WHERE k < 8 ORDER BY v, y, x LIMIT 1), b AS (SELECT x AS sink_x, y AS sink_y, v AS sink_v FROM e WHERE k = 8 AND lo >= v ORDER BY v, y, x LIMIT 1)
SELECT * FROM a, b"""
)
def lowest_drain_sink(spark: SparkSession, d: str) -> DataFrame:
    return flow.detect_lowest_drain_and_sink(views.qty(spark, d))


@query()
def fill_pits(spark: SparkSession, d: str) -> DataFrame:
    return whole(flow.fill_pits(views.qty(spark, d)))


ORACLES["fill_pits"] = _with(_filled("qty")) + f" SELECT y, x, CAST(w AS BIGINT) AS v FROM {_ALL} LEFT JOIN filled USING (i)"


@query()
def flow_dir_d8(spark: SparkSession, d: str) -> DataFrame:
    return whole(flow.flow_dir_d8(flow.fill_pits(views.qty(spark, d))))


ORACLES["flow_dir_d8"] = _with(_filled("qty"), _QTY_FILLED, _d8("qf")) + f" SELECT y, x, CAST(d AS BIGINT) AS v FROM {_ALL} LEFT JOIN dirs USING (i)"

#: The D8 graph of the filled grid, its accumulation ac, stream cells st and segments sg(start, stop, ds) of them.
_STREAMS = (
    _with(
        _filled("qty"),
        _QTY_FILLED,
        _d8("qf"),
        f"nx AS MATERIALIZED (SELECT p.i, q.i AS j FROM dirs p JOIN {_LINK} l ON l.k = p.d LEFT JOIN dirs q ON q.i = p.i + l.o AND (p.i % 64) + l.dx BETWEEN 0 AND 63)",
        "dw(i, t) AS (SELECT i, i FROM nx UNION ALL SELECT dw.i, nx.j FROM dw JOIN nx ON nx.i = dw.t WHERE nx.j IS NOT NULL)",
        "ac AS MATERIALIZED (SELECT t AS i, count(*) AS v FROM dw GROUP BY t)",
        "st AS MATERIALIZED (SELECT nx.i, CASE WHEN b.i IS NOT NULL THEN nx.j END AS j FROM nx JOIN ac a ON a.i = nx.i AND a.v >= 20 LEFT JOIN ac b ON b.i = nx.j AND b.v >= 20)",
        "hd AS MATERIALIZED (SELECT st.i FROM st LEFT JOIN (SELECT j, count(*) AS n FROM st GROUP BY j) u ON u.j = st.i WHERE coalesce(u.n, 0) <> 1)",
        "fo(start, i) AS (SELECT i, i FROM hd UNION ALL SELECT fo.start, st.j FROM fo JOIN st ON st.i = fo.i WHERE st.j IS NOT NULL AND st.j NOT IN (SELECT i FROM hd))",
        "sg AS MATERIALIZED (SELECT fo.start, fo.i AS stop, st.j AS ds FROM fo JOIN st ON st.i = fo.i WHERE st.j IS NULL OR st.j IN (SELECT i FROM hd))",
    )
    + ", "
)


#: Strahler orders oz(s, o) of the segments, round by round.
_ORDERS = """od(n, s, o, moved) AS (SELECT 0, start, 1, true FROM sg UNION ALL SELECT n, s, o, o <> old FROM (SELECT t.n + 1 AS n, t.s, t.o AS old, coalesce(u.o, 1) AS o FROM od t LEFT JOIN
 (SELECT ds, m + CAST(len(list_filter(l, lambda x: x = m)) > 1 AS INTEGER) AS o FROM (SELECT ds, l, list_max(l) AS m FROM (SELECT g.ds, list(e.o) AS l FROM sg g JOIN od e ON e.s = g.start WHERE g.ds IS NOT NULL GROUP BY g.ds))) u ON u.ds = t.s WHERE (SELECT bool_or(moved) FROM od))),
oz AS (SELECT s, o FROM od WHERE n = (SELECT max(n) FROM od))"""


@query()
def strahler_order(spark: SparkSession, d: str) -> DataFrame:
    q = flow.fill_pits(views.qty(spark, d))
    d8 = flow.flow_dir_d8(q)
    return flow.extract_strahler_streams_d8(d8, flow.flow_accumulation_d8(d8), q, threshold=20).select("start", "ds", "order", "drop", "outlet")


ORACLES["strahler_order"] = (
    _STREAMS
    + _ORDERS
    + """,
ou(start, s) AS (SELECT start, start FROM sg UNION ALL SELECT ou.start, g.ds FROM ou JOIN sg g ON g.start = ou.s WHERE g.ds IS NOT NULL)
SELECT sg.start, sg.ds, oz.o AS "order", a.v - b.v AS drop, ou.s AS outlet FROM sg JOIN oz ON oz.s = sg.start JOIN ou ON ou.start = sg.start JOIN sg e ON e.start = ou.s AND e.ds IS NULL JOIN qf a ON a.y * 64 + a.x = sg.start JOIN qf b ON b.y * 64 + b.x = sg.stop"""
)


@query()
def subwatersheds(spark: SparkSession, d: str) -> DataFrame:
    q = flow.fill_pits(views.qty(spark, d))
    d8 = flow.flow_dir_d8(q)
    on = flow.flow_accumulation_d8(d8).px.filter("v >= 20").select(flow.number(d8).alias("i"))
    return flow.subwatersheds(d8, flow.stream_segments(d8, on))


ORACLES["subwatersheds"] = _STREAMS + "sw(i, t) AS (SELECT i, i FROM nx UNION ALL SELECT sw.i, nx.j FROM sw JOIN nx ON nx.i = sw.t WHERE nx.j IS NOT NULL AND sw.t NOT IN (SELECT stop FROM sg)) SELECT sg.start, sw.i FROM sw JOIN sg ON sg.stop = sw.t"


@query()
def stream_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines as the numbers of the cells that they run through."""
    d8 = flow.flow_dir_d8(flow.fill_pits(views.qty(spark, d)))
    on = flow.flow_accumulation_d8(d8).px.filter("v >= 20").select(flow.number(d8).alias("i"))
    lines = hydrography.stream_lines(d8, on, flow.stream_segments(d8, on))

    @F.pandas_udf("string")
    def path(geom):
        def cells(raw):
            points = wkb.read(raw)[1][0]
            return " ".join(str(int(np.floor(-y)) * 64 + int(np.floor(x))) for x, y in points)

        return geom.map(cells)

    return lines.select("start", "order", path("geom").alias("cells"))


ORACLES["stream_lines"] = (
    _STREAMS
    + _ORDERS
    + """, pt(start, n, i) AS (SELECT i, 0, i FROM hd UNION ALL SELECT pt.start, n + 1, st.j FROM pt JOIN st ON st.i = pt.i WHERE st.j IS NOT NULL AND (n = 0 OR pt.i NOT IN (SELECT i FROM hd)))
SELECT pt.start, oz.o AS "order", string_agg(pt.i, ' ' ORDER BY n) AS cells FROM pt JOIN oz ON oz.s = pt.start GROUP BY pt.start, oz.o"""
)


@query()
def watershed_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Areas and extents of the polygons, with the attribute that is copied to them."""
    local = _local(spark, d)
    seeds = local.px.filter("v is not null and x % 16 = 5 and y % 10 = 3").select(flow.number(local).alias("i")).withColumn("ws_id", F.col("i"))
    names = seeds.select("ws_id", F.concat(F.lit("basin "), F.col("ws_id").cast("string")).alias("name"))
    found = vector.with_bbox(hydrography.watershed_polygons(local, seeds, names))
    return found.select("ws_id", "name", "area", *(F.col(f"bbox.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")))


ORACLES["watershed_polygons"] = _recursive(
    "SELECT ty * 64 + tx AS ws_id, 'basin ' || (ty * 64 + tx) AS name, CAST(count(*) AS DOUBLE) AS area, CAST(min(x) AS DOUBLE) AS minx, CAST(-max(y) - 1 AS DOUBLE) AS miny, CAST(max(x) + 1 AS DOUBLE) AS maxx, CAST(-min(y) AS DOUBLE) AS maxy FROM up WHERE tx % 16 = 5 AND ty % 10 = 3 GROUP BY ty, tx"
)


@query()
def subwatershed_polygons(spark: SparkSession, d: str) -> DataFrame:
    d8 = flow.flow_dir_d8(flow.fill_pits(views.qty(spark, d)))
    on = flow.flow_accumulation_d8(d8).px.filter("v >= 20").select(flow.number(d8).alias("i"))
    return hydrography.subwatershed_polygons(d8, flow.stream_segments(d8, on)).select("start", "order", "area")


ORACLES["subwatershed_polygons"] = (
    _STREAMS + _ORDERS + ", sw(i, t) AS (SELECT i, i FROM nx UNION ALL SELECT sw.i, nx.j FROM sw JOIN nx ON nx.i = sw.t WHERE nx.j IS NOT NULL AND sw.t NOT IN (SELECT stop FROM sg)) SELECT sg.start, oz.o AS \"order\", CAST(count(*) AS DOUBLE) AS area FROM sw JOIN sg ON sg.stop = sw.t JOIN oz ON oz.s = sg.start GROUP BY ALL"
)


@query(f"SELECT fid, sum(v) AS v FROM (SELECT z.fid, (q.v % 10) % 5 AS v FROM zones z {IN_ZONE} WHERE q.v IS NOT NULL) GROUP BY fid")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Reclassify the quantity grid and sum the classes per zone."""
    q = views.qty(spark, d)
    digit = algebra.raster_map(lambda v: v % 10, q, nodata=-1, dtype="int64")
    classes = algebra.reclassify(digit, CLASSES, nodata=-1.0, required=False)
    return zonal.zonal_statistics(classes, views.zones(spark, d, q)).select("fid", F.col("v_sum").cast("long").alias("v"))
