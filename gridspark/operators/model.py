"""Grids as DataFrames: pixels (y, x, v) with NULL for nodata, and the metadata beside them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixel types and the Spark types that hold them (Spark has no unsigned ones).
SPARK_TYPE = {"uint8": "smallint", "int8": "tinyint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}

GeoTransform = tuple[float, float, float, float, float, float]


@dataclass(frozen=True)
class Grid:
    """A band: every cell of ``n_rows`` x ``n_cols`` is a row of ``px``, NULL where it has no data.

    ``nodata`` is the sentinel that a sink writes for NULL; inside the engine there is none.
    """

    px: DataFrame
    n_rows: int
    n_cols: int
    gt: GeoTransform = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    crs: str | None = None
    dtype: str = "float64"
    nodata: float | None = None

    def with_px(self, px: DataFrame, **changes: object) -> Grid:
        return replace(self, px=px, **changes)

    @property
    def bounding_box(self) -> list[float]:
        """[minx, miny, maxx, maxy] over all four corners, so that rotated grids are covered too."""
        g = self.gt
        xs = [g[0] + c * g[1] + r * g[2] for c in (0, self.n_cols) for r in (0, self.n_rows)]
        ys = [g[3] + c * g[4] + r * g[5] for c in (0, self.n_cols) for r in (0, self.n_rows)]
        return [min(xs), min(ys), max(xs), max(ys)]

    def info(self) -> dict:
        return {"pixel_size": (self.gt[1], self.gt[5]), "raster_size": (self.n_cols, self.n_rows), "nodata": [self.nodata], "n_bands": 1, "geotransform": self.gt, "datatype": self.dtype, "projection_wkt": self.crs, "bounding_box": self.bounding_box, "numpy_type": np.dtype(self.dtype)}


def cells(spark: SparkSession, n_rows: int, n_cols: int) -> DataFrame:
    """(y, x) of every cell, by division of one distributed range."""
    i = F.col("id")
    return spark.range(n_rows * n_cols).select((i / n_cols).cast("long").alias("y") if n_cols == 1 else F.expr(f"id div {n_cols}").alias("y"), F.expr(f"id % {n_cols}").alias("x"))


def dense(px: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``px`` with a NULL row for each cell that it lacks."""
    return cells(px.sparkSession, n_rows, n_cols).join(px, ["y", "x"], "left")


def from_array(spark: SparkSession, array: np.ndarray, nodata: float | None = None, pixel_size: tuple[float, float] | None = None, origin: tuple[float, float] | None = None, crs: str | None = None) -> Grid:
    """A grid of a small local array; ``pixel_size`` and ``origin`` come together or not at all."""
    if (pixel_size is None) != (origin is None):
        raise ValueError("pixel_size and origin must both be given or both be left out")
    array = np.asarray(array)
    size, at = pixel_size or (1.0, -1.0), origin or (0.0, 0.0)
    none = matches(array, nodata)
    rows = [(int(y), int(x), None if none[y, x] else float(array[y, x])) for y in range(array.shape[0]) for x in range(array.shape[1])]
    px = spark.createDataFrame(rows, "y long, x long, v double")
    return Grid(px, *array.shape, (at[0], size[0], 0.0, at[1], 0.0, size[1]), crs, array.dtype.name, nodata)


def to_array(grid: Grid, fill: float | None = None) -> np.ndarray:
    """The whole band on the driver; for small grids."""
    fill = fill if fill is not None else grid.nodata if grid.nodata is not None else np.nan
    out = np.full((grid.n_rows, grid.n_cols), fill, np.float64)
    for y, x, v in grid.px.filter("v is not null").select("y", "x", F.col("v").cast("double")).toLocalIterator():
        out[y, x] = v
    return out


# ---------------------------------------------------------------- nodata and types
def matches(values: np.ndarray, nodata: float | None) -> np.ndarray:
    """Which values are nodata: equal for whole numbers, close for floats, NaN for NaN, none for None."""
    if nodata is None:
        return np.zeros(np.shape(values), bool)
    if np.issubdtype(np.asarray(values).dtype, np.integer):
        return np.asarray(values) == nodata
    return np.isclose(values, nodata, equal_nan=True)


def is_close(a: Column, b: Column) -> Column:
    """Within 1e-8 + 1e-5 |b|; NaN is close to NaN."""
    return (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b))


def is_nodata(v: Column, nodata: float | None, dtype: str) -> Column:
    """The same rule as ``matches`` as an expression, for scans that turn sentinels to NULL."""
    if nodata is None:
        return F.lit(False)
    return v == F.lit(nodata) if np.issubdtype(np.dtype(dtype), np.integer) else is_close(v.cast("double"), F.lit(float(nodata)))


def choose_dtype(*dtypes: str) -> str:
    """The smallest common type by numpy's promotion, which Spark's own coercion doesn't follow."""
    return np.result_type(*(np.dtype(d) for d in dtypes)).name


def choose_nodata(dtype: str) -> float:
    kind = np.dtype(dtype)
    return float(np.finfo(kind).max) if kind.kind == "f" else int(np.iinfo(kind).max)


def check_nodata(nodata: float, dtype: str) -> None:
    if not np.can_cast(np.min_scalar_type(nodata), np.dtype(dtype), "same_kind"):
        raise ValueError(f"nodata {nodata} doesn't fit {dtype}")


def check_pixel_size(size: object) -> None:
    if not (isinstance(size, (tuple, list)) and len(size) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in size)):
        raise ValueError(f"pixel size must be two numbers, not {size!r}")


def same_size(*grids: Grid) -> None:
    if len({(g.n_rows, g.n_cols) for g in grids}) > 1:
        raise ValueError(f"grids differ in size: {[(g.n_rows, g.n_cols) for g in grids]}")


def spark_of(grid: Grid) -> SparkSession:
    return grid.px.sparkSession
