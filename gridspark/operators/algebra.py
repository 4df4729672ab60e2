"""Pixel algebra: maps over aligned grids, reclassification, statistics, percentiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions.expressions import compile_expression, symbols
from gridspark.operators.model import Grid, check_nodata, choose_dtype, choose_nodata, same_size, spark_of
from gridspark.plans.iterate import cut

INF = float("inf")


class MissingValuesError(ValueError):
    """Values that a reclassification has no class for; ``missing`` lists them."""

    def __init__(self, missing: list[float]) -> None:
        super().__init__(f"no class for {missing}")
        self.missing = missing


def stack(grids: Sequence[Grid]) -> DataFrame:
    """(y, x, v0, v1, ...): grids joined cell by cell; all joins share one partitioning by (y, x)."""
    if not grids:
        raise ValueError("no grids given")
    same_size(*grids)
    tables = [g.px.select("y", "x", F.col("v").alias(f"v{i}")) for i, g in enumerate(grids)]
    return reduce(lambda a, b: a.join(b, ["y", "x"]), tables)


def raster_map(op: Callable[..., Column], *grids: Grid, nodata: float | None = None, dtype: str | None = None) -> Grid:
    """``op`` of the cells where every grid has data; NULL elsewhere."""
    dtype = dtype or choose_dtype(*(g.dtype for g in grids))
    if nodata is not None:
        check_nodata(nodata, dtype)
    vs = [F.col(f"v{i}") for i in range(len(grids))]
    valid = reduce(lambda a, b: a & b, (v.isNotNull() for v in vs))
    px = stack(grids).select("y", "x", F.when(valid, op(*vs)).alias("v"))
    return grids[0].with_px(px, dtype=dtype, nodata=choose_nodata(dtype) if nodata is None else nodata)


def raster_calculator(operands: Sequence[Grid | float | np.ndarray], op: Callable[..., Column], dtype: str, nodata: float | None) -> Grid:
    """``op`` over whole cells, sentinels included: a grid's nodata is seen as its value.

    Rows (1-d) and columns (n x 1) are broadcast along the other axis, numbers everywhere.
    """
    grids = [g for g in operands if isinstance(g, Grid)]
    if not operands or not (grids or any(isinstance(o, np.ndarray) for o in operands)):
        raise ValueError("at least one grid or array is needed")
    if not grids:
        raise ValueError("arrays need a grid that gives the size")
    same_size(*grids)
    base, df, cols, k = grids[0], stack(grids), [], 0
    spark = spark_of(base)
    for i, o in enumerate(operands):
        if isinstance(o, Grid):
            v = F.col(f"v{k}")
            cols.append(v if o.nodata is None else F.coalesce(v, F.lit(o.nodata)))
            k += 1
        elif isinstance(o, np.ndarray):
            a = o if o.ndim == 2 else o.reshape(1, -1)
            if a.ndim != 2 or a.shape[0] not in (1, base.n_rows) or a.shape[1] not in (1, base.n_cols):
                raise ValueError(f"an array of shape {o.shape} can't be broadcast to {(base.n_rows, base.n_cols)}")
            on = [name for name, n in (("y", a.shape[0]), ("x", a.shape[1])) if n > 1]
            if not on:
                cols.append(F.lit(float(a[0, 0])))
                continue
            rows = [(*(int(p) for p, n in zip((y, x), a.shape, strict=True) if n > 1), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
            # at most one number a row or column, or a local array of the grid's size
            df = df.join(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in on) + f", a{i} double"), on)
            cols.append(F.col(f"a{i}"))
        else:
            cols.append(F.lit(o))
    out = op(*cols)
    if nodata is not None:
        out = F.nullif(out.cast("double"), F.lit(float(nodata)))
    return base.with_px(df.select("y", "x", out.alias("v")), dtype=dtype, nodata=nodata)


def evaluate_expression(text: str, grids: Mapping[str, Grid], nodata: float | None = None, default_nan: float | None = None, default_inf: float | None = None) -> Grid:
    """A text expression over named grids; grids that it doesn't name are not read."""
    used = sorted(symbols(text) & set(grids))
    if missing := symbols(text) - set(grids) - {"pi", "e"}:
        raise ValueError(f"no grid for {sorted(missing)}")
    if not used:
        raise ValueError("the expression names no grid")
    stacked, names = [grids[k] for k in used], {k: F.col(f"v{i}") for i, k in enumerate(used)}
    valid = reduce(lambda a, b: a & b, (v.isNotNull() for v in names.values()))
    out = compile_expression(text, names)
    if default_nan is not None or default_inf is not None:
        number = out.cast("double")
        out = F.when(F.isnan(number), F.lit(default_nan) if default_nan is not None else F.raise_error(F.lit("the expression gives NaN and default_nan isn't set"))).when(F.abs(number) == INF, F.lit(default_inf) if default_inf is not None else F.raise_error(F.lit("the expression gives infinity and default_inf isn't set"))).otherwise(number)
    dtype = choose_dtype(*(g.dtype for g in stacked))
    return stacked[0].with_px(stack(stacked).select("y", "x", F.when(valid, out).alias("v")), dtype=dtype, nodata=nodata)


def reclassify(grid: Grid, classes: Mapping[float, float], nodata: float | None = None, dtype: str = "float64", required: bool = True) -> Grid:
    """Each value replaced by its class; a class for the grid's own nodata fills NULLs.

    ``required``: values without a class raise ``MissingValuesError``, else they become nodata
    (a named deviation: no neighbouring class is borrowed).
    """
    if not classes:
        raise ValueError("the value map is empty")
    if not all(isinstance(k, (int, float, np.number)) for k in classes):
        raise TypeError("keys of the value map must be numbers")
    own = [v for k, v in classes.items() if grid.nodata is not None and np.isclose(k, grid.nodata, equal_nan=True)]
    rest = {float(k): float(v) for k, v in classes.items() if grid.nodata is None or not np.isclose(k, grid.nodata, equal_nan=True)}
    if grid.nodata is not None and not own and nodata is None:
        raise ValueError("the grid has nodata; give a target nodata or a class for it")
    spark = spark_of(grid)
    table = spark.createDataFrame([(k, v) for k, v in rest.items()], "k double, c double")
    found = grid.px.join(table, F.col("v").cast("double") == F.col("k"), "left")
    if required:
        absent = found.filter("v is not null and k is null").select("v").distinct().limit(1000).collect()
        if absent:
            raise MissingValuesError(sorted(float(r.v) for r in absent))
    filled = F.when(F.col("v").isNull(), F.lit(own[0] if own else None).cast("double")).otherwise(F.col("c"))
    if nodata is not None:
        filled = F.nullif(filled, F.lit(float(nodata)))
    return grid.with_px(found.select("y", "x", filled.alias("v")), dtype=dtype, nodata=nodata)


def extract_streams_d8(accumulation: Grid, threshold: float) -> Grid:
    """1 where accumulation is above the threshold, 0 elsewhere."""
    v = F.when(F.col("v").isNull(), None).otherwise((F.col("v") > threshold).cast("int"))
    return accumulation.with_px(accumulation.px.select("y", "x", v.alias("v")), dtype="uint8", nodata=255)


def mask_by_grid(grid: Grid, mask: Grid) -> Grid:
    """Cells where the mask is 1; NULL elsewhere."""
    px = stack([grid, mask]).select("y", "x", F.when(F.col("v1") == 1, F.col("v0")).alias("v"))
    return grid.with_px(px)


# ---------------------------------------------------------------- aggregates
def statistics(grid: Grid) -> DataFrame:
    """One row: min, max, mean, population std of valid cells, and their share in percent."""
    v = F.col("v").cast("double")
    return grid.px.agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.stddev_pop(v).alias("v_std"), F.round(100.0 * F.count(v) / F.count(F.lit(1)), 2).alias("valid_percent"))


def value_counts(grid: Grid) -> DataFrame:
    return grid.px.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))


def raster_reduce(function: Callable[[float, float], float], grid: Grid, initial: float, mask_nodata: bool = True, merge: Callable[[float, float], float] | None = None) -> float:
    """Fold of the cells.

    With ``merge``, which joins two folds that began at ``initial``, partitions are folded where
    they are and one number each reaches the driver.  Without it the fold is sequential, in row
    order: blocks of rows are streamed to the driver, for functions whose order matters.
    """
    px = grid.px.filter("v is not null") if mask_nodata else grid.px.fillna({"v": float(grid.nodata or 0)})
    if merge is None:
        out = initial
        for row in px.orderBy("y", "x").select("v").toLocalIterator():
            out = function(out, row.v)
        return out

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = initial
        for batch in batches:
            for v in batch.column(0).to_pylist():
                own = function(own, v)
        yield pa.RecordBatch.from_arrays([pa.array([float(own)])], ["v"])

    parts = px.select("v").mapInArrow(fold, "v double").collect()  # a number a partition
    out = initial
    for r in parts:
        out = merge(out, r.v)
    return out


def percentiles(grid: Grid, cutoffs: Sequence[float]) -> DataFrame:
    """(k, v): for each cutoff in turn the first sorted value x_i with (100/n) i >= cutoff, one value per cutoff.

    Values are counted first and sorted by range, so no task sees them all; only the totals of
    the partitions reach the driver.
    """
    spark = spark_of(grid)
    v = F.col("v").cast("double")
    counts = grid.px.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INF)).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("p")))
    totals = {r.p: r.n for r in ranged.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    n = sum(totals.values())
    if not n:
        return spark.createDataFrame([(0, 0.0)], "k int, v double")
    wanted, last = [], -1
    for c in cutoffs:
        i = max(int(np.ceil(c * n / 100.0)) - 1, last + 1, 0)
        while i < n and (100.0 / n) * i < c:
            i += 1
        if i >= n:
            wanted.append(n - 1)
            break
        wanted.append(i)
        last = i
    offsets = np.concatenate(([0], np.cumsum([totals[p] for p in sorted(totals)])))
    table = spark.createDataFrame([(p, int(o)) for p, o in zip(sorted(totals), offsets[:-1], strict=True)], "p int, before long")
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v")) + F.col("before")
    placed = ranged.join(table, "p").select("v", "n", upto.alias("upto"))
    picks = spark.createDataFrame([(k, i) for k, i in enumerate(wanted)], "k int, i long")
    return picks.join(placed, (F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("n"))).select("k", "v")
