"""Flow over terrain: directions, accumulation, distances, pits, streams, watersheds.

Directions are numbered E, NE, N, NW, W, SW, S, SE = 0..7.  A cell's number is
``i = y * n_cols + x``.  Paths are followed by pointer doubling (``plans.iterate``), so that
loops run for the logarithm of the longest path and not for its length.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.operators import spread
from gridspark.operators.focal import OFFSETS, SQRT2, stencil
from gridspark.operators.model import Grid, dense
from gridspark.plans.iterate import cut, gather, jump
from gridspark.plans.tiles import Tile, settle

STEP = tuple(1.0 if dy == 0 or dx == 0 else SQRT2 for dy, dx in OFFSETS)


def number(grid: Grid, y: Column | None = None, x: Column | None = None) -> Column:
    return (F.col("y") if y is None else y) * grid.n_cols + (F.col("x") if x is None else x)


def moved(grid: Grid, direction: Column) -> Column:
    """Number of the neighbour in a direction, NULL off the grid."""
    table = lambda k: F.element_at(F.array(*(F.lit(o[k]) for o in OFFSETS)), direction.cast("int") + 1)
    y, x = F.col("y") + table(0), F.col("x") + table(1)
    return F.when(y.between(0, grid.n_rows - 1) & x.between(0, grid.n_cols - 1), y * grid.n_cols + x)


def pixels(grid: Grid, numbered: DataFrame, v: str) -> DataFrame:
    return numbered.select(F.expr(f"i div {grid.n_cols}").alias("y"), F.expr(f"i % {grid.n_cols}").alias("x"), F.col(v).alias("v"))


# ---------------------------------------------------------------- D8 directions
def _steepest() -> Column:
    """First direction of the steepest descent; squared drops keep the comparison exact."""
    drops = [F.when(F.col("v") > F.col(f"n{k}"), (F.col("v") - F.col(f"n{k}")) * (F.col("v") - F.col(f"n{k}")) / (1.0 if STEP[k] == 1 else 2.0)) for k in range(8)]
    best = F.greatest(*drops)
    return reduce(lambda out, k: out.when(drops[k] == best, k), range(1, 8), F.when(drops[0] == best, 0))


def d8_local(dem: Grid) -> DataFrame:
    """(y, x, v, n0..n7, d): steepest descent, NULL on flats, in pits and without data."""
    return stencil(dem.px.select("y", "x", F.col("v").cast("double").alias("v"))).withColumn("d", _steepest())


def flow_dir_d8(dem: Grid) -> Grid:
    """D8 directions; flats drain along shortest ways to a lower neighbour, or else off the data.

    Ties of distance go to the drain that comes first in row order, then to the lowest direction.
    Pits that are not filled have no direction.
    """
    shape = (dem.n_rows, dem.n_cols)

    def inner(tile: Tile) -> dict[str, np.ndarray]:
        z, d = tile.layers[0], spread.steepest(tile.layers[0])
        return {"v": z, "d": np.where(np.isnan(d), tile.state[3], d)}

    def outer(tile: Tile) -> dict[str, np.ndarray]:
        z, d = tile.layers
        own = np.where(spread.outer_drains(tile)[0], spread.outward(z), tile.state[3])
        return {"v": z, "d": np.where(np.isnan(d), own, d)}

    first = cut(settle(dem.px, ["v"], *shape, spread.drain_flats(dem.n_cols, spread.inner_drains), inner, "v double, d double", states=4))
    if first.filter("v is not null and d is null").limit(1).count():
        first = settle(first, ["v", "d"], *shape, spread.drain_flats(dem.n_cols, spread.outer_drains), outer, "v double, d double", states=4)
    return dem.with_px(first.select("y", "x", F.col("d").cast("int").alias("v")), dtype="uint8", nodata=128)


def edges_d8(flow: Grid) -> DataFrame:
    """(i, next) of every cell with a direction; ``next`` is NULL where flow leaves the data."""
    own = flow.px.filter("v is not null").select(number(flow).alias("i"), moved(flow, F.col("v")).alias("next"))
    there = flow.px.filter("v is not null").select(number(flow).alias("next"), F.lit(True).alias("there"))
    return own.join(there, "next", "left").select("i", F.when(F.col("there"), F.col("next")).alias("next"))


def flow_accumulation_d8(flow: Grid, weight: Grid | None = None, decay: Grid | float | None = None) -> Grid:
    """Cells (or weights) upstream of each cell, itself included; a decay multiplies every step down.

    Nodata weights and decays count as 0.
    """
    nodes = edges_d8(flow).withColumns({"w": F.lit(1.0), "f": F.lit(1.0)})
    if weight is not None:
        w = weight.px.select(number(flow).alias("i"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("w"))
        nodes = nodes.drop("w").join(w, "i")
    if isinstance(decay, Grid):
        d = decay.px.select(number(flow).alias("next"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("f"))
        nodes = nodes.drop("f").join(d, "next", "left")
    elif decay is not None:
        nodes = nodes.withColumn("f", F.lit(float(decay)))
    total = gather(nodes.select("i", "next", "w", F.coalesce("f", F.lit(1.0)).alias("f")))
    px = flow.px.select("y", "x", number(flow).alias("i")).join(total, "i", "left").select("y", "x", F.col("total").alias("v"))
    return flow.with_px(px, dtype="float64", nodata=-1.23789789e29)


def distance_to_channel_d8(flow: Grid, channel: Grid, weight: Grid | None = None) -> Grid:
    """Length of the way down to the first channel cell (1 or sqrt 2 a step, or the weight of the
    cell that is left); -1 where none is reached."""
    nodes = edges_d8(flow).join(channel.px.select(number(flow).alias("i"), (F.coalesce(F.col("v"), F.lit(0)) == 1).alias("on")), "i")
    step = flow.px.filter("v is not null").select(number(flow).alias("i"), F.element_at(F.array(*map(F.lit, STEP)), F.col("v").cast("int") + 1).alias("step"))
    if weight is not None:
        step = weight.px.select(number(flow).alias("i"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("step"))
    nodes = nodes.join(step, "i").select("i", F.when(~F.col("on"), F.col("next")).alias("next"), F.when(F.col("on"), 0.0).otherwise(F.col("step")).alias("dist"), "on")
    ends = jump(nodes, {"dist": lambda a, b: a + b, "on": lambda a, b: b})
    v = F.when(F.col("on"), F.col("dist")).otherwise(-1.0)
    px = flow.px.select("y", "x", number(flow).alias("i")).join(ends.select("i", v.alias("v")), "i", "left").select("y", "x", "v")
    return flow.with_px(px, dtype="float64", nodata=-1.0)


# ---------------------------------------------------------------- pits
def fill_pits(dem: Grid, outlet: tuple[int, int] | None = None, most_cells: int | None = None) -> Grid:
    """Every cell raised to the lowest height over which it drains to the edge, nodata or the outlet.

    A tile floods from what its borders say in order of height; only border cells whose level
    fell are sent on.  With ``most_cells`` a pit of more cells is left as it is: connected raised
    cells are one pit.
    """
    cells = dem.px if outlet is None else dem.px.withColumn("end", ((F.col("x") == outlet[0]) & (F.col("y") == outlet[1])).cast("int"))
    layers = ["v"] if outlet is None else ["v", "end"]

    def level(tile: Tile) -> dict[str, np.ndarray]:
        z = tile.layers[0]
        return {"v": z, "w": np.where(np.isfinite(tile.state[0]), np.maximum(z, tile.state[0]), z)}

    px = settle(cells, layers, dem.n_rows, dem.n_cols, spread.fill, level, "v double, w double", start=np.inf)
    if most_cells is None:
        return dem.with_px(px.select("y", "x", F.col("w").alias("v")))
    px = cut(px)
    raised = px.filter("w > v").select("y", "x", F.lit(1).alias("v"))
    pit = regions(dem.with_px(dense(raised, dem.n_rows, dem.n_cols)))
    large = pit.groupBy("region").agg(F.count("*").alias("m")).filter(F.col("m") > most_cells)
    left = pit.join(large, "region").select("y", "x", F.lit(True).alias("left"))
    return dem.with_px(px.join(left, ["y", "x"], "left").select("y", "x", F.when(F.col("left"), F.col("v")).otherwise(F.col("w")).alias("v")))


def regions(mask: Grid) -> DataFrame:
    """(y, x, region): connected cells (eight neighbours) that are not NULL; a region is named by its least cell number."""

    n_cols = mask.n_cols

    def solve(tile: Tile) -> None:
        own = np.where(np.isnan(tile.layers[0]), np.inf, np.minimum(tile.state[0], tile.number(n_cols)))
        inner = spread.within(tile)
        own = np.where(inner, own, tile.state[0])
        while True:
            best = np.minimum(own, spread.around(own, np.inf).min(axis=0))
            best = np.where(inner & ~np.isnan(tile.layers[0]), best, own)
            if np.array_equal(best, own):
                break
            own = best
        tile.state[0] = own

    found = settle(mask.px, ["v"], mask.n_rows, n_cols, solve, lambda t: {"region": np.where(np.isfinite(t.state[0]), t.state[0], np.nan)}, "region double", start=np.inf)
    return found.filter("region is not null").select("y", "x", F.col("region").cast("long").alias("region"))


# ---------------------------------------------------------------- multiple flow directions
def pack(weights: list[Column]) -> Column:
    """Eight weights of four bits as one number, direction k at bit 4k."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(w.cast("int"), 4 * k) for k, w in enumerate(weights)))


def unpack(v: Column, k: int) -> Column:
    return F.shiftright(v.cast("int"), 4 * k).bitwiseAND(F.lit(15))


def flow_dir_mfd(dem: Grid) -> Grid:
    """Packed weights in proportion to slopes; flats send flow to all nearer neighbours of their height.

    Distances over a flat are to lower neighbours, or to the edge of the data where there are none.
    """
    shape = (dem.n_rows, dem.n_cols)
    inner, outer = (spread.drain_flats(dem.n_cols, f) for f in (spread.inner_drains, spread.outer_drains))
    first = settle(dem.px, ["v"], *shape, inner, lambda t: {"v": t.layers[0], "dist": spread.distance(t)}, "v double, dist double", states=4)
    px = settle(cut(first), ["v", "dist"], *shape, outer, lambda t: {"v": spread.many_ways(t)}, "v double", states=4)
    return dem.with_px(px.select("y", "x", F.col("v").cast("int").alias("v")), dtype="int32", nodata=0)


def edges_mfd(flow: Grid) -> DataFrame:
    """(i, j, k, p): where a cell's flow goes and the share that takes each way; j is NULL off the data."""
    total = F.nullif(reduce(lambda a, b: a + b, (unpack(F.col("v"), k) for k in range(8))), F.lit(0))
    ways = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), unpack(F.col("v"), k).alias("w")) for k in range(8))))
    own = flow.px.filter("v is not null and v <> 0").select("y", "x", total.alias("t"), ways.alias("s")).filter("s.w > 0")
    out = own.select(number(flow).alias("i"), moved(flow, F.col("s.k")).alias("j"), F.col("s.k").alias("k"), (F.col("s.w") / F.col("t")).alias("p"))
    there = flow.px.filter("v is not null and v <> 0").select(number(flow).alias("j"), F.lit(True).alias("there"))
    return out.join(there, "j", "left").select("i", F.when(F.col("there"), F.col("j")).alias("j"), "k", "p")


def flow_accumulation_mfd(flow: Grid, weight: Grid | None = None) -> Grid:
    """Share-weighted cells upstream; nodata weights count as 0."""
    cells = flow.px.withColumn("own", F.lit(1.0))
    if weight is not None:
        cells = flow.px.join(weight.px.select("y", "x", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("own")), ["y", "x"])
    px = settle(cells, ["v", "own"], flow.n_rows, flow.n_cols, spread.accumulate, lambda t: {"v": t.state[0]}, "v double")
    return flow.with_px(px, dtype="float64", nodata=-1.23789789e29)


def distance_to_channel_mfd(flow: Grid, channel: Grid, weight: Grid | None = None) -> Grid:
    """Mean length to channels over the ways that reach one, weighted by flow; -1 where none does."""
    cells = flow.px.join(channel.px.select("y", "x", (F.coalesce(F.col("v"), F.lit(0)) == 1).cast("int").alias("on")), ["y", "x"])
    if weight is not None:
        cells = cells.join(weight.px.select("y", "x", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("step")), ["y", "x"])
    else:
        cells = cells.withColumn("step", F.lit(None).cast("double"))

    def length(tile: Tile) -> dict[str, np.ndarray]:
        there = ~np.isnan(tile.layers[0]) & (tile.layers[0] != 0) | (tile.layers[1] == 1)
        return {"v": np.where(there, np.where(np.isnan(tile.state[0]), -1.0, tile.state[0]), np.nan)}

    px = settle(cells, ["v", "on", "step"], flow.n_rows, flow.n_cols, spread.to_channel, length, "v double")
    return flow.with_px(px, dtype="float64", nodata=-1.0)


# ---------------------------------------------------------------- streams
def extract_streams_mfd(accumulation: Grid, flow: Grid, threshold: float, trace_proportion: float = 1.0) -> Grid:
    """Streams above a threshold that drain off the data, with weaker stretches kept where a strong one lies upstream."""
    if not 0 <= trace_proportion <= 1:
        raise ValueError("the trace proportion must be between 0 and 1")
    shape = (flow.n_rows, flow.n_cols)
    cells = flow.px.select("y", "x", "v").join(accumulation.px.select("y", "x", F.col("v").alias("a")), ["y", "x"])

    def strong(tile: Tile, least: float = threshold) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return tile.layers[1] >= least

    # upstream from strong cells that drain off the data, then downstream from the strong ones among those
    up = spread.reach(-1, lambda t: strong(t) & spread.leaves(t.layers[0]), lambda t: strong(t, threshold * trace_proportion))
    down = spread.reach(1, lambda t: strong(t) & (t.layers[2] == 1), lambda t: t.layers[2] == 1)
    found = settle(cells, ["v", "a"], *shape, up, lambda t: {"v": t.layers[0], "a": t.layers[1], "on": t.state[0]}, "v double, a double, on double")
    px = settle(found, ["v", "a", "on"], *shape, down, lambda t: {"v": np.where(np.isnan(t.layers[1]), np.nan, t.state[0])}, "v double")
    return accumulation.with_px(px.select("y", "x", F.col("v").cast("int").alias("v")), dtype="uint8", nodata=255)


def detect_lowest_drain_and_sink(dem: Grid) -> DataFrame:
    """One row: the lowest cell on the edge of the data and the lowest pit, first in row order."""
    local = stencil(dem.px.select("y", "x", "v")).filter("v is not null")
    edge = reduce(lambda a, b: a | b, (F.col(f"n{k}").isNull() for k in range(8)))
    pit = reduce(lambda a, b: a & b, (F.col(f"n{k}") >= F.col("v") for k in range(8)))
    key = F.struct("v", "y", "x")
    drain, sink = F.min(F.when(edge, key)), F.min(F.when(~edge & pit, key))
    row = local.agg(drain.alias("d"), sink.alias("s"))
    return row.select(F.col("d.x").alias("drain_x"), F.col("d.y").alias("drain_y"), F.col("d.v").alias("drain_v"), F.col("s.x").alias("sink_x"), F.col("s.y").alias("sink_y"), F.col("s.v").alias("sink_v"))


def detect_outlets(flow: Grid, kind: str = "d8") -> DataFrame:
    """(id, y, x) of the cells whose flow leaves the data (all of it, for multiple directions)."""
    if kind == "d8":
        out = edges_d8(flow).filter("next is null").select("i")
    elif kind == "mfd":
        out = edges_mfd(flow).groupBy("i").agg(F.count("j").alias("inside")).filter("inside = 0").select("i")
    else:
        raise ValueError(f"flow directions are d8 or mfd, not {kind!r}")
    ranged = out.repartitionByRange("i").select("i", F.spark_partition_id().alias("p"))
    ranged = cut(ranged.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("i"))))
    before, table = 0, []
    for r in ranged.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect():  # a row a partition
        table.append((r.p, before))
        before += r.n
    offsets = flow.px.sparkSession.createDataFrame(table, "p int, before long")
    return ranged.join(offsets, "p").select((F.col("r") - 1 + F.col("before")).alias("id"), F.expr(f"i div {flow.n_cols}").alias("y"), F.expr(f"i % {flow.n_cols}").alias("x"))


def stream_segments(flow: Grid, streams: DataFrame) -> DataFrame:
    """(start, ds, order): segments between junctions of stream cells ``i``, with Strahler orders.

    ``start`` is a source or junction, ``ds`` the next junction below (NULL at an outlet).  Orders
    are 1 at sources, else the largest above, one more where two or more above have it.  They
    take a round per order (and pointer doubling in it), not per segment of the longest way.
    """
    on = cut(streams.select("i").distinct())
    links = edges_d8(flow).join(on, "i", "left_semi").join(on.select(F.col("i").alias("next"), F.lit(True).alias("t")), "next", "left").select("i", F.when(F.col("t"), F.col("next")).alias("next"))
    links = cut(links)
    ups = links.groupBy(F.col("next").alias("i")).agg(F.count("*").alias("ups")).filter("i is not null")
    starts = cut(links.join(ups, "i", "left").filter("ups is null or ups > 1").select("i"))
    # the cell before a start ends its segment: follow to the last cell, then one step
    stop = links.join(starts.select(F.col("i").alias("next"), F.lit(True).alias("s")), "next", "left")
    ends = jump(stop.select("i", F.when(F.col("s").isNull(), F.col("next")).alias("next")))
    below = links.select(F.col("i").alias("end"), F.col("next").alias("ds"))
    seg = cut(ends.join(starts, "i", "left_semi").join(below, "end").select(F.col("i").alias("start"), "end", "ds"))
    links = cut(seg.select(F.col("start").alias("i"), F.col("ds").alias("next")))
    orders, order = cut(links.select("i", F.lit(1).alias("order"))), 1
    while True:
        # where two of this order or more meet the next one begins, and it holds from there on down
        high = links.join(orders.filter(F.col("order") == order), "i").filter("next is not null")
        meet = cut(high.groupBy(F.col("next").alias("i")).agg(F.count("*").alias("n")).filter("n > 1").select("i", F.lit(1.0).alias("w")))
        if meet.limit(1).count() == 0:
            break
        marked = links.join(meet, "i", "left").select("i", "next", F.coalesce("w", F.lit(0.0)).alias("w"), F.lit(1.0).alias("f"))
        order += 1
        higher = gather(marked).filter("total > 0").select("i", F.lit(order).alias("new"))
        orders = cut(orders.join(higher, "i", "left").select("i", F.coalesce("new", "order").alias("order")))
    return seg.join(orders.withColumnRenamed("i", "start"), "start").select("start", "end", "ds", "order")


def extract_strahler_streams_d8(flow: Grid, accumulation: Grid, dem: Grid, threshold: float = 100, min_p: float = 0.05, autotune: bool = False) -> DataFrame:
    """Stream segments above an accumulation threshold with order, drop and outlet cell.

    With ``autotune`` the threshold grows by a quarter until first-order drops don't differ from
    higher-order ones (two-sample t-test).
    """
    while True:
        on = accumulation.px.filter(F.col("v") >= threshold).select(number(flow).alias("i"))
        seg = cut(stream_segments(flow, on))
        z = dem.px.select(number(flow).alias("i"), F.col("v").cast("double").alias("z"))
        drops = seg.join(z.select(F.col("i").alias("start"), F.col("z").alias("z0")), "start").join(z.select(F.col("i").alias("end"), F.col("z").alias("z1")), "end").withColumn("drop", F.col("z0") - F.col("z1"))
        drops = cut(drops)
        if not autotune:
            break
        s = {r.first: r for r in drops.groupBy((F.col("order") == 1).alias("first")).agg(F.count("*").alias("n"), F.avg("drop").alias("m"), F.var_samp("drop").alias("s")).collect()}
        if len(s) < 2 or min(s[True].n, s[False].n) < 2 or t_test(s[True], s[False]) > min_p:
            break
        threshold *= 1.25
    outlet = jump(seg.select(F.col("start").alias("i"), F.col("ds").alias("next"))).select(F.col("i").alias("start"), F.col("end").alias("outlet"))
    return drops.join(outlet, "start").select("start", "end", "ds", "order", "drop", "outlet", F.lit(float(threshold)).alias("threshold"))


def t_test(a, b) -> float:
    """Two-sided p of equal means under equal variances, from counts, means and variances."""
    df = a.n + b.n - 2
    pooled = ((a.n - 1) * a.s + (b.n - 1) * b.s) / df
    if pooled == 0:
        return 1.0 if a.m == b.m else 0.0
    t = (a.m - b.m) / math.sqrt(pooled * (1 / a.n + 1 / b.n))
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for coefficient in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + coefficient * d
            c = 1 + coefficient / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


# ---------------------------------------------------------------- watersheds
def _first_seed(links: DataFrame, is_seed: DataFrame) -> DataFrame:
    """(i, end): the first seed on each cell's way down, itself included; cells that meet none are left out."""
    stopped = links.join(is_seed, "i", "left").select("i", F.when(F.col("s").isNull(), F.col("next")).alias("next"))
    return jump(stopped).join(is_seed.select(F.col("i").alias("end"), "s"), "end").select("i", "end")


def delineate_watersheds_d8(flow: Grid, seeds: DataFrame) -> DataFrame:
    """(ws_id, i): all cells upstream of each watershed's seed cells (ws_id, i), seeds included.

    Every cell is led to the first seed on its way down; what lies below a seed is settled on
    the small graph of seeds.  Nested watersheds overlap.
    """
    links = cut(edges_d8(flow))
    marks = cut(seeds.select("ws_id", "i").distinct().join(links.select("i"), "i", "left_semi"))
    is_seed = marks.select("i").distinct().withColumn("s", F.lit(True))
    first = cut(_first_seed(links, is_seed))
    below = links.join(is_seed, "i").filter("next is not null").select(F.col("i").alias("seed"), F.col("next").alias("i")).join(first, "i").select("seed", F.col("end").alias("to"))
    member = front = cut(marks.select(F.col("i").alias("seed"), "ws_id"))
    while True:
        front = cut(below.join(front.withColumnRenamed("seed", "to"), "to").select("seed", "ws_id").distinct().join(member, ["seed", "ws_id"], "left_anti"))
        if front.limit(1).count() == 0:
            break
        member = cut(member.unionByName(front))
    return first.join(member.withColumnRenamed("seed", "end"), "end").select("ws_id", "i")


def subwatersheds(flow: Grid, segments: DataFrame, at_confluence: bool = False) -> DataFrame:
    """(start, i): cells labelled by the stream segment that they first drain into."""
    heads = cut(segments.select("start", F.col("end" if not at_confluence else "start").alias("end")))
    seeds = heads.select(F.col("end").alias("i"), F.lit(True).alias("s")).distinct()
    return _first_seed(cut(edges_d8(flow)), seeds).join(heads, "end").select("start", "i")


def discovery_finish(flow: Grid) -> DataFrame:
    """(i, disc, fin): preorder numbers, so that p is upstream of q iff disc(q) <= disc(p) <= fin(q)."""
    links = cut(edges_d8(flow))
    size = cut(gather(links.withColumns({"w": F.lit(1.0), "f": F.lit(1.0)})).select("i", F.col("total").cast("long").alias("n")))
    before = Window.partitionBy("next").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    sized = links.join(size, "i")
    inner = sized.filter("next is not null").withColumn("off", 1 + F.coalesce(F.sum("n").over(before), F.lit(0)))
    # outlets: offsets by sums of earlier trees, partition by partition
    roots = cut(sized.filter("next is null").repartitionByRange("i").withColumn("p", F.spark_partition_id()))
    within = Window.partitionBy("p").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    total, table = 0, []
    for r in roots.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():  # a row a partition
        table.append((r.p, total))
        total += r.n
    offsets = flow.px.sparkSession.createDataFrame(table, "p int, before long")
    outer = roots.join(offsets, "p").withColumn("off", F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("before"))
    nodes = inner.select("i", "next", "off").unionByName(outer.select("i", "next", "off"))
    disc = jump(nodes, {"off": lambda a, b: a + b})
    return disc.join(size, "i").select("i", F.col("off").alias("disc"), (F.col("off") + F.col("n") - 1).alias("fin"))
