"""Features on grids: rasterizing, masks, disjoint sets, polygons of equal cells, interpolation.

``features`` is a DataFrame with ``fid``, ``geom`` (WKB) and attributes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions import crs as projections
from gridspark.functions import wkb
from gridspark.operators.model import Grid
from gridspark.plans.iterate import circles, cut, jump

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy")])


@F.pandas_udf(BBOX)
def bbox_of(geoms: pd.Series) -> pd.DataFrame:
    found = [wkb.bounds(*wkb.read(g)) if g is not None else None for g in geoms]
    return pd.DataFrame([b or (None,) * 4 for b in found], columns=["minx", "miny", "maxx", "maxy"], dtype=float)


def with_bbox(features: DataFrame) -> DataFrame:
    """``features`` with a column ``bbox``, NULL without geometry."""
    box = bbox_of("geom")
    return features.withColumn("bbox", F.when(box["minx"].isNotNull() & ~F.isnan(box["minx"]), box))


def vector_info(features: DataFrame) -> DataFrame:
    from gridspark.operators.grids import boxes_of

    return boxes_of(with_bbox(features).filter("bbox is not null"))


def from_geometries(spark, geoms: Sequence[bytes], fields: dict[str, str], attributes: Sequence[dict]) -> DataFrame:
    """A layer of local geometries; every geometry needs exactly the attributes named by ``fields``."""
    if fields and len(attributes) != len(geoms):
        raise ValueError(f"{len(geoms)} geometries but {len(attributes)} sets of attributes")
    for a in attributes:
        if set(a) != set(fields):
            raise ValueError(f"attributes {sorted(a)} don't match the fields {sorted(fields)}")
    rows = [(i, bytearray(g) if g is not None else None, *(attributes[i][k] for k in fields)) for i, g in enumerate(geoms)]
    return spark.createDataFrame(rows, ", ".join(["fid long", "geom binary", *(f"`{k}` {t}" for k, t in fields.items())]))


def reproject(features: DataFrame, source: str, target: str, copy_fields: bool | Sequence[str] = True) -> DataFrame:
    """Geometries transformed; features whose geometry is NULL or has no image are dropped."""

    @F.pandas_udf("binary")
    def moved(geoms: pd.Series) -> pd.Series:
        out = []
        for g in geoms:
            kind, parts = wkb.read(g)
            change = lambda p: np.column_stack(projections.transform(p[:, 0], p[:, 1], source, target))
            new = [[change(r) for r in p] if isinstance(p, list) else change(p) for p in parts]
            flat = [r for p in new for r in (p if isinstance(p, list) else [p])]
            out.append(wkb.write(kind, new) if flat and all(np.isfinite(r).all() for r in flat) else None)
        return pd.Series(out)

    keep = [c for c in features.columns if c not in ("fid", "geom", "bbox") and (copy_fields is True or copy_fields is not False and c in copy_fields)]
    return features.filter("geom is not null").select("fid", moved("geom").alias("geom"), *keep).filter("geom is not null")


# ---------------------------------------------------------------- cells of features
def spans(features: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """(fid, y, x0, x1): runs of cells x0..x1 of each feature, one row per run.

    A cell belongs to a polygon if its centre does (even-odd, half-open), or with
    ``all_touched`` if its square meets the geometry.  A run is a row whatever its length, so
    large polygons stay small until their cells are needed.
    """
    g, n_rows, n_cols = grid.gt, grid.n_rows, grid.n_cols

    def centre_runs(seg: np.ndarray, y: int) -> Iterator[tuple[int, int]]:
        yc = y + 0.5
        s = seg[(seg[:, 1] <= yc) != (seg[:, 3] <= yc)]
        xs = np.sort(s[:, 0] + (yc - s[:, 1]) * (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1]))
        for a, b in zip(xs[0::2], xs[1::2], strict=False):
            lo, hi = max(0, math.ceil(a - 0.5)), min(n_cols - 1, math.ceil(b - 0.5) - 1)
            if lo <= hi:
                yield lo, hi

    def touched(kind: int, parts: list, seg: np.ndarray) -> set[tuple[int, int]]:
        out = {(int(math.floor(p[1])), int(math.floor(p[0]))) for part in parts if not isinstance(part, list) and len(part) == 1 for p in part}
        for x0, y0, x1, y1 in seg:
            # cut the segment at every line of the grid; each piece lies in one cell
            cuts = [0.0, 1.0]
            for a, b in ((x0, x1), (y0, y1)):
                if a != b:
                    lines = np.arange(math.ceil(min(a, b)), math.floor(max(a, b)) + 1)
                    cuts += ((lines - a) / (b - a)).tolist()
            cuts = sorted({min(1.0, max(0.0, c)) for c in cuts})
            for t in [(p + q) / 2 for p, q in zip(cuts[:-1], cuts[1:], strict=True)] or [0.0]:
                out.add((int(math.floor(y0 + t * (y1 - y0))), int(math.floor(x0 + t * (x1 - x0)))))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fid, geom in zip(batch["fid"], batch["geom"], strict=True):
                if geom is None:
                    continue
                kind, parts = wkb.read(geom)
                to_cells = lambda p: np.column_stack([(p[:, 0] - g[0]) / g[1], (p[:, 1] - g[3]) / g[5]])
                parts = [[to_cells(r) for r in p] if isinstance(p, list) else to_cells(p) for p in parts]
                box = wkb.bounds(kind, parts)
                if box is None:
                    continue
                seg = wkb.segments(kind, parts)
                found: dict[int, list] = {}
                if wkb.rings_of(kind, parts):
                    for y in range(max(0, math.floor(box[1] - 0.5)), min(n_rows - 1, math.ceil(box[3])) + 1):
                        found[y] = list(centre_runs(seg, y))
                if all_touched or not wkb.rings_of(kind, parts):
                    for y, x in touched(kind, parts, seg):
                        if 0 <= y < n_rows and 0 <= x < n_cols:
                            found.setdefault(y, []).append((x, x))
                for y, runs in found.items():
                    end = -1
                    for a, b in sorted(runs):
                        if b > end:
                            rows.append((fid, y, max(a, end + 1), b))
                            end = b
            yield pd.DataFrame(rows, columns=["fid", "y", "x0", "x1"])

    kind = features.schema["fid"].dataType.simpleString()
    return features.select("fid", "geom").mapInPandas(run, f"fid {kind}, y long, x0 long, x1 long")


def feature_cells(features: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """(fid, y, x): every cell of each feature."""
    return spans(features, grid, all_touched).select("fid", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def rasterize(features: DataFrame, grid: Grid, burn: float | str, all_touched: bool = False, merge: str = "replace", where: str | None = None) -> Grid:
    """Burn a number or an attribute into the grid: the last feature wins, or values add to the base."""
    chosen = features.filter(F.expr(where)) if where else features
    value = F.col(burn).cast("double") if isinstance(burn, str) else F.lit(float(burn))
    cells = feature_cells(chosen, grid, all_touched).join(chosen.select("fid", value.alias("b")), "fid")
    agg = F.max_by("b", "fid") if merge == "replace" else F.sum("b")
    burnt = cells.groupBy("y", "x").agg(agg.alias("b"))
    v = F.coalesce(F.col("b"), F.col("v")) if merge == "replace" else F.when(F.col("b").isNull(), F.col("v")).otherwise(F.coalesce(F.col("v"), F.lit(0.0)) + F.col("b"))
    return grid.with_px(grid.px.join(burnt, ["y", "x"], "left").select("y", "x", v.alias("v")))


def mask(grid: Grid, features: DataFrame, value: float | None = None, all_touched: bool = False, where: str | None = None) -> Grid:
    """Cells outside all features become ``value``: by default nodata, or 0 for a grid that has none."""
    chosen = features.filter(F.expr(where)) if where else features
    inside = feature_cells(chosen, grid, all_touched).select("y", "x").distinct().withColumn("inside", F.lit(True))
    outside = F.lit(value) if value is not None else F.lit(None) if grid.nodata is not None else F.lit(0.0)
    v = F.when(F.col("inside"), F.col("v")).otherwise(outside)
    return grid.with_px(grid.px.join(inside, ["y", "x"], "left").select("y", "x", v.alias("v")))


# ---------------------------------------------------------------- disjoint sets
def conflicts(features: DataFrame, bucket: float, may_touch: bool = False) -> DataFrame:
    """(a, b): pairs of features that meet, found by grid buckets of side ``bucket``, then exactly.

    Two boxes that overlap share the bucket of the larger of their lower corners; a pair is
    tested in that bucket alone.
    """
    boxed = with_bbox(features).filter("bbox is not null").select("fid", "geom", "bbox")

    def steps(lo: str, hi: str):
        return F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))

    placed = boxed.withColumn("bx", steps("bbox.minx", "bbox.maxx")).withColumn("by", steps("bbox.miny", "bbox.maxy"))
    a, b = placed.alias("a"), placed.alias("b")
    own = (F.floor(F.greatest("a.bbox.minx", "b.bbox.minx") / bucket) == F.col("a.bx")) & (F.floor(F.greatest("a.bbox.miny", "b.bbox.miny") / bucket) == F.col("a.by"))
    over = (F.col("a.bbox.minx") <= F.col("b.bbox.maxx")) & (F.col("b.bbox.minx") <= F.col("a.bbox.maxx")) & (F.col("a.bbox.miny") <= F.col("b.bbox.maxy")) & (F.col("b.bbox.miny") <= F.col("a.bbox.maxy"))
    on = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by")) & (F.col("a.fid") < F.col("b.fid"))

    @F.pandas_udf("boolean")
    def meet(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([wkb.intersect(wkb.read(p), wkb.read(q), not may_touch) for p, q in zip(x, y, strict=True)])

    pairs = a.join(b, on).filter(own & over)
    return pairs.filter(meet("a.geom", "b.geom")).select(F.col("a.fid").alias("a"), F.col("b.fid").alias("b"))


def disjoint_sets(features: DataFrame, box: Sequence[float] | None = None, may_touch: bool = False, bucket: float | None = None) -> list[set]:
    """Greedy sets of features that don't meet: fewest conflicts first.

    The conflict graph is found in Spark; the greedy colouring walks it on the driver, as its
    result is a driver-side list of sets by definition.
    """
    if features.limit(1).count() == 0:
        raise RuntimeError("the layer has no features")
    chosen = with_bbox(features).filter("bbox is not null")
    if box is not None:
        chosen = chosen.filter((F.col("bbox.minx") <= box[2]) & (F.col("bbox.maxx") >= box[0]) & (F.col("bbox.miny") <= box[3]) & (F.col("bbox.maxy") >= box[1]))
    sides = chosen.agg(F.avg(F.greatest(F.col("bbox.maxx") - F.col("bbox.minx"), F.col("bbox.maxy") - F.col("bbox.miny"))).alias("s")).first().s
    if sides is None:
        return []
    ids = [r.fid for r in chosen.select("fid").collect()]
    near: dict = {i: {i} for i in ids}
    for r in conflicts(chosen.select("fid", "geom"), bucket or max(sides, 1e-9), may_touch).collect():
        near[r.a].add(r.b)
        near[r.b].add(r.a)
    out = []
    while near:
        group: set = set()
        for i in sorted(near, key=lambda i: (len(near[i]), i)):
            if not near[i] & group:
                group.add(i)
        near = {i: c - group for i, c in near.items() if i not in group}
        out.append(group)
    return out


# ---------------------------------------------------------------- polygons of labels
#: Cells of a strip of whole rows whose outlines one task follows; a strip has 16 rows at least.
STRIP = 1 << 16
_NONE = np.iinfo(np.int64).max


def polygonize(px: DataFrame, label: str, grid: Grid) -> DataFrame:
    """(label, geom, area): a multipolygon of the cells of each label.

    Outlines are followed inside strips of whole rows, with their cells on the right; what crosses
    a border is a piece of a ring, and pieces are put together by their first and next edges.  At a
    crossing they turn right: cells joined by a corner stay apart.  A hole's row leads left over
    cells of the label to another ring of the same polygon, nearer to the outer one.  No step but
    the last, which writes a label's geometry, takes a label in one task.
    """
    rows = max(16, STRIP // grid.n_cols)
    last = (grid.n_rows - 1) // rows
    strips = F.explode(F.sequence(F.greatest(F.lit(0), F.expr(f"(y - 1) div {rows}")).cast("long"), F.least(F.lit(last), F.expr(f"(y + 1) div {rows}")).cast("long")))
    cells = px.select(F.col(label).alias("label"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), strips.alias("strip"))
    schema = f"label {px.schema[label].dataType.simpleString()}, first long, next long, area long, place long, beside long, points binary"
    bare = grid.with_px(None)  # a task gets the numbers only
    pieces = cut(cells.groupBy("strip").applyInArrow(lambda key, table: _outlines(key[0].as_py() * rows, rows, bare, table), schema).withColumn("id", F.monotonically_increasing_id()))
    loose = pieces.filter("next is not null")
    heads = loose.select(F.col("label").alias("l"), F.col("first").alias("f"), F.col("id").alias("j"))
    around = circles(loose.join(heads, (F.col("f") == F.col("next")) & F.col("l").eqNullSafe(F.col("label"))).select(F.col("id").alias("i"), F.col("j").alias("next")))
    whole = pieces.join(around.withColumnRenamed("i", "id"), "id", "left").withColumns({"ring": F.coalesce("ring", "id"), "steps": F.coalesce("steps", F.lit(0))})
    rings = cut(whole.groupBy("ring").agg(F.first("label").alias("label"), F.sum("area").alias("area"), F.min_by("beside", "place").alias("beside")))
    to = whole.select(F.col("label").alias("l"), F.col("first").alias("f"), F.col("ring").alias("j"))
    holes = rings.filter("area < 0").join(to, (F.col("f") == F.col("beside")) & F.col("l").eqNullSafe(F.col("label"))).select(F.col("ring").alias("i"), F.col("j").alias("next"))
    homes = jump(holes.unionByName(rings.filter("area > 0").select(F.col("ring").alias("i"), F.lit(None).cast("long").alias("next"))))
    # geometries are written from the inside out; a plan that doesn't ask for them leaves them out
    lines = whole.groupBy("ring").agg(F.expr("listagg(points) within group (order by steps desc)").alias("points"))
    ring = F.expr(f"concat({_le32('octet_length(points) div 16 + 1')}, points, substring(points, 1, 16))")
    own = rings.select("ring", "label", "area").join(homes.select(F.col("i").alias("ring"), F.col("end").alias("home")), "ring").join(lines, "ring").withColumn("geom", ring)
    polygons = own.groupBy("label", "home").agg(F.sum("area").alias("area"), F.count("*").alias("n"), F.expr("listagg(geom) within group (order by ring <> home, ring)").alias("geom"))
    polygons = polygons.withColumn("geom", F.expr(f"concat(unhex('0103000000'), {_le32('n')}, geom)"))
    out = polygons.groupBy("label").agg(F.sum("area").alias("area"), F.count("*").alias("n"), F.expr("listagg(geom) within group (order by home)").alias("geom"))
    return out.select("label", F.expr(f"concat(unhex('0106000000'), {_le32('n')}, geom)").alias("geom"), (F.col("area") * abs(grid.gt[1] * grid.gt[5])).alias("area"))


def _le32(n: str) -> str:
    """SQL for a count as four bytes, the lowest first."""
    digits = f"lpad(hex({n}), 8, '0')"
    return f"unhex(concat({', '.join(f'substring({digits}, {k}, 2)' for k in (7, 5, 3, 1))}))"


def _outlines(y0: int, rows: int, grid: Grid, table: pa.Table) -> pa.Table:
    """Pieces of outlines of a strip and their rows above and below: closed rings have no ``next``.

    An edge is numbered 4 * cell + side, sides N, E, S, W, with its cell on the right.  ``area``
    counts cells (in parts, for pieces), ``place`` orders a hole's pieces by their leftmost edge that has
    cells on its left, and ``beside`` is the first edge of the piece at the other end of those cells.
    """
    coded = table["label"].combine_chunks().dictionary_encode(null_encoding="encode")
    width, height = grid.n_cols + 2, rows + 2
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.unique((code * height + table["y"].to_numpy() - y0 + 1) * width + table["x"].to_numpy() + 1)

    def find(k: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, at, -1)

    line = keys // width % height
    inner = np.flatnonzero((line >= 1) & (line <= rows))
    number = np.full(len(keys) + 1, -1)  # of an inner cell; the last is for absent ones
    number[inner] = np.arange(len(inner))
    cell = (line + y0 - 1) * grid.n_cols + keys % width - 1
    steps = (-width, 1, width, -1)
    near = [find(keys[inner] + s) for s in steps]
    edge, after, follow = [], [], []
    for side in range(4):
        turn = (side + 1) % 4
        own = np.flatnonzero(near[side] < 0)
        right, left = near[turn][own], find(keys[inner[own]] + steps[turn] + steps[side])
        to = np.where(right < 0, inner[own], np.where(left < 0, right, left))
        side_to = np.where(right < 0, turn, np.where(left < 0, side, (side + 3) % 4))
        edge.append(own * 4 + side)
        follow.append(np.where(number[to] < 0, -1, number[to] * 4 + side_to))
        after.append(cell[to] * 4 + side_to)
    edge, follow, after = np.concatenate(edge), np.concatenate(follow), np.concatenate(after)
    order = np.argsort(edge)
    edge, follow, after = edge[order], follow[order], after[order]
    rank = np.full(4 * len(inner) + 1, -1)
    rank[edge] = np.arange(len(edge))
    follow = rank[follow]  # -1 takes the last, which is -1
    path, starts = _chains(follow)
    if not len(starts):
        names = ("first", "next", "area", "place", "beside")
        return pa.table([coded.dictionary.slice(0, 0), *(pa.array([], pa.int64()) for _ in names), pa.array([], pa.binary())], names=["label", *names, "points"])
    e = edge[path]
    side, where = e % 4, cell[inner[e // 4]]
    y, x = np.divmod(where, grid.n_cols)
    ends = np.append(starts[1:], len(path)) - 1
    out = follow[path[ends]] < 0
    area = np.add.reduceat(np.where(side == 1, x + 1, np.where(side == 3, -x, 0)), starts)
    place = np.where(side == 1, (x + 1) * (grid.n_rows + 1) + y, _NONE)
    lowest = np.minimum.reduceat(place, starts)
    piece = np.empty(len(edge), np.int64)
    piece[path] = np.repeat(np.arange(len(starts)), ends - starts + 1)
    # the cells left of that edge begin with an edge on their western side
    west = np.maximum.accumulate(np.where(np.diff(keys, prepend=keys[0] - 2) != 1, np.arange(len(keys)), 0))
    spot = np.flatnonzero(place == np.repeat(lowest, ends - starts + 1))
    spot = spot[side[spot] == 1]
    first = where[starts] * 4 + side[starts]
    beside = np.full(len(starts), -1)
    beside[piece[path[spot]]] = first[piece[rank[number[west[inner[e[spot] // 4]]] * 4 + 3]]]
    g = grid.gt
    points = np.column_stack((g[0] + (x + ((side == 1) | (side == 2))) * g[1], g[3] + (y + (side >= 2)) * g[5])).astype("<f8")
    blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(path)).astype(np.int32) * 16), pa.py_buffer(points.tobytes())])
    labels = coded.dictionary.take(pa.array(keys[inner[e[starts] // 4]] // (width * height)))
    return pa.table([labels, pa.array(first), pa.array(after[path[ends]], mask=~out), pa.array(area), pa.array(lowest, mask=lowest == _NONE), pa.array(beside, mask=beside < 0), blobs], names=["label", "first", "next", "area", "place", "beside", "points"])


def _chains(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node once, in the order of the chains and circles that ``follow`` (-1: none) makes of them, and where each begins."""
    later = np.zeros(len(follow), bool)
    later[follow[follow >= 0]] = True
    to, seen = follow.tolist(), bytearray(len(follow))
    path, starts = [], []
    for start in (*np.flatnonzero(~later).tolist(), *range(len(to))):
        if not seen[start]:
            starts.append(len(path))
            i = start
            while i >= 0 and not seen[i]:
                seen[i] = 1
                path.append(i)
                i = to[i]
    return np.array(path, np.int64), np.array(starts, np.int64)


# ---------------------------------------------------------------- interpolation
def interpolate_points(points: DataFrame, field: str, grid: Grid, mode: str = "near") -> Grid:
    """Values of points (x, y, field) at the corners of the grid's cells: nearest, or linear over a triangulation.

    The points are a control network and are broadcast (at most ``1 << 20`` of them); cells are
    interpolated in batches.  Outside the hull a linear grid is NULL.
    """
    rows = points.select(F.col("x").cast("double"), F.col("y").cast("double"), F.col(field).cast("double")).orderBy("x", "y").collect()
    if len(rows) > 1 << 20:
        raise ValueError("too many points to broadcast")
    data = np.array(rows, float).reshape(-1, 3)
    triangles = triangulate(data[:, :2]) if mode == "linear" else None
    if mode not in ("near", "nearest", "linear"):
        raise ValueError(f"unknown mode {mode!r}")
    g = grid.gt

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.column_stack([g[0] + batch["x"] * g[1], g[3] + batch["y"] * g[5]])
            v = np.full(len(at), np.nan)
            if triangles is None:
                for i in range(0, len(at), 4096):
                    d = ((at[i : i + 4096, None, :] - data[None, :, :2]) ** 2).sum(axis=2)
                    v[i : i + 4096] = data[d.argmin(axis=1), 2]
            else:
                for t in triangles:
                    p, q, r = data[t, :2]
                    den = (q[1] - r[1]) * (p[0] - r[0]) + (r[0] - q[0]) * (p[1] - r[1])
                    a = ((q[1] - r[1]) * (at[:, 0] - r[0]) + (r[0] - q[0]) * (at[:, 1] - r[1])) / den
                    b = ((r[1] - p[1]) * (at[:, 0] - r[0]) + (p[0] - r[0]) * (at[:, 1] - r[1])) / den
                    within = (a >= -1e-12) & (b >= -1e-12) & (a + b <= 1 + 1e-12)
                    v[within] = (a * data[t[0], 2] + b * data[t[1], 2] + (1 - a - b) * data[t[2], 2])[within]
            yield pd.DataFrame({"y": batch["y"], "x": batch["x"], "v": v})

    found = grid.px.select("y", "x").mapInPandas(run, "y long, x long, v double")
    return grid.with_px(found.withColumn("v", F.when(~F.isnan("v"), F.col("v"))))


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles of local points by insertion (Bowyer-Watson)."""
    n, (lo, hi) = len(points), (points.min(axis=0), points.max(axis=0))
    span = float((hi - lo).max()) or 1.0
    mid = (lo + hi) / 2
    all_points = np.vstack([points, mid + span * np.array([[-30, -10], [30, -10], [0, 30]])])
    tri = [(n, n + 1, n + 2)]

    def circle(t: tuple) -> tuple[np.ndarray, float]:
        a, b, c = all_points[list(t)]
        d = 2 * np.linalg.det(np.array([b - a, c - a]))
        if d == 0:
            return a, np.inf
        u = np.array([(c - a)[1] * ((b - a) @ (b - a)) - (b - a)[1] * ((c - a) @ (c - a)), (b - a)[0] * ((c - a) @ (c - a)) - (c - a)[0] * ((b - a) @ (b - a))]) / d
        return a + u, float(u @ u)

    circles = {tri[0]: circle(tri[0])}
    for i in range(n):
        bad = [t for t, (c, r) in circles.items() if ((all_points[i] - c) ** 2).sum() < r * (1 - 1e-12)]
        count: dict[tuple, int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                key = (min(e), max(e))
                count[key] = count.get(key, 0) + 1
            del circles[t]
        for e in (k for k, c in count.items() if c == 1):
            t = (*e, i)
            circles[t] = circle(t)
    return np.array([t for t, (_, r) in circles.items() if max(t) < n and np.isfinite(r)], int).reshape(-1, 3)
