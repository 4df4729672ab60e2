"""Operators against hand-checked grids and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import crs, wkb
from gridspark.functions.expressions import compile_expression
from gridspark.operators import algebra, flow, focal, grids, vector, zonal
from gridspark.operators.model import choose_dtype, choose_nodata, from_array, matches, to_array

D8 = np.array([[2] * 10 + [0], [4] + [2] * 9 + [0], [4, 4] + [2] * 7 + [0, 0], [4] * 3 + [2] * 5 + [0] * 3, [4] * 4 + [2] * 3 + [0] * 4, [4] * 5 + [2] + [0] * 5, [4] * 5 + [6] + [0] * 5, [4] * 4 + [6] * 3 + [0] * 4, [4] * 3 + [6] * 5 + [0] * 3, [4, 4] + [6] * 7 + [0, 0], [4] + [6] * 9 + [0]])


def grid(spark, a, **kw):
    return from_array(spark, np.asarray(a), **kw)


def features(spark, *geoms):
    return spark.createDataFrame([(i, bytearray(g) if g else None) for i, g in enumerate(geoms)], "fid long, geom binary")


def test_nodata_rules():
    assert matches(np.array([9, 1], np.int16), 9).tolist() == [True, False]
    assert matches(np.array([np.nan, 1.0]), np.nan).tolist() == [True, False]
    assert not matches(np.array([1.0]), None).any()
    assert choose_dtype("int32", "float32") == "float64" and choose_dtype("uint8", "float32", "int16") == "float32"
    assert choose_nodata("uint8") == 255


def test_raster_map_propagates_nodata(spark):
    a = grid(spark, np.array([[1, 1, 255], [1, 255, 1], [1, 1, 1]], np.uint8), nodata=255)
    b = grid(spark, np.array([[10.0, 10, 10], [10, -1, -1], [10, 10, 10]], np.float32), nodata=-1)
    out = algebra.raster_map(lambda x, y: x + y, a, b, nodata=-1)
    assert to_array(out).tolist() == [[11, 11, -1], [11, -1, -1], [11, 11, 11]]
    with pytest.raises(ValueError):
        algebra.raster_map(lambda x: x, a, nodata=-5, dtype="uint8")


def test_calculator_broadcasts(spark):
    z = grid(spark, np.ones((3, 2)))
    out = algebra.raster_calculator([3, np.array([0.0, 1]), np.array([[0.0], [1], [2]]), z], lambda a, x, y, z: a * x * y * z, "float64", None)
    assert to_array(out).tolist() == [[0, 0], [0, 3], [0, 6]]
    with pytest.raises(ValueError):
        algebra.raster_calculator([], lambda: 1, "float64", None)


def test_expressions(spark):
    a = grid(spark, np.arange(4.0).reshape(2, 2))
    zeros = grid(spark, np.zeros((2, 2)))
    assert to_array(algebra.evaluate_expression("a / b", {"a": a, "b": zeros}, -1, default_nan=-7, default_inf=-9)).tolist() == [[-7, -9], [-9, -9]]
    with pytest.raises(ValueError):
        algebra.evaluate_expression("a + c", {"a": a})
    with pytest.raises(ValueError):
        compile_expression("__import__('os')", {})


def test_reclassify(spark):
    g = grid(spark, np.array([[0, 1, -1]], np.int16), nodata=0)
    assert to_array(algebra.reclassify(g, {1: 5, -1: 6}, nodata=10)).tolist() == [[10, 5, 6]]
    with pytest.raises(algebra.MissingValuesError) as e:
        algebra.reclassify(g, {1: 5}, nodata=10)
    assert e.value.missing == [-1]
    with pytest.raises(ValueError):
        algebra.reclassify(g, {})


@pytest.mark.parametrize(("nodata", "expected"), [(None, [0, 23, 73, 99, 99]), (0, [1, 24, 73, 99])])
def test_percentiles(spark, nodata, expected):
    g = grid(spark, np.arange(100, dtype=np.uint32).reshape(10, 10), nodata=nodata)
    assert [r.v for r in algebra.percentiles(g, [0, 22.5, 72.1, 99, 100]).orderBy("k").collect()] == expected


def test_reduce_and_statistics(spark):
    a = np.ones((10, 10), np.int16)
    a[0] = -1
    g = grid(spark, a, nodata=-1)
    assert algebra.raster_reduce(lambda x, y: x + y, g, 0) == 90
    assert algebra.raster_reduce(lambda x, y: x + y, g, 0, mask_nodata=False) == 80
    s = algebra.statistics(g).first()
    assert (s.v_min, s.v_max, s.v_mean, s.v_std, s.valid_percent) == (1, 1, 1, 0, 90.0)


def test_slope(spark):
    a = np.tile(np.arange(9.0), (9, 1))
    a[4, 4] = -1
    out = to_array(focal.slope(grid(spark, a, nodata=-1, pixel_size=(1.0, -1.0), origin=(0.0, 0.0))), fill=-5)
    assert out[4, 4] == -5 and np.allclose(np.delete(out.ravel(), 40), 100)


def test_convolution(spark):
    a = grid(spark, np.full((3, 3), 0.5))
    k = focal.kernel_from_array(spark, np.ones((3, 3)))
    total = lambda **kw: to_array(focal.convolve_2d(a, k, **kw)).sum()
    assert total(ignore_nodata_and_edges=True) == pytest.approx(40.5)
    assert total(normalize_kernel=True) == pytest.approx(0.5 + 4 * 5 / 9)
    wide = focal.kernel_from_array(spark, np.random.default_rng(0).random((13, 13)))
    b = grid(spark, np.random.default_rng(1).random((20, 30)))
    w = np.array([r.w for r in wide.orderBy("ky", "kx").collect()]).reshape(13, 13)
    padded = np.pad(to_array(b), 6)
    want = [[(padded[y : y + 13, x : x + 13] * w[::-1, ::-1]).sum() for x in range(30)] for y in range(20)]
    assert np.allclose(to_array(focal.convolve_2d(b, wide, tile=16)), want)


def test_kernels(spark):
    n = lambda k: k.filter("w <> 0").count()
    s = lambda k: k.agg(F.sum("w")).first()[0]
    flat = focal.dichotomous_kernel(spark, 30, normalize=False)
    assert n(flat) == 2821 and s(flat) == 2821
    assert s(focal.linear_decay_kernel(spark, 30, normalize=False)) == pytest.approx(942.44055, abs=1e-3)
    assert s(focal.normal_distribution_kernel(spark, 10, 3)) == pytest.approx(1)
    assert [focal.next_regular(x) for x in (1, 7, 11, 13, 17)] == [1, 8, 12, 15, 18]


def test_distance_transform(spark):
    a = np.zeros((12, 15))
    for y, x in ((0, 3), (7, 7), (11, 14)):
        a[y, x] = 1
    out = to_array(focal.distance_transform_edt(grid(spark, a), (2.0, 1.5)))
    yy, xx = np.mgrid[:12, :15]
    want = np.min([np.hypot((xx - x) * 2.0, (yy - y) * 1.5) for y, x in ((0, 3), (7, 7), (11, 14))], axis=0)
    assert np.allclose(out, want)


def test_distance_transform_over_strips(spark, monkeypatch):
    monkeypatch.setattr(focal, "STRIP", 30)  # strips of two rows
    a = np.zeros((41, 15))
    for y, x in ((6, 3), (7, 7), (31, 14)):
        a[y, x] = 1
    out = focal.distance_transform_edt(grid(spark, a), (2.0, 1.5))
    yy, xx = np.mgrid[:41, :15]
    want = np.min([np.hypot((xx - x) * 2.0, (yy - y) * 1.5) for y, x in ((6, 3), (7, 7), (31, 14))], axis=0)
    assert np.allclose(to_array(out), want)
    plan = out.px._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()  # a window to the end of a column takes the square of its rows
    assert np.isnan(to_array(focal.distance_transform_edt(grid(spark, np.zeros((5, 15)))), np.nan)).all()


def test_boxes(spark):
    assert grids.align_bbox((0, 1, 0, 0, 0, 1), [0.5, 1.7, 2.1, 3.4]) == [0, 1, 3, 4]
    g = grids.grid_from_box(spark, [0, 0, 100, 145], (10, -10))
    assert (g.n_cols, g.n_rows) == (10, 15)
    with pytest.raises(ValueError):
        grids.merge_bounding_boxes([[0, 0, 1, 1], [2, 2, 3, 3]], "intersection")
    out = grids.transform_bounding_box([-123.587984, 44.415778, -123.397976, 44.725814], "EPSG:4326", "EPSG:26910")
    assert np.allclose(out, [453188.671769, 4918131.799327, 468483.727558, 4952661.553935], atol=0.01)
    assert np.allclose(crs.transform(*crs.transform(np.array([-120.0]), np.array([45.0]), "EPSG:4326", "EPSG:32610"), "EPSG:32610", "EPSG:4326"), [[-120], [45]])


def test_warp_and_overview(spark):
    g = grid(spark, np.tile([1.0, 2, 3, 4], (4, 1)), pixel_size=(1.0, -1.0), origin=(0.0, 0.0))
    assert to_array(grids.warp(g, (1.0, -1.0))).tolist() == to_array(g).tolist()
    assert to_array(focal.overview(g, 4, "average")).tolist() == [[2.5]]
    assert focal.overview_levels(2000, 1000) == [2, 4]


def test_zonal(spark):
    g = grid(spark, np.ones((9, 9), np.float32), pixel_size=(1.0, -1.0), origin=(0.0, 0.0))
    z = features(spark, wkb.box(0, -9, 9, 0), wkb.box(0, -1, 1, 0), wkb.box(100, 100, 101, 101), wkb.box(3.1, -3.3, 3.2, -3.1))
    rows = {r.fid: r for r in zonal.zonal_statistics(g, z, include_value_counts=True).collect()}
    assert (rows[0].v_count, rows[0].v_sum, rows[0].value_counts) == (81, 81, {1.0: 81})
    assert rows[1].v_count == 1 and rows[3].v_count == 1
    assert (rows[2].v_min, rows[2].v_count, rows[2].v_sum, rows[2].nodata_count) == (None, 0, 0, 0)


def test_disjoint_sets_and_touching(spark):
    square = lambda x, y: wkb.box(x - 1.5, y - 1.5, x + 1.5, y + 1.5)
    z = features(spark, square(16, -8), square(8, -10), square(2, -8), square(2, -7), square(14, -12))
    assert sorted(map(sorted, vector.disjoint_sets(z))) == [[0, 1, 2, 4], [3]]
    t = features(spark, wkb.box(0, 0, 1, 1), wkb.box(1, 0, 2, 1))
    assert len(vector.disjoint_sets(t)) == 2 and len(vector.disjoint_sets(t, may_touch=True)) == 1


def test_polygonize_holes(spark):
    a = np.ones((5, 5))
    a[2, 2] = 0
    g = grid(spark, a, pixel_size=(2.0, -2.0), origin=(0.0, 0.0))
    rows = {r.label: r for r in vector.polygonize(g.px.select("y", "x", F.col("v").cast("int").alias("c")), "c", g).collect()}
    assert rows[1].area == 96 and rows[0].area == 4
    assert wkb.area(*wkb.read(rows[1].geom)) == 96


@pytest.mark.parametrize("one_task", [True, False])
def test_polygonize_over_strips(spark, monkeypatch, one_task):
    from gridspark.plans import iterate

    monkeypatch.setattr(vector, "STRIP", 1)  # strips of 16 rows
    if not one_task:
        monkeypatch.setattr(iterate, "ONE_TASK", 0)
    a = np.zeros((50, 9))  # an island with a hole in a lake on land, across the strips
    a[1:49, 1:8], a[3:47, 2:7], a[5:45, 3:6], a[20, 4], a[30:33, 4] = 1, 0, 1, 0, 2
    a[0, 0] = 1  # touches the land by a corner
    g = grid(spark, a, pixel_size=(2.0, -2.0), origin=(0.0, 0.0))
    cells = g.px.select("y", "x", F.col("v").cast("int").cast("string").alias("c")).withColumn("c", F.when(F.col("c") != "2", F.col("c")))
    rows = {r.label: r for r in vector.polygonize(cells, "c", g).collect()}
    assert {k: r.area for k, r in rows.items()} == {"1": 4.0 * (a == 1).sum(), "0": 4.0 * (a == 0).sum(), None: 12.0}
    for label, r in rows.items():
        _, parts = wkb.read(r.geom)
        mine = a == (2 if label is None else int(label))
        seg = wkb.segments(wkb.MULTI_POLYGON, parts)
        assert all(wkb.inside(seg, 2 * x + 1, -2 * y - 1) == mine[y, x] for y in range(50) for x in range(9))
        assert wkb.area(wkb.MULTI_POLYGON, parts) == r.area
        assert all((ring[0] == ring[-1]).all() for part in parts for ring in part)
        for part in parts:  # a hole lies in its polygon's outer ring, and in no smaller one
            for hole in part[1:]:
                y, x = hole[:, 1].max() - 0.1, hole[hole[:, 1].argmax(), 0] + 0.1
                around = [p[0] for p in parts if wkb.inside(wkb.segments(wkb.POLYGON, [p[:1]]), x, y)]
                assert min(around, key=lambda o: np.ptp(o[:, 0])) is part[0]
    assert sorted(len(p) for p in wkb.read(rows["1"].geom)[1]) == [1, 2, 3]


def test_watersheds_that_overlap_have_whole_polygons(spark):
    g = grid(spark, np.zeros((3, 4)))
    cells = spark.createDataFrame([(w, y, x) for w in (1, 2) for y in range(3) for x in range(w + 1)], "w long, y long, x long")
    assert {r.label: r.area for r in vector.polygonize(cells, "w", g).collect()} == {1: 6.0, 2: 9.0}


def test_polygonize_takes_no_label_in_one_task(spark):
    g = grid(spark, np.ones((4, 4)))
    plan = vector.polygonize(g.px.select("y", "x", F.col("v").alias("c")), "c", g).select("label", "area")._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "listagg" not in plan


def test_streams_ask_for_no_edges(spark, monkeypatch):
    monkeypatch.setattr(flow, "edges_mfd", None)  # a row per cell and direction
    dem = grid(spark, np.add.outer(np.arange(6.0), np.arange(5.0) % 2))
    mfd = flow.flow_dir_mfd(dem)
    out = to_array(flow.extract_streams_mfd(flow.flow_accumulation_mfd(mfd), mfd, 3, 0.5))
    assert out.max() == 1 and out[5].max() == 0


def test_the_driver_collects_its_garbage(spark, monkeypatch):
    from gridspark.plans import iterate

    monkeypatch.setattr(iterate, "GARBAGE_MB", 0)
    run = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(b.getCollectionCount() for b in run if "Old" in b.getName())
    iterate.cut(spark.range(3))
    assert sum(b.getCollectionCount() for b in run if "Old" in b.getName()) > before


def test_d8_on_a_flat(spark):
    assert to_array(flow.flow_dir_d8(grid(spark, np.zeros((11, 11))))).astype(int).tolist() == D8.tolist()


def test_accumulation(spark):
    d8 = grid(spark, D8.astype(np.uint8), nodata=128)
    out = to_array(flow.flow_accumulation_d8(d8))
    assert out[0].tolist() == [1, 2, 3, 4, 5, 6, 5, 4, 3, 2, 1]
    assert np.allclose(to_array(flow.flow_accumulation_d8(d8, decay=0.5))[1:10, 0], 2 - 0.5 ** (out[1:10, 0] - 1))
    merge = grid(spark, np.array([[255, 0, 0, 0, 0], [255, 0, 0, 0, 2]], np.uint8), nodata=255)
    got = to_array(flow.flow_accumulation_d8(merge, decay=0.5), fill=-1)
    assert got.tolist() == [[-1, 1, 1.5, 1.75, 2.8125], [-1, 1, 1.5, 1.75, 1.875]]


def test_fill_pits(spark):
    a = np.zeros((11, 11))
    a[3:8, 3:8] = -1
    a[0, 0] = -1
    want = np.zeros((11, 11))
    want[0, 0] = -1
    assert to_array(flow.fill_pits(grid(spark, a))).tolist() == want.tolist()


def test_mfd_accumulation_conserves_flow(spark):
    a = np.zeros((11, 11))
    a[5] = -1
    mfd = flow.flow_dir_mfd(grid(spark, a))
    out = to_array(flow.flow_accumulation_mfd(mfd))
    assert out[5, 0] == pytest.approx(60.5) and out[5, 10] == pytest.approx(60.5)


def test_watershed_and_outlets(spark):
    d8 = grid(spark, D8.astype(np.uint8), nodata=128)
    seeds = spark.createDataFrame([(1, 5), (2, 5 * 11)], "ws_id int, i long")
    n = {r.ws_id: r["count"] for r in flow.delineate_watersheds_d8(d8, seeds).groupBy("ws_id").count().collect()}
    assert n == {1: 6, 2: 5}
    assert flow.detect_outlets(d8).count() == 40


def test_t_test():
    class S:
        def __init__(self, n, m, s):
            self.n, self.m, self.s = n, m, s

    assert flow.t_test(S(10, 0.0, 1.0), S(10, 0.0, 1.0)) == pytest.approx(1)
    assert flow.t_test(S(10, 0.0, 1.0), S(10, 1.0, 1.0)) == pytest.approx(0.0382, abs=1e-3)


def test_pits_and_flats_across_tiles(spark, monkeypatch):
    """Tiles of six cells a side give what one tile gives; a pit with too many cells stays as it is."""
    from gridspark.operators import spread
    from gridspark.plans import tiles

    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, (13, 11)).astype(float)
    a[4:10, 2:9] = 3
    a[5:9, 3:8] = 0
    a[2, 2] = -1  # no data
    dem = from_array(spark, a, nodata=-1)

    def chain():
        filled = flow.fill_pits(dem)
        many = flow.flow_dir_mfd(filled)
        return [to_array(g) for g in (filled, flow.flow_dir_d8(filled), many, flow.flow_accumulation_mfd(many))]

    whole = chain()
    monkeypatch.setattr(tiles.settle, "__defaults__", (1, np.nan, 6))
    parts = chain()
    for x, y in zip(whole, parts, strict=True):
        assert np.allclose(x, y, equal_nan=True)
    raised = (whole[0] > a) & (a >= 0)
    labels = {(r.y, r.x): r.region for r in flow.regions(dem.with_px(dem.px.selectExpr("y", "x", "case when v = 0 then 1 end as v"))).collect()}
    assert set(labels) == {(int(y), int(x)) for y, x in zip(*np.nonzero(a == 0), strict=True)}
    assert len({labels[y, x] for y in range(5, 9) for x in range(3, 8)}) == 1
    kept = to_array(flow.fill_pits(dem, most_cells=3))
    changed = (kept > a) & (a >= 0)
    assert (changed <= raised).all() and changed.sum() < raised.sum()
    assert spread.packed(np.ones((8, 1, 1))).item() == sum(2 << 4 * k for k in range(8))
