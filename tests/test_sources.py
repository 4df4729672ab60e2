"""Files written and read again."""

import json

import numpy as np
import pytest

from gridspark.functions import wkb
from gridspark.operators.model import from_array, to_array
from gridspark.sources import lzw, rasters, vectors


def test_raster_files(spark, tmp_path):
    a = np.arange(12, dtype=np.int16).reshape(3, 4)
    g = from_array(spark, a, nodata=5, pixel_size=(30.0, -30.0), origin=(100.0, 200.0), crs="EPSG:32610")
    (tmp_path / "a.tif").write_bytes(rasters.to_tiff(g, a))
    (tmp_path / "a.asc").write_text(rasters.to_ascii(g, a))
    np.save(tmp_path / "a.npy", a)
    tif, asc, npy = (rasters.read_raster(spark, str(tmp_path / f"a.{k}")) for k in ("tif", "asc", "npy"))
    assert (tif.gt, tif.crs, tif.nodata, tif.dtype) == (g.gt, g.crs, 5, "int16")
    for r in (tif, asc):
        assert to_array(r, fill=-1)[1, 1] == -1 and to_array(r, fill=5).tolist() == a.tolist() and r.bounding_box == g.bounding_box
    assert to_array(npy).tolist() == a.tolist()
    with pytest.raises(ValueError):
        rasters.parse(b"nothing")


@pytest.mark.parametrize("options", [("TILED=YES", "COMPRESS=LZW", "BLOCKXSIZE=16", "BLOCKYSIZE=32"), ("COMPRESS=LZW", "PREDICTOR=2"), ("COMPRESS=NONE", "TILED=YES"), ("PREDICTOR=2",)])
def test_tiff_creation_options(spark, options):
    a = np.random.default_rng(1).integers(0, 60, (70, 45)).astype(np.int32) * 7
    g = from_array(spark, a[:1, :1], nodata=-1, pixel_size=(30.0, -30.0), origin=(100.0, 200.0))
    g = g.with_px(g.px, n_rows=70, n_cols=45, dtype="int32")
    meta, back = rasters.parse(rasters.to_tiff(g, a, options))
    assert (back[0] == a).all() and meta["nodata"] == -1 and meta["gt"] == (100.0, 30.0, 0.0, 200.0, 0.0, -30.0)
    with pytest.raises(ValueError):
        rasters.to_tiff(g, a, ("COMPRESS=WORSE",))


def test_lzw_known_and_long_data():
    # fixed values: the example of the TIFF 6.0 specification
    assert lzw.decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"aaaa" * 9000, rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), rng.integers(0, 4, 60_000).astype(np.uint8).tobytes()):
        assert lzw.decode(lzw.encode(data)) == data


def test_tiles(spark, tmp_path):
    a = np.random.default_rng(0).random((10, 13))
    a[3, 4] = -1
    g = from_array(spark, a, nodata=-1, pixel_size=(1.0, -1.0), origin=(0.0, 0.0))
    rasters.write_tiles(g, str(tmp_path / "t"), size=4)
    assert np.array_equal(to_array(rasters.read_tiles(spark, str(tmp_path / "t"))), a)
    assert rasters.read_tiles(spark, str(tmp_path / "t"), (0, -3.5, 3.5, 0)).px.count() == 16


def test_geojson(spark, tmp_path):
    rows = [(0, bytearray(wkb.box(0, 0, 1, 1)), "a"), (1, bytearray(wkb.write(wkb.POINT, [np.array([[2.0, 3.0]])])), "b"), (2, None, "c")]
    df = spark.createDataFrame(rows, "fid long, geom binary, name string").coalesce(1)
    vectors.write_geojson(df, str(tmp_path / "out"))
    found = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    back = vectors.read_geojson(spark, str(tmp_path / "c.geojson"), {"name": "string"}).orderBy("fid").collect()
    assert [(r.name, bytes(r.geom) if r.geom else None) for r in back] == [(n, bytes(g) if g else None) for _, g, n in rows]
