"""Raster files as grids: .npy, ESRI ASCII and baseline GeoTIFF (strips or tiles; raw, LZW or deflate).

Files are read by Spark's ``binaryFile`` source, so any path that Spark can open will do, and
are cut into pixels by the tasks.  Grids are stored as Parquet tiles by ``write_tiles``.
"""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.model import Grid, matches
from gridspark.sources import lzw

Meta = dict
RASTER, VECTOR = 1, 2


def parse(raw: bytes, name: str = "") -> tuple[Meta, np.ndarray]:
    """(metadata, bands x rows x columns) of a file's bytes; ValueError for an unknown format."""
    if raw[:6] == b"\x93NUMPY":
        a = np.load(io.BytesIO(raw), allow_pickle=False)
        return {"gt": (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "crs": None, "nodata": None}, a if a.ndim == 3 else a.reshape(1, *a.shape[-2:])
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(raw)
    if raw[:5].lower() == b"ncols":
        return _ascii(raw.decode())
    raise ValueError(f"{name or 'the file'} isn't a known raster format")


def gis_type(raw: bytes) -> int:
    """1 for a raster, 2 for a vector; ValueError for neither."""
    if raw[:6] == b"\x93NUMPY" or raw[:4] in (b"II*\0", b"MM\0*") or raw[:5].lower() == b"ncols":
        return RASTER
    if raw[:15] == b"SQLite format 3" or raw.lstrip()[:1] == b"{" and b'"Feature' in raw[:4096]:
        return VECTOR
    raise ValueError("neither a raster nor a vector")


def _ascii(text: str) -> tuple[Meta, np.ndarray]:
    head, lines = {}, text.splitlines()
    while lines and lines[0].split()[0][0].isalpha():
        k, v = lines.pop(0).split()
        head[k.lower()] = float(v)
    h, w, size = int(head["nrows"]), int(head["ncols"]), head.get("cellsize", 1.0)
    half = size / 2 if "xllcenter" in head else 0.0
    x, y = head.get("xllcorner", head.get("xllcenter", 0.0)) - half, head.get("yllcorner", head.get("yllcenter", 0.0)) - half
    a = np.array(" ".join(lines).split(), float).reshape(1, h, w)
    return {"gt": (x, size, 0.0, y + h * size, 0.0, -size), "crs": None, "nodata": head.get("nodata_value")}, a


def to_ascii(grid: Grid, array: np.ndarray) -> str:
    """An ESRI ASCII file of a grid with square pixels."""
    if abs(grid.gt[1]) != abs(grid.gt[5]):
        raise ValueError("ESRI ASCII needs square pixels")
    box = grid.bounding_box
    head = [f"ncols {grid.n_cols}", f"nrows {grid.n_rows}", f"xllcorner {box[0]!r}", f"yllcorner {box[1]!r}", f"cellsize {abs(grid.gt[1])!r}"]
    head += [f"NODATA_value {grid.nodata!r}"] if grid.nodata is not None else []
    return "\n".join([*head, *(" ".join(repr(float(v)) for v in row) for row in array)]) + "\n"


def _tiff(raw: bytes) -> tuple[Meta, np.ndarray]:
    e = "<" if raw[:2] == b"II" else ">"
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
    at, tags = struct.unpack_from(e + "I", raw, 4)[0], {}
    for i in range(struct.unpack_from(e + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", raw, at + 2 + 12 * i)
        code = kinds.get(kind, "B")
        size = struct.calcsize("=" + code) * n
        where = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(e + "I", raw, at + 2 + 12 * i + 8)[0]
        tags[tag] = raw[where : where + n] if code == "s" else struct.unpack_from(e + code * n, raw, where)
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(f"{e}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}".replace(" ", ""))
    compression, predictor, planar = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0]
    if compression not in (1, 5, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"TIFF compression {compression} with predictor {predictor} isn't supported")
    if 322 in tags:
        bw, bh, offsets, counts = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        bw, bh, offsets, counts = w, tags.get(278, (h,))[0], tags[273], tags[279]
    across, down = -(-w // bw), -(-h // bh)
    per = bands if planar == 1 else 1
    out = np.zeros((bands, h, w), dtype.newbyteorder("="))
    for i, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        block = raw[o : o + c] if compression == 1 else lzw.decode(raw[o : o + c]) if compression == 5 else zlib.decompress(raw[o : o + c])
        plane, k = divmod(i, across * down)
        y, x = (k // across) * bh, (k % across) * bw
        rows = min(bh, len(block) // (bw * per * dtype.itemsize))
        a = np.frombuffer(block, dtype, rows * bw * per).reshape(rows, bw, per)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        a = a[: h - y, : w - x]
        for b in range(per):
            out[plane + b if planar != 1 else b, y : y + a.shape[0], x : x + a.shape[1]] = a[:, :, b]
    gt = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    if 33550 in tags and 33922 in tags:
        (sx, sy), tie = tags[33550][:2], tags[33922]
        gt = (tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy)
    elif 34264 in tags:
        m = tags[34264]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    keys = tags.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    epsg = codes.get(3072) or codes.get(2048)
    nodata = tags[42113].split(b"\0")[0].strip() if 42113 in tags else b""
    return {"gt": tuple(map(float, gt)), "crs": f"EPSG:{epsg}" if epsg else None, "nodata": float(nodata) if nodata else None}, out


#: TIFF's numbers of compressions.
COMPRESSIONS = {"NONE": 1, "LZW": 5, "DEFLATE": 8}


def _options(options: Sequence[str]) -> dict[str, str]:
    """KEY=VALUE creation options; ValueError for what isn't known."""
    out = {"TILED": "NO", "COMPRESS": "DEFLATE", "BLOCKXSIZE": "256", "BLOCKYSIZE": "256", "PREDICTOR": "1"}
    for option in options:
        key, equals, value = option.upper().partition("=")
        if not equals or key not in out or key == "COMPRESS" and value not in COMPRESSIONS or key == "PREDICTOR" and value not in ("1", "2"):
            raise ValueError(f"unknown creation option {option!r}")
        out[key] = value
    return out


def to_tiff(grid: Grid, array: np.ndarray, creation_options: Sequence[str] = ()) -> bytes:
    """A one-band GeoTIFF; by default of deflated strips.

    Options: TILED=YES|NO, BLOCKXSIZE and BLOCKYSIZE (multiples of 16), COMPRESS=NONE|LZW|DEFLATE, PREDICTOR=1|2.
    """
    asked = _options(creation_options)
    a = np.ascontiguousarray(array, np.dtype(grid.dtype).newbyteorder("<"))
    if asked["TILED"] == "YES":
        bw, bh = int(asked["BLOCKXSIZE"]), int(asked["BLOCKYSIZE"])
        if bw % 16 or bh % 16 or bw <= 0 or bh <= 0:
            raise ValueError("tile sizes are multiples of 16")
        padded = np.zeros((-(-len(a) // bh) * bh, -(-a.shape[1] // bw) * bw), a.dtype)
        padded[: len(a), : a.shape[1]] = a
        blocks = [padded[y : y + bh, x : x + bw] for y in range(0, len(padded), bh) for x in range(0, padded.shape[1], bw)]
    else:
        bw, bh = 0, max(1, (1 << 16) // max(1, a[0].nbytes))
        blocks = [a[y : y + bh] for y in range(0, len(a), bh)]
    if asked["PREDICTOR"] == "2":
        if a.dtype.kind == "f":
            raise ValueError("predictor 2 is for whole numbers")
        blocks = [np.concatenate((x[:, :1], np.diff(x, axis=1).astype(a.dtype)), axis=1) for x in blocks]
    press = {"NONE": bytes, "LZW": lzw.encode, "DEFLATE": zlib.compress}[asked["COMPRESS"]]
    strips = [press(np.ascontiguousarray(x).tobytes()) for x in blocks]
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    offsets = np.concatenate(([8], 8 + np.cumsum([len(x) for x in strips])))[:-1].tolist()
    g, n = grid.gt, len(strips)
    one = lambda kind, value: (kind, struct.pack("<H" if kind == 3 else "<I", value), 1)
    many = lambda values: (4, struct.pack(f"<{n}I", *values), n)
    fields = {256: one(4, grid.n_cols), 257: one(4, grid.n_rows), 258: one(3, 8 * a.itemsize), 259: one(3, COMPRESSIONS[asked["COMPRESS"]]), 262: one(3, 1), 277: one(3, 1), 339: one(3, form), 317: one(3, int(asked["PREDICTOR"]))}
    fields |= {33550: (12, struct.pack("<3d", g[1], -g[5], 0), 3), 33922: (12, struct.pack("<6d", 0, 0, 0, g[0], g[3], 0), 6)}
    fields |= {322: one(4, bw), 323: one(4, bh), 324: many(offsets), 325: many(map(len, strips))} if bw else {273: many(offsets), 278: one(4, bh), 279: many(map(len, strips))}
    tags: list[tuple[int, int, bytes, int]] = [(tag, *field) for tag, field in fields.items()]
    if grid.crs and (code := int(grid.crs.rpartition(":")[2])):
        geographic = code == 4326
        tags.append((34735, 3, struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, code), 12))
    if grid.nodata is not None:
        text = f"{grid.nodata!r}\0".encode()
        tags.append((42113, 2, text, len(text)))
    at = 8 + sum(map(len, strips))
    extra, entries = b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, kind, data, n in sorted(tags):
        value = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", base + len(extra))
        extra += data if len(data) > 4 else b""
        entries += struct.pack("<HHI", tag, kind, n) + value
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def read_raster(spark: SparkSession, path: str, band: int = 1) -> Grid:
    """A band of one file; its header is parsed on the driver, its pixels by a task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    meta, a = parse(bytes(files.first().content), path)
    if not 1 <= band <= len(a):
        raise ValueError(f"{path} has {len(a)} bands; band {band} doesn't exist")
    nodata, shape, dtype = meta["nodata"], a.shape[1:], a.dtype.name

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                a = parse(content.as_py(), path)[1][band - 1]
                step = max(1, (1 << 18) // a.shape[1])
                for y in range(0, len(a), step):
                    part = a[y : y + step]
                    yy, xx = np.mgrid[y : y + len(part), : a.shape[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(yy.ravel()), pa.array(xx.ravel()), pa.array(part.ravel().astype(float), mask=matches(part, nodata).ravel())], ["y", "x", "v"])

    return Grid(files.mapInArrow(cut, "y long, x long, v double"), *shape, meta["gt"], meta["crs"], dtype, nodata)


# ---------------------------------------------------------------- tiles
def to_tiles(grid: Grid, size: int = 256) -> DataFrame:
    """(ty, tx, h, w, data): blocks of float64 in row order with NaN for nodata."""
    ty, tx = F.expr(f"y div {size}").alias("ty"), F.expr(f"x div {size}").alias("tx")
    n_rows, n_cols = grid.n_rows, grid.n_cols

    def block(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        h, w = min(size, n_rows - a * size), min(size, n_cols - b * size)
        data = np.full((h, w), np.nan)
        data[table["y"].to_numpy() - a * size, table["x"].to_numpy() - b * size] = table["v"].to_numpy(zero_copy_only=False)
        return pa.table({"ty": pa.array([a], pa.int64()), "tx": pa.array([b], pa.int64()), "h": pa.array([h], pa.int32()), "w": pa.array([w], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    px = grid.px.select(ty, tx, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    return px.groupBy("ty", "tx").applyInArrow(block, "ty long, tx long, h int, w int, data binary")


def from_tiles(tiles: DataFrame, size: int = 256) -> DataFrame:
    """Pixels of tiles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ty, tx, h, w, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                a = np.frombuffer(data).reshape(h, w)
                yy, xx = np.mgrid[ty * size : ty * size + h, tx * size : tx * size + w]
                yield pa.RecordBatch.from_arrays([pa.array(yy.ravel()), pa.array(xx.ravel()), pa.array(a.ravel(), mask=np.isnan(a.ravel()))], ["y", "x", "v"])

    return tiles.select("ty", "tx", "h", "w", "data").mapInArrow(cut, "y long, x long, v double")


def write_tiles(grid: Grid, path: str, size: int = 256) -> None:
    """Parquet tiles by rows of tiles, so that a reader of a box prunes files, and the metadata beside them."""
    spark = grid.px.sparkSession
    to_tiles(grid, size).repartitionByRange("ty", "tx").write.partitionBy("ty").parquet(f"{path}/tiles")
    meta = [(grid.n_rows, grid.n_cols, list(map(float, grid.gt)), grid.crs, grid.dtype, None if grid.nodata is None else float(grid.nodata), size)]
    spark.createDataFrame(meta, "n_rows long, n_cols long, gt array<double>, crs string, dtype string, nodata double, size int").coalesce(1).write.parquet(f"{path}/meta")


def read_tiles(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> Grid:
    """The stored grid; with a box only the tile rows and columns that it meets are read."""
    m = spark.read.parquet(f"{path}/meta").first()
    tiles = spark.read.parquet(f"{path}/tiles")
    if box is not None:
        rows = sorted((b - m.gt[3]) / m.gt[5] / m["size"] for b in (box[1], box[3]))
        cols = sorted((b - m.gt[0]) / m.gt[1] / m["size"] for b in (box[0], box[2]))
        tiles = tiles.filter(F.col("ty").between(math.floor(rows[0]), math.floor(rows[1])) & F.col("tx").between(math.floor(cols[0]), math.floor(cols[1])))
    tiles = tiles.withColumn("ty", F.col("ty").cast("long"))
    return Grid(from_tiles(tiles, m["size"]), m.n_rows, m.n_cols, tuple(m.gt), m.crs, m.dtype, m.nodata)
