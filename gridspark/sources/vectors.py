"""Vector files as features: GeoJSON and GeoPackage read by tasks, GeoJSON and Parquet written."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridspark.functions import wkb

_KINDS = {"Point": wkb.POINT, "LineString": wkb.LINE, "Polygon": wkb.POLYGON, "MultiPoint": wkb.MULTI_POINT, "MultiLineString": wkb.MULTI_LINE, "MultiPolygon": wkb.MULTI_POLYGON}


def geometry(obj: dict | None) -> bytes | None:
    """WKB of a GeoJSON geometry."""
    if not obj:
        return None
    kind, c = _KINDS[obj["type"]], obj["coordinates"]
    flat = lambda p: np.asarray(p, float).reshape(-1, len(p[0]))[:, :2]
    if kind == wkb.POINT:
        return wkb.write(kind, [np.asarray([c[:2]], float)])
    if kind == wkb.LINE:
        return wkb.write(kind, [flat(c)])
    if kind == wkb.POLYGON:
        return wkb.write(kind, [[flat(r) for r in c]])
    if kind == wkb.MULTI_POINT:
        return wkb.write(kind, [np.asarray([p[:2]], float) for p in c])
    if kind == wkb.MULTI_LINE:
        return wkb.write(kind, [flat(p) for p in c])
    return wkb.write(kind, [[flat(r) for r in p] for p in c])


def to_geojson(raw: bytes | None) -> dict | None:
    if raw is None:
        return None
    kind, parts = wkb.read(raw)
    name = {v: k for k, v in _KINDS.items()}[kind]
    coords = [[r.tolist() for r in p] if isinstance(p, list) else p.tolist() for p in parts]
    if kind == wkb.POINT:
        return {"type": name, "coordinates": coords[0][0]}
    if kind in (wkb.LINE, wkb.POLYGON):
        return {"type": name, "coordinates": coords[0]}
    return {"type": name, "coordinates": [c[0] for c in coords] if kind == wkb.MULTI_POINT else coords}


def read_geojson(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Features of a collection, numbered from 0, with the named properties."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = json.loads(content)["features"]
                yield pd.DataFrame([(i, geometry(f["geometry"]), *((f.get("properties") or {}).get(k) for k in fields)) for i, f in enumerate(found)], columns=["fid", "geom", *fields])

    schema = ", ".join(["fid long", "geom binary", *(f"`{k}` {t}" for k, t in fields.items())])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def read_gpkg(spark: SparkSession, path: str, table: str, fields: dict[str, str]) -> DataFrame:
    """Features of a GeoPackage layer with its own ids."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                column = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()[0]
                key = next(r[1] for r in db.execute(f'PRAGMA table_info("{table}")') if r[5])
                names = ", ".join(f'"{n}"' for n in (key, column, *fields))
                rows = [(r[0], strip_header(r[1]), *r[2:]) for r in db.execute(f'SELECT {names} FROM "{table}"')]
                yield pd.DataFrame(rows, columns=["fid", "geom", *fields])

    schema = ", ".join(["fid long", "geom binary", *(f"`{k}` {t}" for k, t in fields.items())])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def strip_header(blob: bytes | None) -> bytes | None:
    """WKB of a GeoPackage geometry: its header and envelope are dropped."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 16:
        return None
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] :]


def write_geojson(features: DataFrame, path: str) -> None:
    """One line of GeoJSON per feature, as Spark's text files."""
    names = [c for c in features.columns if c not in ("fid", "geom", "bbox")]

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [json.dumps({"type": "Feature", "id": int(r["fid"]), "geometry": to_geojson(r["geom"]), "properties": {k: r[k] for k in names}}, default=str) for r in batch.to_dict("records")]})

    features.select("fid", "geom", *names).mapInPandas(lines, "value string").write.text(path)
