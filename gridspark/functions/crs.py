"""Coordinate systems by EPSG name: WGS84 degrees, Web Mercator and UTM zones, as numpy and as columns.

Anything else raises ValueError.  UTM uses the Krueger series to the third order of the third
flattening (well below a millimetre within a zone).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

A, FLAT = 6378137.0, 1 / 298.257223563
_n = FLAT / (2 - FLAT)
_R = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
#: Coefficients of the Krueger series in the third flattening.
ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
K0, EAST = 0.9996, 500000.0


def _kind(crs: str) -> tuple[str, float, float]:
    """(kind, central meridian, false northing) of an EPSG name."""
    code = int(m[1]) if (m := re.fullmatch(r"(?:EPSG:)?(\d+)", crs.strip(), re.I)) else -1
    if code == 4326:
        return "deg", 0.0, 0.0
    if code == 3857:
        return "web", 0.0, 0.0
    for first, north in ((32600, 0.0), (32700, 1e7), (26900, 0.0)):
        if first < code <= first + 60:
            return "utm", 6 * (code - first) - 183.0, north
    raise ValueError(f"coordinate system {crs!r} isn't supported")


def _to_degrees(x: np.ndarray, y: np.ndarray, crs: str) -> tuple[np.ndarray, np.ndarray]:
    kind, lon0, north = _kind(crs)
    if kind == "deg":
        return x, y
    if kind == "web":
        return np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - math.pi / 2)
    xi, eta = (y - north) / (K0 * _R), (x - EAST) / (K0 * _R)
    xi1 = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    eta1 = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = np.arcsin(np.sin(xi1) / np.cosh(eta1))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return lon0 + np.degrees(np.arctan2(np.sinh(eta1), np.cos(xi1))), np.degrees(lat)


def _from_degrees(lon: np.ndarray, lat: np.ndarray, crs: str) -> tuple[np.ndarray, np.ndarray]:
    kind, lon0, north = _kind(crs)
    if kind == "deg":
        return lon, lat
    phi = np.radians(lat)
    if kind == "web":
        return A * np.radians(lon), A * np.log(np.tan(math.pi / 4 + phi / 2))
    e = 2 * math.sqrt(_n) / (1 + _n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    d = np.radians(lon - lon0)
    xi, eta = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return EAST + K0 * _R * x, north + K0 * _R * y


def transform(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Points from one system to another; x is longitude or easting."""
    if source == target:
        return np.asarray(x, float), np.asarray(y, float)
    with np.errstate(all="ignore"):
        return _from_degrees(*_to_degrees(np.asarray(x, float), np.asarray(y, float), source), target)


def transform_columns(df: DataFrame, x: str, y: str, source: str, target: str) -> DataFrame:
    """``df`` with two columns transformed, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[x], batch[y] = transform(batch[x].to_numpy(), batch[y].to_numpy(), source, target)
            yield batch

    return df.mapInPandas(run, df.schema)
