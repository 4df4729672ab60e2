"""Files of our own formats in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow.fs as pafs

from gridspark.llm import common as C

#: Arrays that a worker keeps mapped.
MAPPED = 512


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, *chunks: bytes) -> None:
    fs, path = open_fs(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        for chunk in chunks:
            f.write(chunk)
    fs.move(own, path)


def get(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


class Arrays:
    """Arrays below a folder, mapped where it is a file system, else read; the latest are kept."""

    def __init__(self, uri: str) -> None:
        self.uri, self.held = uri, OrderedDict()

    def __call__(self, name: str, dtype: str) -> np.ndarray:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        fs, path = open_fs(f"{self.uri}/{name}")
        info = fs.get_file_info(path)
        if info.type != pafs.FileType.File or not info.size:
            found = np.zeros(0, dtype)
        elif isinstance(fs, pafs.LocalFileSystem):
            found = np.memmap(path, dtype, "r")
        else:
            found = np.frombuffer(get(f"{self.uri}/{name}"), dtype)
        self.held[name] = found
        if len(self.held) > MAPPED:
            self.held.popitem(last=False)
        return found


_arrays: dict[str, Arrays] = {}


def arrays(uri: str) -> Arrays:
    if uri not in _arrays:
        _arrays.clear()
        _arrays[uri] = Arrays(uri)
    return _arrays[uri]


def member(uri: str, name: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key is in the sorted arrays ``name-*.u8``, which are cut by the key's upper ``bits``."""
    distinct, inverse = C.distinct_places(keys)
    out = np.zeros(len(distinct), bool)
    cuts = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = distinct[cuts[b] : cuts[b + 1]]
        if len(known := arrays(uri)(f"{name}-{b:05d}.u8", "<u8")):
            out[cuts[b] : cuts[b + 1]] = known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part
    return out[inverse]


def counts_of(uri: str, name: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """The count stored for each key in ``name-*.u8`` / ``.n1``, 0 for keys that aren't there."""
    distinct, inverse = C.distinct_places(keys)
    out = np.zeros(len(distinct), np.uint8)
    cuts = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = distinct[cuts[b] : cuts[b + 1]]
        if len(known := arrays(uri)(f"{name}-{b:05d}.u8", "<u8")):
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = known[at] == part
            out[cuts[b] : cuts[b + 1]][hit] = arrays(uri)(f"{name}-{b:05d}.n1", np.uint8)[at[hit]]
    return out[inverse]
