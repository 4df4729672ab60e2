"""Helpers shared by the operators: tokens as 64-bit hashes, shared tables, keyed sums.

A *word* is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  ``bytes.split()`` cuts at
exactly these six bytes, and none of them occurs inside a multi-byte UTF-8 sequence, so
splitting the encoded text gives the words without decoding it.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Odd multipliers of the rolling hashes (two independent ones give 128 bits).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_local_root: list[str] = []


def _lean() -> None:
    """Give freed arrays back to the system at once, so that idle workers hold little (glibc only)."""
    pa.set_memory_pool(pa.system_memory_pool())
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option:
        for option, value in ((-3, 2 << 20), (-1, 4 << 20), (-8, 2)):  # mmap threshold, trim threshold, arenas
            set_option(option, value)


_lean()


# ---------------------------------------------------------------- shared tables
def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset (local tests)
    a temporary folder of this process stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="gridspark-"))
        root = f"file://{_local_root[0]}"
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/gridspark/{uuid.uuid4().hex}/{name}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here.

    A lost executor costs nothing but its running tasks, since the files outlive it.
    """
    path = shared_path(spark, name)
    # small row groups: a writer holds one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key() -> Column:
    """A hash of a row's ``doc_id`` and ``text``, which tells rows apart whose ids are null or repeat.

    Rows of one id and one text share it; two others do with probability n^2 / 2^65.
    """
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


def boxed(docs: DataFrame) -> DataFrame:
    """(__key, __row): the row key and all columns of each row as one, so that no name of theirs can clash."""
    return docs.select(row_key().alias("__key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts (rows here, bytes where supported)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashes
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (splitmix constants)."""
    out = np.array(x, np.uint64)
    flat = out.reshape(-1)
    for i in range(0, len(flat), 1 << 14):  # in the processor's cache
        part = flat[i : i + (1 << 14)]
        part ^= part >> np.uint64(30)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(27)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (``np.unique`` hashes them first, which takes many times as long)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def distinct_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and for each entry of ``x`` the place of its value among them."""
    order = np.argsort(x)
    values = x[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1])) if len(x) else np.zeros(0, bool)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return values[fresh], place


@functools.cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(BLOCK + 1, b, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


# ---------------------------------------------------------------- words and hashes
def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def buffer_of(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one entry more); null is empty."""
    column = pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, cuts - cuts[0]


#: Bytes that are hashed together, so that temporaries stay below 10 MB and in the processor's cache.
BLOCK = 1 << 18
#: A word of more bytes is hashed as a whole by xxh3.
LONG_WORD = 1 << 11


def white(raw: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def folded(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return raw + (((raw - np.uint8(65)) < 26) * np.uint8(32))


def word_spans(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word reaches over the border of two texts."""
    starts, ends = [], []
    for a in range(0, len(raw), BLOCK):
        z = min(a + BLOCK, len(raw))
        # the byte before the block and the one after it count too
        seen = np.concatenate((np.ones(int(a == 0), bool), white(raw[max(a - 1, 0) : z + 1]), np.ones(int(z == len(raw)), bool)))
        before, own, after = seen[: z - a].copy(), seen[1 : z - a + 1], seen[2:].copy()
        inner = cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, z, "right")] - a
        before[inner[inner < z - a]] = True
        after[inner[inner > 0] - 1] = True
        starts.append(np.flatnonzero(~own & before) + a)
        ends.append(np.flatnonzero(~own & after) + a + 1)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def span_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of the bytes of each span (ascending and apart), a polynomial modulo 2**64.

    Prefix sums over a block of bytes give all its spans at once; nothing is done per word.
    """
    out = np.zeros(len(first), np.uint64)
    if not len(first):
        return out
    up, down = _powers(BASES[0])
    at = 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(end, first[at] + BLOCK, "right")))
        lo, hi = int(first[at]), int(end[stop - 1])
        if hi - lo <= BLOCK:
            own, sums = raw[lo:hi], np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((folded(own) if lower else own) * up[: hi - lo], out=sums[1:])
            begin = first[at:stop] - lo
            out[at:stop] = (sums[end[at:stop] - lo] - sums[begin]) * down[begin]
        at = stop
    length = end - first
    out = mix(out + length.astype(np.uint64) * np.uint64(BASES[1]))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        word = raw[first[i] : end[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out


def word_hashes(texts: pa.Array | list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (``lower`` folds A-Z), and where each text begins (one entry more)."""
    raw, cuts = buffer_of(texts)
    first, end = word_spans(raw, cuts)
    return span_hashes(raw, first, end, lower), np.searchsorted(first, cuts)


def in_pieces(batch: pa.RecordBatch, name: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have ``most`` bytes, or one text."""
    _, cuts = buffer_of(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def window_hashes(flat: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each run of ``n`` values, sum of ``x[i + k] * base**k``; the result has ``len(flat)-n+1`` entries.

    Prefix sums of ``x[i] * base**i`` modulo 2**64 give every window by one subtraction;
    multiplying by the inverse power makes it independent of the position.
    """
    m, size = len(flat) - n + 1, 1 << 15
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, (up, down) = np.empty(m, np.uint64), _powers(base)
    for i in range(0, m, size):
        k = min(size, m - i)
        sums = np.zeros(k + n, np.uint64)
        np.cumsum(flat[i : i + k + n - 1] * up[: k + n - 1], out=sums[1:])
        out[i : i + k] = mix((sums[n:] - sums[:k]) * down[:k])
    return out


def shingle_sets(texts: pa.Array | list[bytes], n: int = 5) -> list[np.ndarray]:
    """Distinct ``n``-word shingles of each text as sorted hashes (A-Z lower-cased).

    A text of fewer words gives its whole sequence as one shingle, one without words none.
    """
    flat, starts = word_hashes(texts, lower=True)
    grams, out = window_hashes(flat, n), []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(distinct(grams[a : b - n + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes(), seed=b - a)], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def crc_of_id(ids: list) -> np.ndarray:
    """crc32 of each id written as decimal text; a null id counts as the empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) for i in ids), np.int64, len(ids))


# ---------------------------------------------------------------- packed arrays
_zstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(raw: bytes) -> bytes:
    return _zstd[0].compress(raw)


def unpress(blob: bytes) -> bytes:
    return _zstd[1].decompress(blob)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a compressed blob, one byte plane after the other.

    The first is sorted uint64 keys and is stored as differences.
    """
    n = len(arrays[0])
    keys = np.diff(arrays[0], prepend=np.uint64(0))
    head = np.array([n, *(ord(a.dtype.kind) << 8 | a.dtype.itemsize for a in arrays)], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes() for a in (keys, *arrays[1:])]
    return np.int64(len(arrays)).tobytes() + head.tobytes() + press(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    n, *kinds = np.frombuffer(blob, np.int64, k + 1, 8).tolist()
    raw, at, out = unpress(blob[8 * (k + 2) :]) if n else b"", 0, []
    for kind in kinds:
        size = kind & 255
        dtype = np.dtype(f"{chr(kind >> 8)}{size}")
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(dtype).reshape(n))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of the values of each."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def by_bucket(keys: np.ndarray, buckets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket number and positions of its keys, in key order within the bucket."""
    order = np.lexsort((keys, buckets))
    cuts = np.searchsorted(buckets[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


# ---------------------------------------------------------------- connected components
#: Links that one task joins at once (16 MB); beyond it the rounds below take over.
ONE_TASK = 1 << 20


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["node", "component"])


def components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for nodes with an edge.

    Up to ``ONE_TASK`` links are joined by union-find in a single task, whose memory that bounds.
    More take rounds of neighbour minimum and pointer jumping over tables in the shared folder,
    with the same result: every node keeps a label that is a node of its own component and
    never grows, so the loop ends when no label changes.  The driver sees one number a round.
    """
    pairs = written(spark, edges.select(F.col(a).alias("u"), F.col(b).alias("v")), "edges")
    if pairs.count() <= ONE_TASK:
        return written(spark, pairs.repartition(1).mapInArrow(_union, "node long, component long"), "labels")
    return _rounds(spark, pairs)


def _rounds(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    both = written(spark, pairs.union(pairs.select("v", "u")).distinct(), "both")
    labels = written(spark, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        parent = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(spark, new.join(parent, "label").select("node", F.least("label", "up").alias("label"), "old"), "labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


# ---------------------------------------------------------------- bounded filters
BLOOM_BITS, BLOOM_BLOCK = 1 << 26, 1 << 19


def _bloom_positions(hashes: np.ndarray) -> np.ndarray:
    h = mix(hashes)
    with np.errstate(over="ignore"):
        return np.concatenate([(h + np.uint64(i) * mix(h ^ np.uint64(BASES[1]))) % np.uint64(BLOOM_BITS) for i in (0, 1, 2)]).astype(np.int64)


def bloom(spark: SparkSession, longs: DataFrame) -> np.ndarray:
    """Bloom filter over a frame of one long column: 8 MB at any size of the data.

    It only saves work: a value that isn't in the frame may pass, none that is fails.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            at = _bloom_positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = seen.reshape(-1, BLOOM_BLOCK // 8)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([press(parts[i].tobytes()) for i in some], pa.binary())], ["block", "bits"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(BLOOM_BLOCK // 8, np.uint8)
        for blob in table["bits"].to_pylist():
            total |= np.frombuffer(unpress(blob), np.uint8)
        return pa.table({"block": table["block"][:1], "bits": pa.array([press(total.tobytes())], pa.binary())})

    schema = "block long, bits binary"
    out = np.zeros((BLOOM_BITS // BLOOM_BLOCK, BLOOM_BLOCK // 8), np.uint8)
    for r in longs.distinct().mapInArrow(blocks, schema).groupBy("block").applyInArrow(merge, schema).collect():
        out[r.block] = np.frombuffer(unpress(r.bits), np.uint8)
    return out.reshape(-1)


def bloom_has(filter_bits: np.ndarray, longs: np.ndarray) -> np.ndarray:
    at = _bloom_positions(longs.view(np.uint64))
    return ((filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).reshape(3, -1).all(axis=0)
