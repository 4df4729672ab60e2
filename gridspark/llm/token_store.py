"""Token ids in raw shard files with a minimal perfect hash index (operator 5).

Layout of a store (a folder that driver and executors share)::

    meta.json            {"dtype", "end_id", "buckets", "starts": ids before each shard, "docs": documents in each shard}
    tokens-00000.bin     raw little-endian ids of the shard's documents, one after the other
    docs-00000.bin       int64 offsets into it, one more than the shard has documents
    index-00000.bin      minimal perfect hash of one bucket of document keys

Documents are in ascending order of their key over all shards.  A key is looked up by its
bucket, then by the levels of bits of the bucket's hash function: on each level a key goes to
one position, and the first level on which its bit is set gives its slot, the number of set
bits before it.  The slot holds a 32-bit fingerprint, the shard, the first row and the number
of rows with that key, which go on in the next shard where one ends.  A lookup thus reads a
bounded number of bits and one slot whatever the size of the store; a key that was never stored
fails the fingerprint (or every level).  ``read_back`` deals keys by bucket first, so that every
bucket of the index is loaded once and not once for each batch of keys.

Shards are ranges of keys: integer keys are cut at approximate quantiles, string keys at those of
a sample of about ``SAMPLED`` keys per shard (cuts decide the layout only, not what is stored).  A
key that holds more than a shard of rows is dealt in turn to all shards between its cuts.

Files are written under a name of their own and then renamed, so that a repeated or
speculative task leaves the same file.

Nulls and edges: a null or empty text is the end id alone; a null key sorts first and is found
as ``None``; equal keys are stored each, in any order, and a lookup gives all of them; keys are
whole numbers or strings; an empty table gives a store without shards; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridspark.llm import common as C
from gridspark.llm.files import get, open_fs, put

KEYS_PER_BUCKET = 100_000
SAMPLED = 100
LEVELS = 48
#: Bytes of text that are cut at once, parts that are looked up at once, and slots of a worker's table of parts (about 61 MB and the ids).
CUT, STRIP, SLOTS = 1 << 19, 1 << 16, 1 << 21
#: 64-bit words of a key: a part of more bytes is encoded each time that a strip has it.
KEY = 3
MULTIPLIERS = 1, *C.BASES
#: Kinds of bytes: others, space, line feed, ASCII letters, ASCII punctuation, control bytes; and after which a part begins at which.
OTHER, SPACE, FEED, LETTER, MARK, CONTROL = range(6)
KINDS = np.array([FEED if i == 10 else SPACE if i == 32 else CONTROL if i < 32 or i == 127 else OTHER if i > 127 or chr(i).isdigit() else LETTER if chr(i).isalpha() else MARK for i in range(256)], np.uint8)
BEGINS = np.zeros((8, 8), bool)
BEGINS[:, [SPACE, FEED]] = BEGINS[FEED] = BEGINS[LETTER, MARK] = True
#: Neighbours for which a text is encoded as a whole.
ODD = np.zeros((8, 8), bool)
ODD[SPACE : FEED + 1, SPACE : FEED + 1] = ODD[:, CONTROL] = True
#: Masks of the lowest 0 to 8 bytes of a word.
BELOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Parts that the pattern of a byte-level tokenizer takes as one word (all of these are letters), and which
#: characters stand for its bytes.
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _plain)}
INDEX_ROW = np.dtype([("print", "<u4"), ("shard", "<u4"), ("row", "<u8"), ("rows", "<u8")])


# ---------------------------------------------------------------- text to ids
def part_starts(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every part of the texts in ``raw``, and which texts have white space beside white space or control bytes."""
    starts, odd = [np.zeros(0, np.int64)], np.zeros(len(cuts) - 1, bool)
    heads = cuts[:-1][cuts[:-1] < cuts[1:]]
    for a in range(0, len(raw), CUT):
        kind = KINDS[raw[max(a - 1, 0) : a + CUT]]
        if a == 0:
            kind = np.concatenate((np.array([OTHER], np.uint8), kind))
        pair = kind[:-1] << np.uint8(3) | kind[1:]
        head = heads[np.searchsorted(heads, a) : np.searchsorted(heads, a + CUT)] - a
        pair[head] &= np.uint8(7)
        begins = BEGINS.reshape(-1)[pair]
        begins[head] = True
        starts.append(np.flatnonzero(begins) + a)
        bad = np.flatnonzero(ODD.reshape(-1)[pair]) + a
        odd[np.searchsorted(cuts, bad, "right") - 1] = True
    return np.concatenate(starts), odd


class Parts:
    """Ids of parts of texts: an open-addressed table in arrays, with the bytes of the parts as keys.

    No Python object is held, and none is made for a part that is known.  A table that is full starts afresh.
    """

    def __init__(self, tokenizer, dtype: np.dtype) -> None:
        self.tokenizer, self.model, self.dtype = tokenizer, tokenizer.model, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(SLOTS, np.uint64) for _ in range(KEY)]  # no part begins with a zero byte
        self.start, self.count, self.ids = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint8), np.zeros(1 << 16, self.dtype)
        self.held, self.used = 0, 0

    def learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Write the ids of these parts behind the used ones: where those of each begin, and their number."""
        ids = [self.of(x.decode()) for x in parts]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(itertools.chain.from_iterable(ids), self.dtype, int(count.sum()))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(self.used // 2 + 2 * len(new), self.dtype)))
        self.ids[self.used : self.used + len(new)] = new
        return self.used + np.cumsum(count) - count, count

    def of(self, part: str) -> list[int]:
        if not WORD.fullmatch(part, part[0] == " "):
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        # one word, which the model takes as it is
        mapped = part.replace(" ", BYTES[32]) if part.isascii() else part.encode().decode("latin-1").translate(BYTES)
        return [t.id for t in self.model.tokenize(mapped)]

    def slots(self, keys: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            there = self.keys[0][slot]
            same = there == keys[0][left]
            for mine, own in zip(keys[1:], self.keys[1:], strict=True):
                same &= own[slot] == mine[left]
            out[left[same]] = slot[same]
            on = np.flatnonzero(~same & (there != 0))
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def store(self, keys: list[np.ndarray], hashes: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Give each of these keys, which differ, the next free slot."""
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[0][slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            at, own = slot[free[one]], left[free[one]]
            for mine, theirs in zip(keys, self.keys, strict=True):
                theirs[at] = mine[own]
            self.start[at], self.count[at] = start[own], count[own]
            on = np.ones(len(left), bool)
            on[free[one]] = False
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        self.held += len(hashes)

    def encode(self, raw: np.ndarray, words: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts of ``raw`` one after the other, and their number by part; ``words`` is ``raw`` as 64-bit words."""
        if self.held > SLOTS * 5 // 8 - len(first):
            self.clear()
        length = end - first
        keys = read_keys(words, first, length)
        hashes = C.mix(sum(key * np.uint64(base) for key, base in zip(keys, MULTIPLIERS, strict=True)))
        slot = self.slots(keys, hashes)
        known = slot >= 0
        known &= length <= 8 * KEY
        start, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        for short in (True, False):
            new = np.flatnonzero(~known & ((length <= 8 * KEY) == short))
            if not len(new):
                continue
            if short:
                order = new[np.argsort(hashes[new], kind="stable")]
                fresh = np.zeros(len(order), bool)
                fresh[0] = True
                for key in keys:
                    fresh[1:] |= key[order[1:]] != key[order[:-1]]
                place, one = np.cumsum(fresh) - 1, order[fresh]
                parts = [raw[a:b].tobytes() for a, b in zip(first[one].tolist(), end[one].tolist(), strict=True)]
            else:
                found: dict[bytes, int] = {}
                order, place = new, np.array([found.setdefault(raw[a:b].tobytes(), len(found)) for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)])
                parts = list(found)
            begin, many = self.learn(parts)
            start[order], count[order] = begin[place], many[place]
            if short:  # long ones are last and overwritten by the next strip
                self.store([key[one] for key in keys], hashes[one], begin, many)
                self.used += int(many.sum())
        upto = np.cumsum(count)
        return self.ids[np.repeat(start - upto + count, count) + np.arange(int(upto[-1]))], count


def read_keys(words: np.ndarray, first: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """The first bytes of each part as ``KEY`` numbers, with zeros behind its end."""
    at, shift, out = first >> 3, ((first & 7) << 3).astype(np.uint64), []
    for k in range(KEY):
        # a shift by 64 in two steps
        key = words[at + k] >> shift | words[at + k + 1] << np.uint64(1) << (np.uint64(63) - shift)
        out.append(key & BELOW[np.clip(length - 8 * k, 0, 8)])
    return out


class Encoder:
    """Ids of whole texts as packed bytes, by the tokenizer in ``path``.

    A byte-level tokenizer with the usual pattern never lets a token reach over a single space or
    line feed between other characters, nor from an ASCII letter to ASCII punctuation: such a
    text is cut there and every distinct part is encoded once.  Any other text, and any other
    tokenizer, is encoded as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_part = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.parts = Parts(self.tokenizer, self.dtype) if self.by_part else None

    def _plain(self, text: str) -> bool:
        """Whether ``text`` is printable but for line feeds and has no added token."""
        return text.replace("\n", "").isprintable() and (self.added is None or not self.added.search(text))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        _, cuts = C.buffer_of(column)
        out, at = [], 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + CUT, "right")) - 1)
            out += self._encode(column.slice(at, stop - at))
            at = stop
        return out

    def _encode(self, column: pa.Array) -> list[bytes]:
        whole = np.ones(len(column), bool)
        out: list[bytes] = [b""] * len(column)
        if self.by_part:
            raw, cuts = C.buffer_of(column)
            first, whole = part_starts(raw, cuts)
            if not self._plain(raw.tobytes().decode()):
                whole |= ~np.array([self._plain(t or "") for t in column.to_pylist()], bool)
            if not whole.all():
                rest = np.flatnonzero(~whole)
                if len(rest) < len(whole):
                    raw, cuts = C.buffer_of(column.take(pa.array(rest)))
                    first, _ = part_starts(raw, cuts)
                ids, upto = self._by_part(raw, first)
                ends = (upto[np.searchsorted(first, cuts)] * self.dtype.itemsize).tolist()
                for i, a, b in zip(rest.tolist(), ends[:-1], ends[1:], strict=True):
                    out[i] = ids[a:b]
        rest = np.flatnonzero(whole).tolist()
        for i, got in zip(rest, self.tokenizer.encode_batch_fast([column[i].as_py() or "" for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = np.array(got.ids, self.dtype).tobytes()
        return out

    def _by_part(self, raw: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of all parts as packed bytes, and the number of ids before each part (one entry more)."""
        padded = np.zeros((len(raw) >> 3) + KEY + 2, np.uint64)
        padded.view(np.uint8)[: len(raw)] = raw
        ids, counts, end = [], [np.zeros(1, np.int64)], np.append(first[1:], len(raw))
        for i in range(0, len(first), STRIP):
            got, count = self.parts.encode(raw, padded, first[i : i + STRIP], end[i : i + STRIP])
            ids.append(got.tobytes())
            counts.append(count)
        return b"".join(ids), np.cumsum(np.concatenate(counts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- minimal perfect hash
def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hash of each key (integers or strings; null has one of its own)."""
    if pa.types.is_integer(keys.type):
        values = C.mix(keys.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(C.BASES[1]))
    else:
        values = np.array([C.xxhash.xxh3_64_intdigest((k or "").encode()) for k in keys.to_pylist()], np.uint64)
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), np.uint64(C.BASES[0]), values)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (C.mix(hashes ^ np.uint64(C.BASES[0])) % np.uint64(buckets)).astype(np.int64)


def build_index(hashes: np.ndarray, rows: np.ndarray) -> bytes:
    """Index of one bucket: distinct key hashes and their ``INDEX_ROW`` entries."""
    left, bits, sizes, slots, base = np.arange(len(hashes)), [], [], np.zeros(len(hashes), np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            break
        m = -(-max(64, 2 * len(left)) // 64) * 64
        at = (C.mix(hashes[left] + np.uint64((level + 1) * C.BASES[0] & C.MASK)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m)[at] == 1
        flags = np.zeros(m, bool)
        flags[at[alone]] = True
        slots[left[alone]] = base + np.cumsum(flags)[at[alone]] - 1
        base += int(alone.sum())
        bits.append(np.packbits(flags, bitorder="little").tobytes())
        sizes.append(m)
        left = left[~alone]
    if len(left):
        raise ValueError("two keys share a 64-bit hash")
    out = np.zeros(len(hashes), INDEX_ROW)
    out[slots] = rows
    return np.array([len(hashes), len(sizes), *sizes], "<i8").tobytes() + b"".join(bits) + out.tobytes()


class Index:
    """One bucket's index, read from its bytes."""

    def __init__(self, raw: bytes) -> None:
        n, k = np.frombuffer(raw, "<i8", 2).tolist()
        self.sizes = np.frombuffer(raw, "<i8", k, 16).tolist()
        at, self.levels = 16 + 8 * k, []
        for m in self.sizes:
            self.levels.append(np.frombuffer(raw, np.uint8, m // 8, at))
            at += m // 8
        counts = [np.unpackbits(x, bitorder="little").reshape(-1, 64).sum(axis=1, dtype=np.int64) for x in self.levels]
        before = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
        cuts = np.concatenate(([0], np.cumsum([len(c) for c in counts]))).astype(int)
        self.before = [before[cuts[i] : cuts[i + 1]] for i in range(len(counts))]
        self.rows = np.frombuffer(raw, INDEX_ROW, n, at)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that aren't stored."""
        slot, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, m in enumerate(self.sizes):
            at = (C.mix(hashes[left] + np.uint64((level + 1) * C.BASES[0] & C.MASK)) % np.uint64(m)).astype(np.int64)
            words = self.levels[level].view("<u8")[at >> 6]
            hit = (words >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            below = words[hit] & ((np.uint64(1) << (at[hit] & 63).astype(np.uint64)) - np.uint64(1))
            slot[left[hit]] = self.before[level][at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        found = slot >= 0
        wrong = self.rows["print"][slot[found]] != prints(hashes[found])
        slot[np.flatnonzero(found)[wrong]] = -1
        return slot


def prints(hashes: np.ndarray) -> np.ndarray:
    return (C.mix(hashes ^ np.uint64(C.BASES[1])) >> np.uint64(32)).astype(np.uint32)


# ---------------------------------------------------------------- write
def write_store(docs: DataFrame, tokenizer: str, uri: str, end_id: int = 2, key: str = "doc_id") -> dict:
    """Encode the texts of ``docs`` and write the store below ``uri``; returns its meta data."""
    spark = docs.sparkSession
    C.arrow_batches(spark)
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    kind = docs.schema[key]
    shards = max(1, docs.select(key, "text").rdd.getNumPartitions())
    n, cuts = _cuts(docs.select(F.col(f"`{key}`").alias("k")), shards)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        end, dealt = np.array([end_id], enc.dtype).tobytes(), 0
        for batch in batches:
            keys = batch.column(0)
            shard = _shard_of(keys, cuts, dealt)
            dealt += len(batch)
            ids = [x + end for x in enc.encode(batch.column(1))]
            n = [len(x) // enc.dtype.itemsize for x in ids]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(shard, pa.int32()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())],
                ["k", "shard", "n", "crc", "ids"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, press, offsets, shard, fs = None, "", zstandard.ZstdDecompressor(), [0], -1, None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                shard = batch.column(1)[0].as_py()
                fs, path = open_fs(f"{uri}/tokens-{shard:05d}.bin")
                own = f"{path}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(own)
            first = len(offsets) - 1
            for blob, n in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out.write(press.decompress(blob))
                offsets.append(offsets[-1] + n)
            hashes = key_hashes(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(bucket_of(hashes, buckets), pa.int32()), batch.column(1), pa.array(range(first, first + len(batch)), pa.int64()), batch.column(2)],
                ["h", "bucket", "shard", "row", "n"],
            )
        if out is not None:
            out.close()
            fs.move(own, path)
            put(f"{uri}/docs-{shard:05d}.bin", np.array(offsets, "<i8").tobytes())

    schema = StructType([StructField("k", kind.dataType)]).add("shard", "integer").add("n", "long").add("crc", "long").add("ids", "binary")
    ids = docs.select(key, "text").mapInArrow(encode, schema)
    ordered = ids.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("k").asc_nulls_first(), "n", "crc")
    rows = C.written(spark, ordered.mapInArrow(write, "h long, bucket int, shard int, row long, n long"), "rows")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> int:
            got = pa.Table.from_batches(held)
            entry = np.zeros(len(got), INDEX_ROW)
            hashes = got["h"].to_numpy().view(np.uint64)
            for name in ("shard", "row", "rows"):
                entry[name] = got[name].to_numpy()
            entry["print"] = prints(hashes)
            put(f"{uri}/index-{held[0].column(0)[0].as_py():05d}.bin", build_index(hashes, entry))
            held.clear()
            return len(got)

        done = 0
        for batch in batches:
            where = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b > a:
                    if held and held[0].column(0)[0].as_py() != where[a]:
                        done += flush()
                    held.append(batch.slice(a, b - a))
        if held:
            done += flush()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    keys = rows.groupBy("bucket", "h").agg(F.min(F.struct("shard", "row")).alias("first"), F.count("*").alias("rows")).select("bucket", "h", "first.shard", "first.row", "rows")
    keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(index, "n long").agg(F.sum("n")).collect()
    totals = {r.shard: (r.n, r.m) for r in rows.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect()}  # one row a shard
    starts = np.concatenate(([0], np.cumsum([totals.get(i, (0, 0))[0] for i in range(shards)]))).tolist()
    C.drop_table(spark, rows)
    meta = {"dtype": encoder(tokenizer).dtype.str, "end_id": end_id, "buckets": buckets, "starts": [int(x) for x in starts], "docs": [totals.get(i, (0, 0))[1] for i in range(shards)]}
    put(f"{uri}/meta.json", json.dumps(meta).encode())
    return meta


def _cuts(keys: DataFrame, shards: int) -> tuple[int, np.ndarray]:
    """Number of rows, and the keys at which shards begin."""
    probs = [i / shards for i in range(1, shards)]
    if isinstance(keys.schema["k"].dataType, StringType):
        n = keys.count()
        share = min(1.0, SAMPLED * shards / max(1, n))
        some = sorted(r.k for r in keys.filter("k is not null").sample(share, seed=1).collect())
        return n, np.array([some[int(q * len(some))] for q in probs] if some else [], object)
    found = keys.agg(F.count("*").alias("n"), (F.percentile_approx("k", probs, max(10_000, 20 * shards)) if probs else F.lit(None)).alias("cuts")).first()
    return found.n, np.array(found.cuts or [], np.int64)


def _shard_of(keys: pa.Array, cuts: np.ndarray, dealt: int) -> np.ndarray:
    """The shard of each key; keys that are cuts more than once are dealt in turn to all shards that they fill."""
    if pa.types.is_integer(keys.type):
        values = keys.fill_null(0).to_numpy(zero_copy_only=False)
    else:
        values = np.array([k or "" for k in keys.to_pylist()], object)
    low, high = (np.searchsorted(cuts, values, side=side) for side in ("left", "right"))
    # a key at one cut begins the shard after it
    low = np.where(high - low > 1, low + 1, high)
    shard = low + (dealt + np.arange(len(values))) % (high - low + 1)
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, shard)


# ---------------------------------------------------------------- read
class Store:
    """Keyed access to a store from one process."""

    def __init__(self, uri: str) -> None:
        self.uri, self.meta, self.buckets = uri, json.loads(get(f"{uri}/meta.json")), {}

    def index(self, bucket: int) -> Index | None:
        if bucket not in self.buckets:
            if len(self.buckets) >= 8:
                self.buckets.clear()
            fs, path = open_fs(f"{self.uri}/index-{bucket:05d}.bin")
            there = fs.get_file_info(path).type == pafs.FileType.File
            self.buckets[bucket] = Index(get(f"{self.uri}/index-{bucket:05d}.bin")) if there else None
        return self.buckets[bucket]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """(found, shard, row, rows) of each key."""
        out = np.zeros(len(hashes), [("found", bool), ("shard", "i8"), ("row", "i8"), ("rows", "i8")])
        where = bucket_of(hashes, self.meta["buckets"])
        for b in C.distinct(where):
            mine, index = np.flatnonzero(where == b), self.index(int(b))
            if index is None:
                continue
            slot = index.find(hashes[mine])
            mine, slot = mine[slot >= 0], slot[slot >= 0]
            out["found"][mine] = True
            for name in ("shard", "row", "rows"):
                out[name][mine] = index.rows[name][slot]
        return out

    def __getitem__(self, key: int | str | None) -> list[np.ndarray]:
        """The id sequences stored under ``key``; none if there is no such key."""
        got = self.find(key_hashes(pa.array([key], pa.int64() if key is None or isinstance(key, int) else pa.string())))[0]
        if not got["found"]:
            return []
        dtype, out = np.dtype(self.meta["dtype"]), []
        for shard, row, rows in self.pieces(*(int(got[x]) for x in ("shard", "row", "rows"))):
            fs, path = open_fs(f"{self.uri}/docs-{shard:05d}.bin")
            with fs.open_input_file(path) as f:
                f.seek(8 * row)
                offsets = np.frombuffer(f.read(8 * (rows + 1)), "<i8")
            fs, path = open_fs(f"{self.uri}/tokens-{shard:05d}.bin")
            with fs.open_input_file(path) as f:
                f.seek(int(offsets[0]) * dtype.itemsize)
                ids = np.frombuffer(f.read(int(offsets[-1] - offsets[0]) * dtype.itemsize), dtype)
            out += [ids[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return out

    def pieces(self, shard: int, row: int, rows: int) -> Iterator[tuple[int, int, int]]:
        """(shard, first row, rows) of a run of rows that may go on over several shards."""
        while rows:
            n = min(rows, self.meta["docs"][shard] - row)
            if n:
                yield shard, row, n
            shard, row, rows = shard + 1, 0, rows - n


def read_back(spark: SparkSession, uri: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every stored document with a key of ``keys``, from the files."""
    meta = json.loads(get(f"{uri}/meta.json"))
    kind = StructField("k", keys.schema[key].dataType)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = key_hashes(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes.view(np.int64)), pa.array(bucket_of(hashes, meta["buckets"]), pa.int32())], ["k", "h", "bucket"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come bucket by bucket and sorted by hash; copies of a key are passed over."""
        store, last = Store(uri), None
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            fresh = np.concatenate(([last is None or hashes[0] != last], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
            last = hashes[-1] if len(hashes) else last
            batch = batch.filter(pa.array(fresh))
            got = store.find(batch.column(1).to_numpy().view(np.uint64))
            hit = np.flatnonzero(got["found"])
            runs = [(i, *piece) for i in hit.tolist() for piece in store.pieces(*(int(got[x][i]) for x in ("shard", "row", "rows")))]
            cols = list(zip(*runs, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["k", "shard", "row", "rows"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, shard, ids, offsets = np.dtype(meta["dtype"]), None, None, np.zeros(1, np.int64)
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for name, s, row, n in zip(names, *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if s != shard:
                    fs, path = open_fs(f"{uri}/tokens-{s:05d}.bin")
                    shard, ids, offsets = s, fs.open_input_file(path), np.frombuffer(get(f"{uri}/docs-{s:05d}.bin"), "<i8")
                for r in range(row, row + n):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    raw = np.frombuffer(ids.read_at((b - a) * dtype.itemsize, a * dtype.itemsize), dtype)
                    out.append((name, meta["starts"][s] + a, b - a, zlib.crc32(raw.astype("<u4").tobytes())))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], [key, "start", "n_tokens", "ids_crc32"])

    dealt = keys.select(F.col(f"`{key}`").alias("k")).mapInArrow(bucketed, StructType([kind]).add("h", "long").add("bucket", "integer"))
    dealt = dealt.repartition(max(1, min(meta["buckets"], 4 * C.partitions(spark))), "bucket").sortWithinPartitions("bucket", "h")
    found = dealt.mapInArrow(locate, StructType([kind]).add("shard", "integer").add("row", "long").add("rows", "long"))
    placed = found.repartitionById(max(1, len(meta["starts"]) - 1), F.col("shard")).sortWithinPartitions("shard", "row")
    out = StructType([StructField(key, kind.dataType)]).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    return placed.mapInArrow(fetch, out)


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and read every document back from it."""
    spark = docs.sparkSession
    uri = C.shared_path(spark, "store")
    write_store(docs, tokenizer, uri, end_id)
    return read_back(spark, uri, docs)
