"""Interpolated modified Kneser-Ney bigram model in sorted, memory-mapped arrays (operator 8).

Counting takes two passes over the training texts.  A task counts a chunk of its tokens in
numpy and sends each bucket the sorted keys with their counts as one compressed blob, so that
what is shuffled is a few bytes per distinct n-gram and not a row per token.  A bucket's task
merges its blobs and writes sorted arrays to the shared folder:

* ``words-*.u8 / .n8``    hashes of the vocabulary in ascending order, and their counts;
  a word's id is its rank over all buckets;
* ``pairs-*.u8 / .n8``    ids of neighbouring words packed into one key, and their counts;
* ``total-* / few-* / kinds-*`` per word as context: its count and how many followers it has
  once, twice and more often; per word: in how many contexts it occurs.

Scoring maps these files into memory and looks up the sorted distinct keys of a batch; pages
come in on demand and are shared by the workers of a machine.  Nothing is pruned: the model
has every word and pair of the training texts.

``p(w|h) = (c(hw) - D) / c(h) + g(h) p(w)`` with the discounts D1, D2, D3+ of modified
Kneser-Ney and ``p(w)`` from context counts, interpolated with the uniform distribution over
the vocabulary and one unknown word.  Probabilities of one context thus sum to 1.

Nulls and edges: a null or empty text is the end token alone; a null id hashes as the empty
text; repeated rows count each; without training texts every token has probability 1; where
counts of counts are too few for a discount it is half its count; at most 2**32 - 2 distinct
words; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.llm import common as C
from gridspark.llm.files import arrays, open_fs, put
from gridspark.llm.language_id import held_out


#: Tokens counted together in a task, tokens per bucket of pairs.
CHUNK, PER_BUCKET = 4_000_000, 4_000_000
#: No word has white space in it.
END = np.uint64(C.xxhash.xxh3_64_intdigest(b"</s> "))


def tokens(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end token each, and where each text begins."""
    flat, starts = C.word_hashes(texts, lower=True)
    at = starts + np.arange(len(starts))
    out = np.full(int(at[-1]), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = flat
    return out, at


# ---------------------------------------------------------------- ids
def word_ids(uri: str, hashes: np.ndarray, offsets: np.ndarray, shift: int) -> np.ndarray:
    """Id of each (sorted, distinct) hash; ``offsets[-1] + 1`` for words that weren't learnt."""
    out = np.full(len(hashes), int(offsets[-1]) + 1, np.uint64)
    cuts = np.searchsorted(hashes >> np.uint64(shift), np.arange(len(offsets), dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = hashes[cuts[b] : cuts[b + 1]]
        known = arrays(uri)(f"words-{b:05d}.u8", "<u8")
        if len(known):
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            hit = known[at] == part
            out[cuts[b] : cuts[b + 1]][hit] = (offsets[b] + at[hit]).astype(np.uint64)
    return out


def batch_ids(uri: str, flat: np.ndarray, offsets: np.ndarray, shift: int) -> np.ndarray:
    distinct, inverse = C.distinct_places(flat)
    return word_ids(uri, distinct, offsets, shift)[inverse]


def pair_keys(ids: np.ndarray, starts: np.ndarray, start_id: int) -> np.ndarray:
    """previous id * 2**32 + id for every token; the start id precedes each text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts[:-1]] = start_id
    return before << np.uint64(32) | ids


def pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs of a frequent word are spread over all buckets."""
    return (C.mix(keys) % np.uint64(buckets)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], keys_of, bucket_of, buckets: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = C.distinct_counts(np.concatenate(held))
        rows = [(b, C.pack(keys[at], counts[at].astype(np.uint32))) for b, at in C.by_bucket(keys, bucket_of(keys), buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    for batch in batches:
        if len(batch):
            held.append(keys_of(batch.column(0)))
            size += len(held[-1])
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def merged(blobs: list[bytes]) -> list[np.ndarray]:
    """Keys and summed counts of all blobs, two at a time so that no copy of everything is made twice."""
    parts = [[a if i == 0 else a.astype(np.int64) for i, a in enumerate(C.unpack(b))] for b in blobs]
    while len(parts) > 1:
        parts = [C.sum_by_key(*(np.concatenate(x) for x in zip(*parts[i : i + 8], strict=True))) for i in range(0, len(parts), 8)]
    return parts[0]


# ---------------------------------------------------------------- training
def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    out, y = [], n[0] / (n[0] + 2 * n[1]) if n[0] else 0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0
        out.append(d if 0 < d < k else k / 2)
    return out


def train(docs: DataFrame, uri: str) -> dict:
    """Count the texts of ``docs``, write the arrays below ``uri`` and return what scoring needs besides."""
    spark = docs.sparkSession
    C.arrow_batches(spark)
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    texts = docs.select("text")
    bits = max(4, math.ceil(math.log2(max(1, texts.rdd.getNumPartitions()))))
    shift, wb = 64 - bits, 1 << bits

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, lambda t: tokens(t)[0], lambda k: (k >> np.uint64(shift)).astype(np.int64), wb)

    def store_words(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merged(table["blob"].to_pylist())
        put(f"{uri}/words-{key[0].as_py():05d}.u8", keys.astype("<u8").tobytes())
        put(f"{uri}/words-{key[0].as_py():05d}.n8", counts.astype("<i8").tobytes())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64())})

    blobs = "bucket int, blob binary"
    rows = texts.mapInArrow(words, blobs).groupBy("bucket").applyInArrow(store_words, "bucket int, size long, n long").collect()  # a row a bucket
    sizes = np.zeros(wb, np.int64)
    for r in rows:
        sizes[r.bucket] = r.size
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    n, v = sum(r.n for r in rows), int(offsets[-1])
    if v >= (1 << 32) - 2:
        raise ValueError(f"{v} distinct words; ids have 32 bits")
    pb = max(16, -(-n // PER_BUCKET))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys(t: pa.Array) -> np.ndarray:
            flat, starts = tokens(t)
            return pair_keys(batch_ids(uri, flat, offsets, shift), starts, v)

        return _counted(batches, keys, lambda k: pair_bucket(k, pb), pb)

    def store_pairs(key: tuple, table: pa.Table) -> pa.Table:
        """Writes the pairs and gives partial sums per word: kind 0 as context, 1 as follower, 2 counts of counts."""
        keys, counts = merged(table["blob"].to_pylist())
        put(f"{uri}/pairs-{key[0].as_py():05d}.u8", keys.astype("<u8").tobytes())
        put(f"{uri}/pairs-{key[0].as_py():05d}.n8", counts.astype("<i8").tobytes())
        h, w = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        as_context = C.sum_by_key(h, counts, *((counts == k).astype(np.int64) for k in (1, 2)), (counts > 2).astype(np.int64))
        as_follower = C.sum_by_key(w, np.ones(len(w), np.int64))
        out = []
        for kind, (ids, *cols) in enumerate((as_context, as_follower)):
            where = np.searchsorted(offsets[1:], ids.astype(np.int64), side="right")
            out += [(kind, b, C.pack(ids[at], *(c[at] for c in cols))) for b, at in C.by_bucket(ids, where, wb + 1)]
        seen = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)
        out.append((2, 0, seen.tobytes()))
        return pa.table({"kind": pa.array([o[0] for o in out], pa.int32()), "bucket": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    sums = texts.mapInArrow(pairs, blobs).groupBy("bucket").applyInArrow(store_pairs, "kind int, bucket int, blob binary")
    sums = C.written(spark, sums, "sums")
    seen = sum((np.frombuffer(r.blob, np.int64) for r in sums.filter("kind = 2").select("blob").collect()), np.zeros(4, np.int64))

    def store_sums(key: tuple, table: pa.Table) -> pa.Table:
        b, blobs = key[0].as_py(), {k: [] for k in (0, 1)}
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            blobs[kind].append(blob)
        first, size = (int(offsets[b]), int(sizes[b])) if b < wb else (v, 1)  # the last bucket is the start
        dense = np.zeros((5, size), np.int64)
        for kind, rows in ((0, slice(0, 4)), (1, slice(4, 5))):
            if blobs[kind]:
                ids, *cols = merged(blobs[kind])
                dense[rows, ids.astype(np.int64) - first] = cols
        put(f"{uri}/total-{b:05d}", dense[0].astype("<i8").tobytes())
        put(f"{uri}/few-{b:05d}", dense[1:4].T.astype("<i8").tobytes())
        put(f"{uri}/kinds-{b:05d}", dense[4].astype("<i8").tobytes())
        return pa.table({"seen": pa.array([[int((dense[4] == k).sum()) for k in (1, 2, 3, 4)] + [int((dense[4] > 2).sum()), int(dense[4].sum())]], pa.list_(pa.int64()))})

    rows = sums.filter("kind < 2").groupBy("bucket").applyInArrow(store_sums, "seen array<long>").collect()  # a row a bucket
    kinds = np.array([r.seen for r in rows] or [[0] * 6], np.int64).sum(axis=0).tolist()
    C.drop_table(spark, sums)
    return {"uri": uri, "shift": shift, "offsets": offsets, "n": n, "v": v, "pairs": pb, "d2": discounts(seen.tolist()), "d1": discounts(kinds[:4]), "many": [kinds[0], kinds[1], kinds[4]], "types": int(kinds[5])}


# ---------------------------------------------------------------- scoring
def _gather(model: dict, name: str, dtype: str, ids: np.ndarray, width: int = 1) -> np.ndarray:
    """Rows of a per-word array for sorted ids below ``v + 1``."""
    out = np.zeros((len(ids), width), np.float64)
    offsets = np.append(model["offsets"], model["v"] + 1)
    cuts = np.searchsorted(ids.astype(np.int64), offsets)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        found = arrays(model["uri"])(f"{name}-{b:05d}", dtype)
        if len(found):
            out[cuts[b] : cuts[b + 1]] = found.reshape(-1, width)[ids[cuts[b] : cuts[b + 1]].astype(np.int64) - offsets[b]]
    return out if width > 1 else out[:, 0]


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0, *d])[np.minimum(counts, 3).astype(np.int64)], 0)


def log_probs(model: dict, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts per text; per token: log10 of the model, log10 of the base, whether it is known."""
    flat, starts = tokens(texts)
    ids = batch_ids(model["uri"], flat, model["offsets"], model["shift"])
    v, n = model["v"], model["n"]
    known = ids < v
    distinct, inverse = C.distinct_places(ids)
    inside = distinct[distinct < v]
    counts = np.zeros(len(distinct))
    cuts = np.searchsorted(inside.astype(np.int64), model["offsets"])
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        a, z = cuts[b], cuts[b + 1]
        counts[a:z] = arrays(model["uri"])(f"words-{b:05d}.n8", "<i8")[inside[a:z].astype(np.int64) - model["offsets"][b]]
    base = np.log10((counts + 1) / (n + v + 1))[inverse]
    # words by their contexts
    types, (m1, m2, m3) = model["types"], model["many"]
    spare = (m1 * model["d1"][0] + m2 * model["d1"][1] + m3 * model["d1"][2]) / types if types else 1.0
    one = np.full(len(distinct), spare / (v + 1))
    if types:
        one[: len(inside)] += _discounted(_gather(model, "kinds", "<i8", inside), model["d1"]) / types
    # pairs
    keys = pair_keys(ids, starts, v)
    pair, back = C.distinct_places(keys)
    seen = np.zeros(len(pair))
    for b, at in C.by_bucket(pair, pair_bucket(pair, model["pairs"]), model["pairs"]):
        stored = arrays(model["uri"])(f"pairs-{b:05d}.u8", "<u8")
        if len(stored):
            where = np.minimum(np.searchsorted(stored, pair[at]), len(stored) - 1)
            hit = stored[where] == pair[at]
            seen[at[hit]] = arrays(model["uri"])(f"pairs-{b:05d}.n8", "<i8")[where[hit]]
    context, which = C.distinct_places(pair >> np.uint64(32))
    usable = context <= v
    total, gamma = np.zeros(len(context)), np.ones(len(context))
    total[usable] = _gather(model, "total", "<i8", context[usable])
    few = np.zeros((len(context), 3))
    few[usable] = _gather(model, "few", "<i8", context[usable], 3)
    some = total > 0
    gamma[some] = few[some] @ np.array(model["d2"]) / total[some]
    p = gamma[which] * one[np.searchsorted(distinct, pair & np.uint64(0xFFFFFFFF))]
    p += np.where(total[which] > 0, _discounted(seen, model["d2"]) / np.maximum(total[which], 1), 0)
    return starts, np.log10(p)[back], base, known


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    C.arrow_batches(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"]]).add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            starts, logs, base, known = log_probs(model, batch.column(1))
            sums = [np.add.reduceat(x.astype(t), starts[:-1]) for x, t in ((known, np.int64), (base, np.float64), (logs, np.float64))]
            cols = [np.diff(starts), sums[0], np.full(len(batch), model["n"]), sums[1], sums[2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def lm_report(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out (1 in 7 is)."""
    model = train(docs.filter(~held_out(7, 2)), C.shared_path(docs.sparkSession, "lm"))
    cols = ["doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return score(docs, model).select(*cols, F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
