"""Repeated passages by sparse suffix arrays (operator 2).

A suffix array of a corpus is too large to sort; passages of ``LENGTH`` words or more are
found with a fraction of its suffixes:

1. *Retain*: of every ``SPAN`` neighbouring positions the one whose ``GRAM``-word content
   hashes least is kept, so equal passages keep suffixes at equal places.  Every stretch of
   ``LENGTH`` words has a retained suffix among its first ``SPAN`` positions, hence at least
   ``LENGTH - SPAN + 1`` of its words to the right of it.
2. *Sort and compare*: suffixes are sorted by the hash of those first words (equal prefixes
   are neighbours in any order that respects equality), in buckets by the upper bits of the
   hash.  A suffix whose neighbour agrees is a candidate.  A task sends each suffix content
   once, so that a passage of every document is one row per task and not one per document.
3. *Extend*: around each candidate the match is carried left and right: every stretch of
   ``LENGTH`` words that holds it is hashed, and those that two documents or more share are
   matches.  Overlapping matches of a document are joined to its longest spans.

Steps 2 and 3 leave sorted hash arrays in the shared folder, which the next pass over the
texts maps into memory; no list of documents or links is ever gathered.  Words are compared
with A-Z in lower case, by 64-bit hashes.

Nulls and edges: null, empty and shorter texts repeat nothing; a passage that recurs only
inside one row is not a repeat, two equal rows are; a null id is reported as it is; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from gridspark.llm import common as C
from gridspark.llm.files import member, open_fs, put

LENGTH, SPAN, GRAM = 50, 25, 5
#: Words of a task that are counted together.
CHUNK = 4_000_000


def stretches(flat: np.ndarray, starts: np.ndarray, length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, retained suffix) of every stretch of ``length`` words."""
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.flatnonzero(ends - np.arange(len(flat)) >= length)
    if not len(at):
        return at, at, at
    grams = np.lib.stride_tricks.sliding_window_view(C.window_hashes(flat, GRAM), span)
    least = np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):
        least[i : i + (1 << 16)] = grams[at[i : i + (1 << 16)]].argmin(axis=1)
    return np.searchsorted(starts, at, side="right") - 1, at, at + least


def _once(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys, each once per text."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    return keys[fresh]


def _shared(texts: DataFrame, keys_of, uri: str, name: str, bits: int) -> None:
    """Write the keys that two texts or more have as sorted arrays ``name-*.u8``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = C.distinct_counts(np.concatenate(held))
            rows = [(b, C.pack(keys[at], (counts[at] > 1).astype(np.uint8))) for b, at in C.by_bucket(keys, (keys >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            if len(batch):
                flat, starts = C.word_hashes(batch.column(0), lower=True)
                held.append(_once(*keys_of(flat, starts)))
                size += len(flat)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        parts = [C.unpack(b) for b in table["blob"].to_pylist()]
        keys, several = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) > 0
        order = np.argsort(keys, kind="stable")
        keys, several = keys[order], several[order]
        several[1:] |= keys[1:] == keys[:-1]
        found = C.distinct(keys[several])
        put(f"{uri}/{name}-{key[0].as_py():05d}.u8", found.astype("<u8").tobytes())
        return pa.table({"n": pa.array([len(found)], pa.int64())})

    texts.mapInArrow(count, "bucket int, blob binary").groupBy("bucket").applyInArrow(compare, "n long").collect()  # a number a bucket


def repeated_spans(docs: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, passage): the longest spans made of stretches that another row has too.

    ``passage`` is the class of the span, the least hash of its stretches: equal spans have one class.
    """
    spark = docs.sparkSession
    C.arrow_batches(spark)
    uri = C.shared_path(spark, "suffixes")
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    texts = docs.select("text")
    bits = max(4, math.ceil(math.log2(max(1, texts.rdd.getNumPartitions()))))

    def suffixes(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, _, kept = stretches(flat, starts, length, span)
        fresh = np.ones(len(kept), bool)
        fresh[1:] = kept[1:] != kept[:-1]
        return doc[fresh], C.window_hashes(flat, length - span + 1)[kept[fresh]]

    def extended(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, hash and first word of the stretches around candidate suffixes."""
        doc, at, kept = stretches(flat, starts, length, span)
        near = member(uri, "suffix", C.window_hashes(flat, length - span + 1)[kept], bits) if len(at) else np.zeros(0, bool)
        return doc[near], C.window_hashes(flat, length)[at[near]], at[near]

    _shared(texts, suffixes, uri, "suffix", bits)
    _shared(texts, lambda f, s: extended(f, s)[:2], uri, "match", bits)
    schema = StructType([docs.schema["doc_id"]]).add("start_word", "long").add("end_word", "long").add("n_words", "long").add("passage", "long")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = C.word_hashes(batch.column(1), lower=True)
            doc, keys, at = extended(flat, starts)
            hit = member(uri, "match", keys, bits) if len(keys) else np.zeros(0, bool)
            doc, at, keys = doc[hit], at[hit], keys[hit]
            first = np.ones(len(at), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)
            last = np.append(first[1:], True)[: len(at)]
            own, a, b = doc[first], at[first], at[last] + length
            passage = np.minimum.reduceat(keys, np.flatnonzero(first)) if len(keys) else keys
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(a - starts[own], pa.int64()), pa.array(b - starts[own], pa.int64()), pa.array(b - a, pa.int64()), pa.array(passage.view(np.int64))], ["doc_id", "start_word", "end_word", "n_words", "passage"])

    return docs.select("doc_id", "text").mapInArrow(spans, schema)
