"""Language identification by hyperdimensional profiles (operator 3).

Every letter has a random vector of +1/-1 entries, derived from its code point.  A trigram
is *bound* from its letters: the vectors of the first two are permuted (rotated by two and
by one place) and the three are multiplied entry by entry.  A text *bundles* (adds) the
vectors of its trigrams; a language's prototype bundles the texts of that language; a text
belongs to the prototype with the largest cosine.

Bundling is linear, so training adds trigram counts per language first and binds vectors
once per partition; partial prototypes (languages x dimensions numbers) are merged in a
fixed number of tasks, and only the merged ones reach the driver.  The prototypes are
broadcast: their size is the number of languages x ``dims`` x 4 bytes.

Nulls and edges: a null text or one without a letter is ``und`` with score 0; rows with a
null language never train; letters are the code points of Unicode category L, compared in
lower case; everything between words counts as one space; ties go to the first language in
code-point order; an empty table or one without training rows gives ``und`` throughout;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.llm import common as C

DIMS = 1024
#: Tasks that merge partial prototypes, and trigram vectors a worker remembers (64 MB).
MERGERS, REMEMBERED = 16, 1 << 16
SPACE = np.uint64(32)

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter (categories L*)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vector(code: int, dims: int) -> np.ndarray:
    """The +1/-1 vector of a code point: bits of a generator seeded with it."""
    bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, dims, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


class Binder:
    """Trigram code -> row of a table of bound vectors, bounded by ``REMEMBERED`` rows."""

    def __init__(self, dims: int) -> None:
        self.dims, self.rows, self.table, self.letters = dims, {}, np.zeros((1024, dims), np.int8), {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= 1 << 14:
                self.letters.clear()
            self.letters[code] = letter_vector(code, self.dims)
        return self.letters[code]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(codes) > REMEMBERED:
            self.rows.clear()
        if len(codes) > REMEMBERED:
            return np.concatenate([self.vectors(codes[i : i + REMEMBERED]) for i in range(0, len(codes), REMEMBERED)])
        at = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            row = self.rows.get(code)
            if row is None:
                row = self.rows[code] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
                self.table[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            at[i] = row
        return self.table[at]


_binders: dict[int, Binder] = {}


def binder(dims: int) -> Binder:
    return _binders.setdefault(dims, Binder(dims))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram code, count) of all texts; one trigram holds 3 code points of 21 bits."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in lowered])
    codes = np.where(is_letter()[codes], codes, np.uint32(32)).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    if len(codes) < 3:
        return doc[:0], codes[:0], doc[:0]
    grams = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
    use = (doc[:-2] == doc[2:]) & (codes[1:-1] != SPACE)
    grams, doc = grams[use], doc[:-2][use]
    known, inverse = C.distinct_places(grams)
    pairs, count = C.distinct_counts(doc * len(known) + inverse) if len(known) else (doc, doc)
    return pairs // max(1, len(known)), known[pairs % len(known)] if len(known) else known, count


def prototypes(docs: DataFrame, lang: str, dims: int = DIMS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their unit prototypes, learnt from (text, ``lang``)."""
    C.arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            doc, gram, n = trigrams([t or "" for t in batch.column(1).to_pylist()])
            for name in sorted(set(names)):
                mine = names[doc] == name
                keys, sums = C.sum_by_key(gram[mine], n[mine])
                vector = total.setdefault(name, np.zeros(dims))
                for i in range(0, len(keys), 4096):
                    vector += sums[i : i + 4096] @ binder(dims).vectors(keys[i : i + 4096]).astype(np.float64)
        yield from _emit(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[name] = total.get(name, 0) + np.frombuffer(blob)
        yield from _emit(total)

    schema = "lang string, bundle binary"
    partial = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).alias("lang"), "text").mapInArrow(count, schema)
    rows = partial.repartition(MERGERS).mapInArrow(merge, schema).collect()  # MERGERS rows a language
    total: dict[str, np.ndarray] = {}
    for r in rows:
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.bundle)  # whole numbers: exact in any order
    names = sorted(k for k, v in total.items() if np.any(v))
    found = np.array([total[k] / np.linalg.norm(total[k]) for k in names], np.float32).reshape(len(names), dims)
    return names, found


def _emit(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "bundle"])


def cosines(texts: list[str], proto: np.ndarray, dims: int, block: int = 64) -> np.ndarray:
    """Cosine of each text's bundle with each prototype, 0 without trigrams; ``block`` texts at a time."""
    out = np.zeros((len(texts), len(proto)), np.float32)
    for i in range(0, len(texts), block):
        doc, gram, n = trigrams(texts[i : i + block])
        if not len(gram):
            continue
        known, inverse = C.distinct_places(gram)
        bundle = np.zeros((len(texts[i : i + block]), dims), np.float32)
        for j in range(0, len(known), 8192):
            mine = (inverse >= j) & (inverse < j + 8192)
            counts = np.zeros((len(bundle), min(8192, len(known) - j)), np.float32)
            counts[doc[mine], inverse[mine] - j] = n[mine]
            bundle += counts @ binder(dims).vectors(known[j : j + 8192]).astype(np.float32)
        norm = np.linalg.norm(bundle, axis=1, keepdims=True)
        out[i : i + block] = bundle @ proto.T / np.where(norm > 0, norm, 1)
    return out


def predict(docs: DataFrame, names: list[str], proto: np.ndarray, dims: int = DIMS) -> DataFrame:
    """doc_id, lang_pred and score (cosine, 0 to 1) of every row of ``docs``."""
    C.arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    schema = StructType([docs.schema["doc_id"]]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if len(names):
                near = cosines(texts, vectors, dims)
                best = near.argmax(axis=1)
                codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
                some = [bool(is_letter()[c].any()) for c in codes]
                lang = [names[b] if s else "und" for b, s in zip(best.tolist(), some, strict=True)]
                score = np.where(some, np.clip(near[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(mod: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == remainder


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held-out documents (1 in 4) train nothing."""
    names, proto = prototypes(docs.filter(~held_out(4, 2)), "lang")
    return predict(docs, names, proto).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
