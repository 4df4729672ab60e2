"""Quality rules with thresholds that follow the corpus (operator 1).

Every document gets word statistics.  Per language and source, the ratios of the documents
that pass two fixed base rules go into *mergeable quantile sketches* with relative error: a
sketch is the counts of ratios rounded down to ``DIGITS`` significant bits, so that sketches of
partitions, sources and languages merge by adding counts, a quantile is off by one part in
512 at most whatever its size and whatever the order of merging, and a sketch has at most 512
counts per power of two that occurs.  Documents without the trait (ratio 0) stay outside.

A limit is ``median + SPREAD * (upper quartile - median)`` of the group: nothing but the
group's own distribution says how much is too much, and quartiles stay put while less than a
quarter of a group is bad.  Median and quartile are means of the group's own and its
language's, weighted by the number of its documents and ``PRIOR`` (and the language's of its own
and those of all documents), so that small groups lean on what is known without a switch.
The documents are then joined with their group's limits and filtered.

Nulls and edges: a null or empty text has no words and fails the base rules; null languages
and sources form groups of their own (null equals null); ties cannot matter, repeated rows
are judged alike; an empty table gives an empty result; extra columns are ignored by
``quality_report`` and kept by ``quality_filter``.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridspark.llm import common as C

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_marks long, n_digits long, n_distinct long"
#: Significant bits of a sketch's keys, width of the fence in quartile ranges, documents that the wider group counts for.
DIGITS, SPREAD, PRIOR = 10, 12, 20
#: Rule, and the ratio (in millionths) of which there may be too much.
RULES = (
    ("odd", "word_chars - n_letters - n_digits", "word_chars"),
    ("upper", "n_upper", "n_letters"),
    ("long_words", "word_chars", "n_words"),
    ("short_words", "n_words", "word_chars"),
    ("repeat", "n_repeat_words", "n_words"),
    ("dup_line", "n_dup_lines", "n_lines"),
)


def _ratio(num: str, den: str) -> Column:
    return F.expr(f"(1000000 * ({num})) div greatest({den}, 1)")


def _width(v: str) -> Column:
    """The width of the sketch's bin that holds ``v``."""
    return F.expr(f"shiftleft(1L, greatest(0, length(bin({v})) - {DIGITS}))")


_BYTES = np.arange(256)
#: Bits of a byte: begins a code point that isn't white space, a symbol, a mark, an ASCII letter, a capital, a digit.
CHAR, SYMBOL, MARK, LETTER, CAPITAL, DIGIT = 1, 2, 4, 8, 16, 32
KINDS = ((~C.white(_BYTES.astype(np.uint8)) & ((_BYTES < 0x80) | (_BYTES >= 0xC0))) * CHAR + np.isin(_BYTES, list(b"#*$%&|<>")) * SYMBOL + np.isin(_BYTES, list(b"!?")) * MARK).astype(np.uint8)
KINDS[65:91] += LETTER + CAPITAL
KINDS[97:123] += LETTER
KINDS[48:58] += DIGIT


@functools.cache
def _letters() -> np.ndarray:
    """``LETTER`` and ``CAPITAL`` of every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            kinds[c] = LETTER + CAPITAL if k == "Lu" else LETTER
    return kinds


def byte_kinds(raw: np.ndarray) -> np.ndarray:
    """The bits of every byte; letters beyond ASCII count at their first byte (UTF-8 decoded in numpy)."""
    kinds = np.take(KINDS, raw)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        value = raw[lead].astype(np.uint32)
        extra = (value >= 0xE0).astype(np.uint32) + (value >= 0xF0) + np.uint32(1)
        value &= np.uint32(0x3F) >> extra
        for k in (1, 2, 3):
            more = np.flatnonzero(extra >= k)
            value[more] = value[more] << np.uint32(6) | raw[np.minimum(lead[more] + k, len(raw) - 1)] & np.uint32(0x3F)
        kinds[lead] |= _letters()[np.minimum(value, np.uint32(0x10FFFF))]
    return kinds


def _per_text(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), cuts))


def _repeat_words(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text, its words inside 3-word windows that it has twice or more."""
    n, counts = len(starts) - 1, np.zeros(len(starts) - 1, np.int64)
    if len(flat) < 3:
        return counts
    doc = np.repeat(np.arange(n), np.diff(starts))
    at = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(at):
        return counts
    keys = C.mix(C.window_hashes(flat, 3)[at] + doc[at].astype(np.uint64) * np.uint64(C.BASES[1]))
    every = np.sort(keys)
    twice = C.distinct(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return counts
    some = np.zeros(1 << 16, bool)  # passes over most windows that occur once
    some[twice & np.uint64(0xFFFF)] = True
    again = np.flatnonzero(some[keys & np.uint64(0xFFFF)])
    again = at[again[twice[np.minimum(np.searchsorted(twice, keys[again]), len(twice) - 1)] == keys[again]]]
    hit = np.zeros(len(flat), bool)
    for k in range(3):
        hit[again + k] = True
    np.add.at(counts, doc[hit], 1)
    return counts


def _distinct_words(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Different words of each text, told apart by 40 bits of their hashes."""
    n = len(starts) - 1
    counts = np.zeros(n, np.int64)
    for a in range(0, n, 1 << 24):
        b = min(n, a + (1 << 24))
        doc = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1])).astype(np.uint64)
        seen = C.distinct(doc << np.uint64(40) | flat[starts[a] : starts[b]] >> np.uint64(24))
        counts[a:b] = np.bincount((seen >> np.uint64(40)).astype(np.int64), minlength=b - a)
    return counts


def text_stats(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of ``STATS`` for the whole texts of a batch, a few megabytes of text at a time."""
    parts = [_stats(piece.column("text")) for piece in C.in_pieces(batch)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(STATS.split(", "))


def _stats(column: pa.Array) -> list[np.ndarray]:
    raw, cuts = C.buffer_of(column)
    flat, starts = C.word_hashes(column)
    n_words = np.diff(starts)
    lines, dup = (n_words > 0).astype(np.int64), np.zeros(len(column), np.int64)
    breaks = _per_text(raw == 10, cuts)
    for i in np.flatnonzero(breaks).tolist():
        with_words = [x for x in raw[cuts[i] : cuts[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i], dup[i] = len(with_words), len(with_words) - len(set(with_words))
    kinds = byte_kinds(raw)
    return [
        n_words,
        _per_text(kinds & CHAR, cuts),
        _per_text(kinds & SYMBOL, cuts),
        dup,
        _repeat_words(flat, starts),
        lines,
        _per_text(kinds & CAPITAL, cuts),
        _per_text(kinds & LETTER, cuts),
        _per_text(kinds & MARK, cuts),
        _per_text(kinds & DIGIT, cuts),
        _distinct_words(flat, starts),
    ]


def document_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` (columns of ``docs``) and the word statistics of each whole text."""
    C.arrow_batches(docs.sparkSession)
    names = [x.split()[0] for x in STATS.split(", ")]
    schema = StructType([*(docs.schema[k] for k in keep), *(StructField(n, LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(x, pa.int64()) for x in text_stats(batch))], [*keep, *names])

    text = [] if "text" in keep else ["text"]
    return docs.select(*keep, *text).mapInArrow(run, schema)


def limits(stats: DataFrame) -> DataFrame:
    """(g_lang, g_source, rule, limit) from merged sketches of the documents that pass the base rules.

    One aggregation makes the finest sketches (a row per group, rule and filled bin); wider ones
    are sums of those.
    """
    ratios = F.array(*(F.struct(F.lit(name).alias("rule"), _ratio(a, b).alias("v")) for name, a, b in RULES))
    fine = stats.filter(~F.col("base_failed")).select("lang", "source", F.inline(ratios)).filter("v > 0")
    fine = fine.select("lang", "source", "rule", (F.col("v") - F.col("v") % _width("v")).alias("bin"))
    fine = C.written(stats.sparkSession, fine.groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n")), "sketches")
    own = _quartiles(fine, ["lang", "source", "rule"], "0")
    lang = _quartiles(fine, ["lang", "rule"], "1")
    every = _quartiles(fine, ["rule"], "2")
    # one row per rule, one per language and rule: Spark picks the joins by their measured size
    found = own.join(lang, own.lang0.eqNullSafe(lang.lang1) & (own.rule0 == lang.rule1)).join(every, F.col("rule0") == F.col("rule2"))

    def blend(q: str) -> Column:
        wide = (F.col("total1") * F.col(f"{q}1") + PRIOR * F.col(f"{q}2")) / (F.col("total1") + PRIOR)
        return (F.col("total0") * F.col(f"{q}0") + PRIOR * wide) / (F.col("total0") + PRIOR)

    limit = F.floor(blend("mid") + SPREAD * (blend("high") - blend("mid"))).cast("long")
    return found.select(F.col("lang0").alias("g_lang"), F.col("source0").alias("g_source"), F.col("rule0").alias("rule"), limit.alias("limit"))


def _quartiles(fine: DataFrame, by: list[str], suffix: str) -> DataFrame:
    """``by``, the number of documents, the median and the upper quartile (the upper edge of its bin) of merged sketches."""
    merged = fine.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    found = merged.groupBy(*by).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def quantile(quarters: int) -> Column:
        upto = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")),
            lambda acc, x: F.struct((acc.seen + x.n).alias("seen"), F.when((acc.at < 0) & ((acc.seen + x.n) * 4 >= F.col("total") * quarters), x.bin).otherwise(acc.at).alias("at")),
        )
        return upto["at"]

    found = found.withColumns({"mid": quantile(2), "high": quantile(3)}).withColumn("high", F.col("high") + _width("high"))
    return found.select(*(F.col(c).alias(f"{c}{suffix}") for c in (*by, "total", "mid", "high")))


def judged(docs: DataFrame, keep: list[str], min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """``keep``, the statistics, base_failed, kept and the limit of each rule for each document."""
    spark = docs.sparkSession
    stats = document_stats(docs, list(dict.fromkeys([*keep, "lang", "source"])))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    # the texts stay behind: what is kept for the second look is a few numbers a document
    stats = C.written(spark, stats, "stats") if "text" not in keep else stats
    found = limits(stats)
    wide = found.groupBy("g_lang", "g_source").agg(*(F.max(F.when(F.col("rule") == r[0], F.col("limit"))).alias(f"max_{r[0]}") for r in RULES))
    wide = C.written(spark, wide, "limits")
    within = F.lit(True)
    for name, a, b in RULES:
        within = within & (_ratio(a, b) <= F.coalesce(F.col(f"max_{name}"), F.lit((1 << 63) - 1)))
    # one row per language and source: small, and Spark picks the join by its measured size
    out = stats.join(wide, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")
    return out.withColumn("kept", ~F.col("base_failed") & within)


def quality_report(docs: DataFrame) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(docs, ["doc_id"]).select(*cols, *(f"max_{r[0]}" for r in RULES))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The texts are read twice (once for the sketches, once for the verdict) and never shuffled:
    only the small table of limits moves.
    """
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text", "lang", "source")
    return judged(boxed, ["__row", "text"]).filter("kept").select("__row.*")
