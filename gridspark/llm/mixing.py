"""Mixing sources to target weights by subset-sum budget fitting (operator 9).

Every source gets a budget of words (``targets``).  Whole copies of the source come first
(budget // size of the source); what remains is a subset-sum over the source's documents:

1. documents are counted by exact length, so a source is a short histogram;
2. of each length the same share is set aside by rounding down, which leaves a remaining
   budget far below the source;
3. longest lengths first fill that down to a window of ``CAPACITY`` words;
4. a bounded-knapsack dynamic programme over the counts that are left (multiplicities split
   in powers of two, reachable sums as the bits of one integer) fits the window exactly
   where it can, else as close below as it can;
5. of each length the quota's documents are those of least seeded hash.

Only step 4 runs per source on its histogram, whose rows are distinct lengths and not
documents.  Step 5 never sorts a whole (source, length) group: hashes are cut in slices of
about ``SLICE`` documents, slices below the quota are taken whole, and only the slice on the
edge is ranked.  A source or length with a third of all rows is thus spread out.

Nulls and edges: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own, last in order; repeated rows count each; ties of the hash are broken by
doc_id; an empty table gives an empty result; extra columns are ignored (``mix_report``) or
kept (``mix``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from gridspark.llm import common as C

#: Words that the dynamic programme fits at most (bits of its integers).
CAPACITY = 1 << 16
SLICE = 512


def targets(sizes: list[int], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Budget of each source, in order; what exceeds ``most`` x its size is shared out again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near ``budget`` from below as found."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total if total else 0 for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest > CAPACITY and lengths[i]:
            more = min(counts[i] - take[i], (rest - CAPACITY) // lengths[i])
            take[i] += more
            rest -= more * lengths[i]
    # step 4: every item is (length index, multiplicity); before[k] holds the sums reachable without items k, k+1, ...
    goal = min(rest, CAPACITY)
    mask, reach, before, items = (1 << (goal + 1)) - 1, 1, [], []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        n, left, k = lengths[i], counts[i] - take[i], 1
        if not n or n > goal:
            continue
        left = min(left, goal // n)
        while left > 0 and not reach >> goal & 1:
            k = min(k, left)
            before.append(reach)
            items.append((i, k))
            reach |= reach << (n * k) & mask
            left -= k
            k *= 2
    at = reach.bit_length() - 1
    for (i, k), had in zip(reversed(items), reversed(before), strict=True):
        if not had >> at & 1:
            at -= lengths[i] * k
            take[i] += k
    return take


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    C.arrow_batches(docs.sparkSession)
    schema = StructType([*(docs.schema[k] for k in keep), StructField("size", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, cuts = C.buffer_of(batch.column("text"))
            sizes = pa.array(np.diff(np.searchsorted(C.word_spans(raw, cuts)[0], cuts)), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), sizes], [*keep, "size"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row per row of ``docs``."""
    spark = docs.sparkSession
    sized = C.written(spark, _sized(docs.select("doc_id", "source", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), "text"), ["doc_id", "source", "h"]), "sizes")
    histogram = C.written(spark, sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    # one row per source: its name and size, in order of code points with null last
    per = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()
    per = sorted(per, key=lambda r: (r.source is None, r.source or ""))
    budgets = spark.createDataFrame(
        [(r.source, int(r.s), float(t), i) for i, (r, t) in enumerate(zip(per, targets([r.s for r in per], weights, share, most), strict=True))],
        "source string, source_size long, target double, rank int",
    )

    def quotas(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = int(target // size) if size else 0
        lengths, counts = rows["size"].astype(int).tolist(), rows["n"].astype(int).tolist()
        extra = fit(lengths, counts, int(round(target - whole * size))) if size else [0] * len(rows)
        return pd.DataFrame({"rank": rows["rank"], "size": rows["size"], "whole": whole, "quota": extra, "n": rows["n"]})

    ranked = histogram.join(budgets, histogram.source.eqNullSafe(budgets.source)).select("rank", "size", "n", "source_size", "target")
    quota = ranked.groupBy("rank").applyInPandas(quotas, "rank int, size long, whole int, quota long, n long")
    quota = C.written(spark, quota.join(budgets, "rank"), "quotas").withColumn("slices", F.ceil(F.col("n") / SLICE)).withColumnsRenamed({"size": "q_size", "source": "q_source"})
    rows = sized.join(quota, sized.source.eqNullSafe(quota.q_source) & (sized["size"] == quota.q_size))
    # the upper half of the hash gives the slice, so that slices have an order
    position = F.shiftrightunsigned("h", 32)
    rows = rows.withColumn("slice", F.floor(position * F.col("slices") / F.lit(1 << 32)).cast("long"))
    rows = C.written(spark, rows.select("doc_id", "source", "size", "h", "rank", "source_size", "target", "whole", "quota", "slice", "n"), "slices")
    part = rows.filter((F.col("quota") > 0) & (F.col("quota") < F.col("n")))
    filled = part.groupBy("rank", "size", "slice").agg(F.count("*").alias("m"), F.first("quota").alias("quota"))
    upto = Window.partitionBy("rank", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select("rank", "size", "slice", "m", (F.col("quota") - F.coalesce(F.sum("m").over(upto), F.lit(0))).alias("open"))
    edge = filled.filter((F.col("open") > 0) & (F.col("open") < F.col("m"))).drop("m")
    ranks = Window.partitionBy("rank", "size", "slice").orderBy("h", "doc_id")
    full = filled.filter(F.col("open") >= F.col("m")).select("rank", "size", "slice")
    cols = ["doc_id", "source", "size", "source_size", "target"]
    chosen = part.join(full, ["rank", "size", "slice"], "left_semi").select(*cols, (F.col("whole") + 1).alias("copies"))
    missed = part.join(filled.filter(F.col("open") <= 0).select("rank", "size", "slice"), ["rank", "size", "slice"], "left_semi").select(*cols, F.col("whole").alias("copies"))
    on_edge = part.join(edge, ["rank", "size", "slice"]).withColumn("r", F.row_number().over(ranks)).select(*cols, (F.col("whole") + (F.col("r") <= F.col("open")).cast("int")).alias("copies"))
    even = rows.filter((F.col("quota") == 0) | (F.col("quota") == F.col("n"))).select(*cols, (F.col("whole") + (F.col("quota") > 0).cast("int")).alias("copies"))
    return even.unionByName(chosen).unionByName(missed).unionByName(on_edge)


def mix_report(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Rows are told apart by a key over all columns; equal rows share one quota, which is dealt
    to them together and kept as the sum of their copies.
    """
    spark = docs.sparkSession
    cols = [F.col(f"`{c}`") for c in docs.columns]
    key = F.concat(F.hex(F.xxhash64(*cols)), F.hex(F.xxhash64(F.lit(1), *cols)))
    row = docs.select(F.struct(*cols).alias("__row"), key.alias("__key"), "source", "text")
    chosen = plan(row.select(F.col("__key").alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("m"))
    chosen = C.written(spark, chosen.filter("copies > 0"), "copies")
    row = row.select("__row", "__key")
    single = row.join(chosen.filter("m = 1"), "__key")
    many = row.join(chosen.filter("m > 1"), "__key").dropDuplicates(["__key"])
    return single.unionByName(many).select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("__row.*")
