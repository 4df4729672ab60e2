"""Driver loops over DataFrames: lineage is cut in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and checkpointed; a lost executor doesn't lose it.

    The folder is ``spark.checkpoint.dir``; only where that is unset (local tests) a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='gridspark-')}"
        sc.setCheckpointDir(root)
    out = df.checkpoint(eager=True)
    tidy(sc)
    return out


#: MB of the driver's heap in use from which its garbage is collected after a round.
GARBAGE_MB = 160


def tidy(sc: SparkContext) -> None:
    """Collect the driver's garbage once there is much of it.

    Every round leaves plans, generated code and metrics behind.  Many short rounds make the heap
    grow to its limit before it is collected; shuffle files, broadcasts and checkpoints of rounds
    that are over stay until then too.
    """
    run = sc._jvm.java.lang.Runtime.getRuntime()
    if run.totalMemory() - run.freeMemory() > GARBAGE_MB << 20:
        sc._jvm.java.lang.System.gc()


#: Nodes whose paths one task follows in memory (a few tens of megabytes); larger graphs take the rounds below, with the same results.
ONE_TASK = 1 << 18


def _in_one_task(state: DataFrame, solve: Callable[[pa.Table], pa.Table], like: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from solve(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return cut(state.coalesce(1).mapInArrow(run, like.schema))


def _targets(table: pa.Table) -> np.ndarray:
    """Row that each row's ``next`` names, -1 without one."""
    ids, after = table["i"].to_numpy(), table["next"].fill_null(0).to_numpy()
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, after, sorter=order), len(ids) - 1)]
    some = table["next"].is_valid().to_numpy(zero_copy_only=False)
    return np.where(some & (ids[at] == after), at, -1)


def _jumped(table: pa.Table, sums: dict) -> pa.Table:
    to = _targets(table)
    end, values = np.arange(len(to)), {c: table[c].to_numpy(zero_copy_only=False) for c in sums}
    for _ in range(40):
        go = np.flatnonzero(to >= 0)
        if not len(go):
            break
        far = to[go]
        new = {c: f(v[go], v[far]) for (c, f), v in zip(sums.items(), values.values(), strict=True)}
        end_go, to_go = end[far], to[far]
        end[go], to[go] = end_go, to_go
        for c, v in new.items():
            values[c] = values[c].copy()
            values[c][go] = v
    ends = pa.array(table["i"].to_numpy()[end], mask=to >= 0)
    return pa.table([table["i"], ends, *(pa.array(values[c], table[c].type, from_pandas=True) for c in sums)], names=["i", "end", *sums])


def _gathered(table: pa.Table) -> pa.Table:
    to = _targets(table)
    total, factor = table["total"].to_numpy().copy(), table["f"].to_numpy().copy()
    for _ in range(40):
        go = np.flatnonzero(to >= 0)
        if not len(go):
            break
        add = np.bincount(to[go], factor[go] * total[go], len(to))
        far_factor, far = factor[to[go]], to[to[go]]
        total += add
        factor[go] *= far_factor
        to[go] = far
    return pa.table({"i": table["i"], "total": pa.array(total)})


def jump(nodes: DataFrame, sums: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Follow ``next`` to its end for all nodes at once: (i, next) gives (i, end, ...).

    Every round doubles the steps taken, so the rounds are the logarithm of the longest path.
    ``sums`` combines a column's value along the path: f(own, value at where next points).
    A node whose path never ends (a cycle) keeps a ``next`` and ends as NULL.
    """
    sums = sums or {}
    state = cut(nodes.select("i", "next", F.col("i").alias("end"), *sums))
    if state.count() <= ONE_TASK:
        return _in_one_task(state, lambda table: _jumped(table, sums), state.drop("next"))
    for _ in range(40):
        if state.filter("next is not null").limit(1).count() == 0:
            break
        far = state.select(F.col("i").alias("next"), F.col("next").alias("after"), F.col("end").alias("far_end"), *(F.col(c).alias(f"far_{c}") for c in sums))
        joined = state.join(far, "next", "left")
        there = F.col("far_end").isNotNull()
        state = cut(
            joined.select(
                "i",
                F.when(there, F.col("after")).alias("next"),
                F.when(there, F.col("far_end")).otherwise(F.col("end")).alias("end"),
                *(F.when(there, f(F.col(c), F.col(f"far_{c}"))).otherwise(F.col(c)).alias(c) for c, f in sums.items()),
            )
        )
    return state.select("i", F.when(F.col("next").isNull(), F.col("end")).alias("end"), *sums)


def circles(nodes: DataFrame) -> DataFrame:
    """(i, ring, steps) of nodes (i, next) that all lie on circles: the least node of each circle, and the steps to the one before it."""
    state = cut(nodes.select("i", "next", F.col("i").alias("low")))
    if state.count() <= ONE_TASK:
        state = _in_one_task(state, _lowest, state)
    else:
        own = state.select("i", "next")
        for _ in range(64):
            far = state.select(F.col("i").alias("next"), F.col("next").alias("after"), F.col("low").alias("far"))
            state = cut(state.join(far, "next").select("i", F.col("after").alias("next"), F.least("low", "far").alias("low"), (F.col("far") < F.col("low")).alias("moved")))
            if state.filter("moved").limit(1).count() == 0:  # twice as far there was nothing lower for anyone
                break
        state = cut(own.join(state.select("i", "low"), "i"))
    links = state.select("i", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"))
    ends = jump(links.withColumn("steps", F.col("next").isNotNull().cast("long")), {"steps": lambda a, b: a + b})
    return ends.select("i", "steps").join(state.select("i", F.col("low").alias("ring")), "i")


def _lowest(table: pa.Table) -> pa.Table:
    to, low = _targets(table), table["i"].to_numpy()
    while not np.array_equal(low, new := np.minimum(low, low[to])):
        low, to = new, to[to]
    return pa.table({"i": table["i"], "next": table["next"], "low": pa.array(low)})


def gather(nodes: DataFrame) -> DataFrame:
    """Sums over everything upstream: (i, next, w, f) gives (i, total).

    ``total(v) = w(v) + sum of f(u) * total(u)`` over the nodes u whose next is v.  A round adds
    what lies twice as far, so the rounds are the logarithm of the longest path; partial sums
    come before every shuffle, so a node with many followers is no hot spot.
    """
    state = cut(nodes.select("i", "next", F.col("w").cast("double").alias("total"), F.col("f").cast("double").alias("f")))
    if state.count() <= ONE_TASK:
        return _in_one_task(state, _gathered, state.select("i", "total"))
    for _ in range(40):
        moving = state.filter("next is not null")
        if moving.limit(1).count() == 0:
            break
        add = moving.groupBy(F.col("next").alias("i")).agg(F.sum(F.col("f") * F.col("total")).alias("add"))
        far = state.select(F.col("i").alias("next"), F.col("next").alias("after"), F.col("f").alias("far_f"))
        state = cut(
            state.join(far, "next", "left")
            .join(add, "i", "left")
            .select("i", F.col("after").alias("next"), (F.col("total") + F.coalesce("add", F.lit(0.0))).alias("total"), (F.col("f") * F.coalesce("far_f", F.lit(1.0))).alias("f"))
        )
    return state.select("i", "total")
