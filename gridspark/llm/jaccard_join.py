"""Exact Jaccard join of shingle sets as a metric-space join (operator 6).

``1 - Jaccard`` is a metric, and sets link when their distance is at most ``eps = 1 - t``.
In this space any two sets without a common shingle are at distance 1, so a handful of
documents as pivots leaves nearly the whole corpus equidistant from all of them in one far
region.  The first level therefore takes the smallest possible sets as pivots, the single
shingles {s}: d(x, {s}) = 1 - 1/|x| if x holds s, else 1, so the cells nearest to x are those
of its own shingles.  The rest is as the method has it:

* **Voronoi regions**: ties between equally near pivots are broken by one global order: rare
  shingles first, by their counts over all documents, then by hash.  A shingle of one document
  alone makes a region of one, so documents that merely share a passage with others (and have
  a quarter of shingles of their own) enter no region at all.
* **Windows**: x is replicated to its first ``|x| - ceil(t|x|) + 1`` cells.  Sets that link
  share one of these, since the shingles that either may miss are fewer; nothing is lost.
* **Recursion**: a region is joined by document pivots.  Its members are compared with the one
  that is in most regions; what links to it is in one component, and a region that holds a
  single component needs no more.  In others the members of all components but the largest
  become pivots themselves.  In small regions they are compared pair by pair; large regions
  that share members are joined in blocks of pivots by blocks of members, and a block gives the
  links that connect its components and not its pairs.
* **Triangle inequality**: with m hash classes of shingles as pivots, the number of shingles
  of x in class j is x's coordinate j, and the sum of the coordinates' differences of two
  sets is at most the size of their symmetric difference.  A pair beyond
  (1-t)/(1+t) * (|x|+|y|) cannot link and is dropped before the sets are fetched.

Equal sets are one node; copies are never expanded into pairs.  Nodes are 64-bit hashes of
whole sets (two different sets meet with probability n^2 / 2^65).

Nulls and edges: a null or empty text has no shingles and links with nothing; rows with equal
ids are judged each by its text; a null id links like any other row but is never the smallest,
and ``component_id`` is null only if all ids of a component are; fewer words than ``n`` make
one shingle; ties of sizes cannot matter; an empty table gives an empty result; extra columns
are ignored (``classes``) or kept (``first_of_each``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegerType, StructField, StructType, VariantType
from pyspark.sql.window import Window

from gridspark.llm import common as C
from gridspark.llm.files import counts_of, open_fs, put

N, PERCENT = 5, 75
#: Most coordinates of the triangle test, shingles counted together in a task, count from which a
#: shingle is hot, members of a region compared pair by pair, sets of a block.
MOST_CLASSES, CHUNK, HOT, SMALL, BLOCK = 8192, 1_000_000, 255, 8, 512


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def set_hash(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(C.mix(np.array([np.bitwise_xor.reduce(C.mix(shingles)) + C.mix(shingles * np.uint64(C.BASES[1])).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))[0])


def coordinates(shingles: np.ndarray) -> bytes:
    """Members per hash class, cut at 255 (which only lowers differences).

    About four shingles share a class, so that unrelated sets of any size differ by more than
    linked ones may; the number of classes is a power of two, so that vectors can be folded.
    """
    m = min(MOST_CLASSES, max(16, 1 << (max(1, len(shingles) // 4) - 1).bit_length()))
    return np.minimum(np.bincount((C.mix(shingles) % np.uint64(m)).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference, from two vectors of coordinates."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    m = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, m).sum(axis=0) - y.reshape(-1, m).sum(axis=0)).sum())


def _marks(docs: DataFrame, bits: int) -> DataFrame:
    """kind 0: (doc_id, row_key, n, node) of each document; kind 1: blobs of shingles and their counts by bucket."""
    schema = StructType([StructField("kind", IntegerType()), docs.schema["doc_id"]]).add("row_key", "long").add("n", "long").add("node", "long").add("bucket", "integer").add("blob", "binary")
    names = ["kind", "doc_id", "row_key", "n", "node", "bucket", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(of: pa.DataType) -> pa.RecordBatch:
            keys, counts = C.distinct_counts(np.concatenate(held))
            rows = [(b, C.pack(keys[at], np.minimum(counts[at], HOT).astype(np.uint8))) for b, at in C.by_bucket(keys, (keys >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)]
            k = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, of), *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

        for batch in (piece for b in batches for piece in C.in_pieces(b)):
            sets = C.shingle_sets(batch.column(2), N)
            nodes = pa.array([np.uint64(set_hash(s)).astype(np.int64) if len(s) else None for s in sets], pa.int64())
            k = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), nodes, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
            held += sets
            size += sum(map(len, sets))
            if size >= CHUNK:
                yield flush(batch.column(0).type)
                held, size = [], 0
        if held:
            yield flush(batch.column(0).type)

    return docs.select("doc_id", C.row_key().alias("row_key"), "text").mapInArrow(run, schema)


def _count_shingles(marks: DataFrame, uri: str) -> None:
    """Write the shingles that occur twice or more as sorted arrays with their counts (cut at ``HOT``)."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [C.unpack(blob) for blob in table["blob"].to_pylist()]
        keys, counts = C.sum_by_key(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int32))
        keys, counts = keys[counts > 1], counts[counts > 1]
        put(f"{uri}/often-{key[0].as_py():05d}.u8", keys.astype("<u8").tobytes())
        put(f"{uri}/often-{key[0].as_py():05d}.n1", np.minimum(counts, HOT).astype(np.uint8).tobytes())
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    marks.filter("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(merge, "n long").collect()  # a number a bucket


def _cells(docs: DataFrame, uri: str, bits: int, buckets: int, percent: int) -> DataFrame:
    """kind 0: (node, n, coordinates); kind 1: blobs (shingle, node) by bucket; kind 2: (node, hot shingle)."""
    names = ["kind", "node", "n", "coords", "bucket", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0

        def flush() -> pa.RecordBatch:
            keys, nodes = np.concatenate(held[0]), np.concatenate(held[1])
            rows = [(b, C.pack(keys[at], nodes[at])) for b, at in C.by_bucket(keys, (C.mix(keys) % np.uint64(buckets)).astype(np.int64), buckets)]
            k = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

        seen: set[int] = set()
        for batch in (piece for b in batches for piece in C.in_pieces(b)):
            mine, hot_nodes, hot_keys = [], [], []
            sets = C.shingle_sets(batch.column(0), N)
            often = counts_of(uri, "often", np.concatenate(sets), bits) if sets else []
            stop = 0
            for s in sets:
                start, stop = stop, stop + len(s)
                if not len(s):
                    continue
                node = set_hash(s)
                if node in seen:  # copies within a task
                    continue
                seen.add(node)
                count = often[start:stop]
                order = np.lexsort((s, count))[: prefix_length(len(s), percent)]
                order, count = s[order], count[order]
                if not count[-1]:  # every cell of its window is its own
                    continue
                rare, hot = order[(count > 0) & (count < HOT)], order[count == HOT]
                mine.append((np.uint64(node).astype(np.int64), len(s), coordinates(s)))
                held[0].append(rare)
                held[1].append(np.full(len(rare), node, np.uint64))
                size += len(rare)
                hot_keys.append(hot)
                hot_nodes.append(np.full(len(hot), node, np.uint64))
            k = len(mine)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array([m[0] for m in mine], pa.int64()), pa.array([m[1] for m in mine], pa.int64()), pa.array([m[2] for m in mine], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
            if hot_keys and (k := sum(map(len, hot_keys))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 2), pa.int32()), pa.array(np.concatenate(hot_nodes).view(np.int64)), pa.array(np.concatenate(hot_keys).view(np.int64)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
            if size >= CHUNK:
                yield flush()
                held, size = ([], []), 0
                seen.clear()
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "kind int, node long, n long, coords binary, bucket int, blob binary")


def _regions(cells: DataFrame) -> DataFrame:
    """(region, node, pivot) of the regions with two members or more; equal regions are one.

    The pivot is the member that is in most regions, so that a group of near copies has few pivots.

    Shingles that aren't hot come as blobs: fewer than ``HOT`` documents hold one, so a bucket
    is bounded.  Hot ones stay rows.
    """

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [C.unpack(b) for b in table["blob"].to_pylist()]
        keys, nodes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
        keys, nodes = keys[fresh], nodes[fresh]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(first, len(keys)))
        group = np.repeat(np.arange(len(first)), sizes)
        with np.errstate(over="ignore"):
            region = C.mix(np.add.reduceat(C.mix(nodes), first) + C.mix(sizes.astype(np.uint64)))
        many = sizes > 1
        many[many] = np.isin(np.flatnonzero(many), np.flatnonzero(many)[np.unique(region[many], return_index=True)[1]])
        use = many[group]
        return pa.table({"region": region[group][use].view(np.int64), "node": nodes[use].view(np.int64)})

    rare = cells.filter("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(merge, "region long, node long")
    hot = cells.filter("kind = 2").select(F.col("n").alias("key"), "node").distinct()
    found = hot.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sig")).filter("m > 1")
    found = found.groupBy("m", "sig").agg(F.min("key").alias("key"))
    hot = hot.join(found.select("key"), "key").select(F.xxhash64("key", F.lit("hot")).alias("region"), "node")
    every = C.written(cells.sparkSession, rare.unionByName(hot).distinct(), "members")
    often = every.groupBy("node").agg(F.count("*").alias("often"))
    pivots = every.join(often, "node").groupBy("region").agg(F.max_by("node", F.struct("often", "node")).alias("pivot"))
    return every.join(pivots, "region")


def _linked(pairs: DataFrame, docs: DataFrame, coords: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link: triangle test on coordinates, then the sets themselves."""
    spark = docs.sparkSession
    sides = [coords.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("coords").alias(f"c{x}")) for x in "ab"]
    near = pairs.join(sides[0], "a").join(sides[1], "b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [apart(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            keep = pa.array((100 + percent) * np.array(least, np.int64) <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    near = C.written(spark, near.select("a", "b", "ca", "cb", "na", "nb").mapInArrow(within, "a long, b long"), "near")
    rows = _sets(near.select(F.col("a").alias("node")).union(near.select("b")), docs, reps)
    both = near.join(rows.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(rows.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    links = C.written(spark, both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"), "links")
    for table in (near, rows):
        C.drop_table(spark, table)
    return links


def _sets(nodes: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes, from one text each; a Bloom filter passes over most other texts."""
    spark = docs.sparkSession
    needed = C.written(spark, nodes.distinct().join(reps, "node"), "needed")
    bits = spark.sparkContext.broadcast(C.bloom(spark, needed.select("row_key")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.array(C.bloom_has(bits.value, batch.column(0).to_numpy()))
            for part in C.in_pieces(batch.filter(some)):
                found = [s for s in C.shingle_sets(part.column(1), N) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([np.uint64(set_hash(s)).astype(np.int64) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    rows = docs.select(C.row_key().alias("row_key"), "text").mapInArrow(sets, "node long, shingles binary")
    rows = C.written(spark, rows.join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    C.drop_table(spark, needed)
    return rows


def _block_links(members: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(member, pivot) numbers of links that connect all linked sets of a block: a forest, not all links."""
    owner = np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])
    values = np.concatenate(pivots)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    sizes = np.array([len(p) for p in pivots])
    up = list(range(len(members) + len(pivots)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, s in enumerate(members):
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = hi - lo
        if not n.any():
            continue
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        same = np.bincount(owner[at], minlength=len(pivots))
        for j in np.flatnonzero(100 * same >= percent * (len(s) + sizes - same)).tolist():
            a, b = root(i), root(len(members) + j)
            if a != b:
                up[a] = b
                out.append((i, j))
    return out


def _joined_in_blocks(large: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked in large regions (region, node, label).

    Regions that share members are one group.  In a group every member outside its largest
    component is a pivot and meets all members, ``BLOCK`` by ``BLOCK``; inside the largest
    component there is nothing left to connect.
    """
    spark = docs.sparkSession
    first = large.groupBy("region").agg(F.min("node").alias("p"))
    group = C.components(spark, large.join(first, "region").select("node", "p"), "node", "p").withColumnRenamed("component", "g")
    members = C.written(spark, large.select("node", "label").distinct().join(group, "node"), "group")
    main = members.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("c"))
    size = main.select("g", "main", F.ceil(F.col("m") / BLOCK).alias("chunks"), F.ceil((F.col("m") - F.col("c")) / BLOCK).alias("blocks")).filter("blocks > 0")
    placed = members.join(size, "g")
    sets = _sets(placed.select("node"), docs, reps)
    placed = placed.join(sets, "node")
    h = F.xxhash64("node")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = placed.select("g", F.pmod(h, "chunks").alias("chunk"), upto("blocks").alias("block"), F.lit(0).alias("pivot"), "node", "shingles")
    pivots = placed.filter("label <> main").select("g", upto("chunks").alias("chunk"), F.pmod(h, "blocks").alias("block"), F.lit(1).alias("pivot"), "node", "shingles")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        kind, node = table["pivot"].to_numpy(), table["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        a, b = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        found = _block_links([sets[i] for i in a], [sets[i] for i in b], percent) if len(a) and len(b) else []
        found = [(int(node[a[i]]), int(node[b[j]])) for i, j in found if node[a[i]] != node[b[j]]]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return C.written(spark, every.unionByName(pivots).groupBy("g", "chunk", "block").applyInArrow(join, "a long, b long"), "block-links")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, row_key, first_key) of every row of ``docs``.

    ``first_key`` is the row key of the component's first row: least id, nulls last, least row key.
    """
    spark = docs.sparkSession
    C.arrow_batches(spark)
    uri = C.shared_path(spark, "shingles")
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    bits = max(4, math.ceil(math.log2(max(1, docs.select("text").rdd.getNumPartitions()))) + 1)
    marks = C.written(spark, _marks(docs, bits), "marks")
    _count_shingles(marks, uri)
    counted, marks = marks, C.written(spark, marks.filter("kind = 0").select("doc_id", "row_key", "n", "node"), "nodes")
    C.drop_table(spark, counted)
    total = marks.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // (4 * CHUNK)))
    cells = C.written(spark, _cells(docs, uri, bits, buckets, percent), "cells")
    coords = cells.filter("kind = 0").select("node", "n", "coords").dropDuplicates(["node"])
    coords = C.written(spark, coords, "coords")
    regions = C.written(spark, _regions(cells), "regions")
    C.drop_table(spark, cells)
    mine = marks.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "node")
    reps = C.written(spark, _reps(docs, regions, mine), "reps")

    def tested(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        return _linked(C.written(spark, ordered, "pairs"), docs, coords, reps, percent)

    links = tested(regions.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    labels = C.components(spark, links, "a", "b")
    known = regions.join(labels, "node", "left").select("region", "node", "pivot", F.coalesce("component", "node").alias("label"))
    several = known.groupBy("region").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("m > 2 and lo <> hi").select("region", "m")
    open_ = C.written(spark, known.join(several, "region"), "open")
    small = open_.filter((F.col("m") <= SMALL) & (F.col("node") != F.col("pivot")))
    other = small.select("region", F.col("node").alias("b"), F.col("label").alias("other"))
    more = tested(small.join(other, "region").filter("label <> other and node < b").select(F.col("node").alias("a"), "b"))
    large = open_.filter(F.col("m") > SMALL)
    links = links.union(more).union(_joined_in_blocks(large, docs, reps, percent))
    labels = C.components(spark, links, "a", "b")
    named = mine.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))["row_key"].alias("first_key"))
    out = named.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "row_key", "first_key")


def _reps(docs: DataFrame, regions: DataFrame, mine: DataFrame) -> DataFrame:
    """(node, row_key): one row of ``docs`` for each node that is in a region."""
    return mine.join(regions.select("node").distinct(), "node").groupBy("node").agg(F.min("row_key").alias("row_key"))


def join_report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another row of their component precedes.

    The smallest id stays, null ids come last, then the least row key counts; of rows with one
    id and one text the one stays whose other columns have the least hash.
    """
    found = classes(docs).groupBy("row_key").agg(F.min(F.col("row_key") == F.col("first_key")).alias("stays"), F.count("*").alias("n"))
    rows = C.written(docs.sparkSession, found.filter("not stays or stays and n > 1"), "later")
    keyed = C.boxed(docs)
    left = keyed.join(rows.select(F.col("row_key").alias("__key")), "__key", "left_anti")
    twice = rows.filter("stays")
    if twice.limit(1).count():
        others = [F.col("__row").getField(f.name) for f in docs.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
        rank = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*others)))
        one = keyed.join(twice.select(F.col("row_key").alias("__key")), "__key", "left_semi").withColumn("__r", rank).filter("__r = 1")
        left = left.unionByName(one.select("__key", "__row"))
    return left.select("__row.*")
