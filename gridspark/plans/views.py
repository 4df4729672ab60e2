"""Grids and zones made from relational tables, the same in Spark and in the SQL that checks it.

* ``qty``: supplier x (part mod 64), summed quantities: whole numbers, some cells missing;
* ``emb``: vector x position, a float grid without gaps;
* ``evt``: hour x user, summed values of one event type;
* ``zones``: overlapping rectangles, one per nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import wkb
from gridspark.operators.model import Grid, dense

N_COLS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qty(spark: SparkSession, sf_dir: str) -> Grid:
    lines = table(spark, sf_dir, "lineitem")
    px = lines.groupBy(F.col("l_suppkey").alias("y"), (F.col("l_partkey") % N_COLS).alias("x")).agg(F.sum("l_quantity").cast("long").alias("v"))
    n_rows = lines.agg(F.max("l_suppkey")).first()[0] + 1
    return Grid(dense(px, n_rows, N_COLS), n_rows, N_COLS, dtype="int64", nodata=-1)


def emb(spark: SparkSession, sf_dir: str) -> Grid:
    vectors = table(spark, sf_dir, "embeddings")
    px = vectors.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    n_rows = vectors.agg(F.max("vec_id")).first()[0] + 1
    return Grid(px, n_rows, N_COLS, dtype="float64", nodata=-9999.0)


def evt(spark: SparkSession, sf_dir: str, kind: str) -> Grid:
    """Hours since the start of 2024 down, users (mod 64) across; cents, so that sums are exact."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 3_600_000_000)
    px = events.select(hour.alias("y"), (F.col("user_id") % N_COLS).alias("x"), F.round(F.col("value") * 100).cast("long").alias("c")).groupBy("y", "x").agg(F.sum("c").alias("v"))
    return Grid(dense(px, 24 * 31, N_COLS), 24 * 31, N_COLS, dtype="int64", nodata=-1)


def zones(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """Rectangles over rows 4k .. 4k + 6 (mod the rows) and columns 2k .. 2k + 12 of nation k, by cell corners."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("fid"), F.col("n_name").alias("name"))
    y0 = (F.col("fid") * 4) % F.lit(max(1, grid.n_rows - 6))
    x0 = (F.col("fid") * 2) % 52

    @F.pandas_udf("binary")
    def rectangle(y0, x0):
        import pandas as pd

        return pd.Series([wkb.box(x, -(y + 6), x + 12, -y) for y, x in zip(y0, x0, strict=True)])

    return nations.select("fid", "name", rectangle(y0, x0).alias("geom"))


#: The same views in SQL, as a list of common table expressions.
SQL = """
qcells AS (SELECT l_suppkey AS y, l_partkey % 64 AS x, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
qrows AS (SELECT max(l_suppkey) + 1 AS n FROM lineitem),
qall AS (SELECT i // 64 AS y, i % 64 AS x FROM (SELECT unnest(range(n * 64)) AS i FROM qrows)),
qty AS (SELECT g.y AS y, g.x AS x, c.v AS v FROM qall g LEFT JOIN qcells c ON g.y = c.y AND g.x = c.x),
emb AS (SELECT vec_id AS y, unnest(range(64)) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
zones AS (SELECT CAST(n_nationkey AS BIGINT) AS fid, n_name AS name, (n_nationkey * 4) % greatest(1, (SELECT n FROM qrows) - 6) AS y0, (n_nationkey * 2) % 52 AS x0 FROM nation)
"""
