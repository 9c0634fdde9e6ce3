"""The test tables as grids, and the same grids as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid, from_traces, ragged

#: A total order of the lines of an order.
LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EPOCH = "2024-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str, where: str | None = None, n2: int | None = None) -> Grid:
    """embeddings: axis 1 the element (64), axis 2 the vector; n2 is counted only if asked for."""
    df = table(spark, sf, "embeddings")
    if where:
        df = df.where(where)
    return from_traces(df.select(F.col("vec_id").alias("i2"), F.col("embedding").cast("array<double>").alias("trace")), Header((Axis(64), Axis(n2))))


def panels(spark: SparkSession, sf: str, width: int, d1: float = 1.0, d2: float = 1.0) -> Grid:
    """embeddings dealt whole to panels of ``width`` vectors: axis 3 the panel; places after the last vector are 0."""
    lines = table(spark, sf, "embeddings").select(F.expr(f"pmod(vec_id, {width})").cast("long").alias("i2"), F.floor(F.col("vec_id") / width).cast("long").alias("i3"), F.col("embedding").cast("array<double>").alias("trace"))
    return from_traces(lines, Header((Axis(64, 0.0, d1), Axis(width, 0.0, d2), Axis())))


def whole(spark: SparkSession, sf: str) -> Grid:
    """All vectors, with the number of them in the header."""
    g = vectors(spark, sf)
    return g.put(n2=(g.df.agg(F.max("i2")).first()[0] or 0) + 1)


def gathers(spark: SparkSession, sf: str) -> Grid:
    """embeddings as gathers: axis 3 is the label, axis 2 the vector."""
    df = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("i3"), F.col("vec_id").alias("i2"), F.posexplode("embedding").alias("i1", "v"))
    return Grid(df.select(F.col("i1").cast("long").alias("i1"), "i2", "i3", F.col("v").cast("double").alias("v")), Header((Axis(64), Axis(), Axis())))


def lines(spark: SparkSession, sf: str, value: str = "l_extendedprice") -> Grid:
    """lineitem: axis 2 the order, axis 1 the place in it."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    df = table(spark, sf, "lineitem").select((F.row_number().over(w) - 1).cast("long").alias("i1"), F.col("l_orderkey").alias("i2"), F.col(value).cast("double").alias("v"))
    return Grid(df, ragged())


def feed(spark: SparkSession, sf: str) -> Grid:
    """events: axis 2 the user, axis 1 the place in time, and x, seconds since the epoch."""
    df = samples(spark, sf)
    w = Window.partitionBy("user_id").orderBy("ts")
    return Grid(df.select((F.row_number().over(w) - 1).cast("long").alias("i1"), F.col("user_id").alias("i2"), F.col("value").alias("v"), "x"), ragged())


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """events with x: seconds since the epoch."""
    df = table(spark, sf, "events")
    return df.withColumn("x", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / F.lit(1e6))


def panels_sql(width: int) -> str:
    """The CTE g of all vectors dealt to panels of ``width``, without the places after the last."""
    return f"g AS (SELECT vec_id % {width} AS i2, vec_id // {width} AS i3, CAST(unnest(range(len(embedding))) AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


VECTORS = "g AS (SELECT vec_id AS i2, CAST(label AS BIGINT) AS i3, CAST(unnest(range(len(embedding))) AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
LINES = f"g AS (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS i1, l_orderkey AS i2, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)"
FEED = f"g AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i1, user_id AS i2, CAST(value AS DOUBLE) AS v, (epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) / 1e6 AS x, event_type FROM events)"
