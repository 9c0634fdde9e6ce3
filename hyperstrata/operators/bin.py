"""Irregular samples to regular grids: groupings by computed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid, index_grid


def histogram(df: DataFrame, v: Column, o: float, d: float, n: int, by: list[str] | None = None) -> DataFrame:
    """bin, n: counts of floor((v - o) / d) in [0, n); empty bins are 0, the rest is dropped."""
    by = by or []
    counts = df.select(*by, F.floor((v - F.lit(o)) / F.lit(d)).cast("long").alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(n).withColumnRenamed("id", "bin")
    frame = bins if not by else df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return frame.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram2(df: DataFrame, x: Column, y: Column, ox: float, dx: float, nx: int, oy: float, dy: float, ny: int) -> Grid:
    """Joint counts on an nx by ny grid."""
    header = Header((Axis(nx, ox, dx), Axis(ny, oy, dy)))
    cells = df.select(F.floor((x - F.lit(ox)) / F.lit(dx)).cast("long").alias("i1"), F.floor((y - F.lit(oy)) / F.lit(dy)).cast("long").alias("i2"))
    return _framed(df.sparkSession, header, cells.groupBy("i1", "i2").agg(F.count("*").alias("v")), 0)


def _framed(spark, header: Header, values: DataFrame, empty) -> Grid:
    keys = [f"i{k}" for k in range(1, len(header.axes) + 1)]
    df = index_grid(spark, header).join(values, keys, "left").withColumn("v", F.coalesce("v", F.lit(empty)))
    return Grid(df.select(*keys, "v"), header)


def nearest(x: Column, axis: Axis) -> Column:
    return F.floor(F.lit(0.5) + (x - F.lit(float(axis.o))) / F.lit(float(axis.d))).cast("long")


def bin1(df: DataFrame, x: Column, v: Column, axis: Axis, how: str = "nearest", clip: float = 0.0) -> Grid:
    """Averages in cells of one axis: by the nearest cell, or each value split over two.

    Cells whose fold is at most ``clip`` are 0.
    """
    values = df.select(((x - F.lit(float(axis.o))) / F.lit(float(axis.d))).alias("_p"), v.cast("double").alias("_v"))
    if how == "nearest":
        shares = values.select(F.floor(F.col("_p") + 0.5).cast("long").alias("i1"), "_v", F.lit(1.0).alias("_w"))
    else:
        base, part = F.floor("_p").cast("long"), F.col("_p") - F.floor("_p")
        shares = values.select("_v", F.inline(F.array(F.struct(base.alias("i1"), (F.lit(1.0) - part).alias("_w")), F.struct((base + 1).alias("i1"), part.alias("_w")))))
    sums = shares.groupBy("i1").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum("_w").alias("_f"))
    means = sums.select("i1", F.when(F.col("_f") > clip, F.try_divide("_s", "_f")).otherwise(0.0).alias("v"))
    return _framed(df.sparkSession, Header((axis,)), means, 0.0)


def bin2(df: DataFrame, x: Column, y: Column, v: Column, ax: Axis, ay: Axis, how: str = "mean", clip: float = 0.0) -> Grid:
    """mean, median or fold of the values in the nearest cells of two axes."""
    cells = df.select(nearest(x, ax).alias("i1"), nearest(y, ay).alias("i2"), v.cast("double").alias("_v"))
    value = {"mean": F.avg("_v"), "median": F.median("_v"), "fold": F.count("*").cast("double")}[how]
    found = cells.groupBy("i1", "i2").agg(value.alias("v"), F.count("*").alias("_n")).where(F.col("_n") > clip).select("i1", "i2", "v")
    return _framed(df.sparkSession, Header((ax, ay)), found, 0.0)


def int_bin(headers: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """One trace per cell of integer keys: the last in ``order``; its payload and the cell's fold."""
    last = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_p_{c}") for c in payload]))
    return headers.groupBy(*keys).agg(last.alias("_l"), F.count("*").alias("fold")).select(*keys, "fold", *[F.col(f"_l._p_{c}").alias(c) for c in payload])


def number_within(headers: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Number the traces of each gather from 0."""
    return headers.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
