"""Text tables to and from grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid


def read_csv(spark: SparkSession, path: str, columns: int, header: bool = False) -> Grid:
    """A numeric table: axis 1 is the column, axis 2 the row; blank cells are 0 and short rows filled."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    from hyperstrata.operators.rank import global_rank

    numbered = lines.withColumn("_at", F.monotonically_increasing_id())
    ranked = global_rank(numbered, ["_at"], "i2")
    if header:
        ranked = ranked.where("i2 > 0").withColumn("i2", F.col("i2") - 1)
    cells = F.slice(F.concat(F.split("value", ","), F.array_repeat(F.lit(""), columns)), 1, columns)
    df = ranked.select("i2", F.posexplode(cells).alias("i1", "_c")).select(F.col("i1").cast("long").alias("i1"), "i2", F.coalesce(F.expr("try_cast(trim(_c) as double)"), F.lit(0.0)).alias("v"))
    return Grid(df, Header((Axis(columns), Axis())))


def to_rows(grid: Grid) -> DataFrame:
    """index and values of each line, in order: what a print of the data shows."""
    return grid.to_traces()
