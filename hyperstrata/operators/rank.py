"""Sorting, ranks, order statistics, peaks and histograms' thresholds.

Global ranks and order statistics never put all rows into one task: rows are dealt
to ranges, and the ranges are numbered one after another from their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.operators.grid import Grid, checkpointed


def global_rank(df: DataFrame, order: list[str], name: str, descending: bool = False) -> DataFrame:
    """A column with the place (from 0) of each row in the order of some columns.

    Only the first column is descending, if asked. Rows are dealt to ranges of the whole
    order (so ties in the first column are spread by the others), the dealing is kept by
    a checkpoint, and the ranges are numbered one after another from their counts, of
    which one each reaches the driver.
    """
    keys = [F.desc(c) if descending and j == 0 else F.asc(c) for j, c in enumerate(order)]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(ranges, *keys).withColumn("_part", F.spark_partition_id()))
    before, starts = 0, []
    for r in sorted(dealt.groupBy("_part").count().collect()):
        starts.append((r["_part"], before))
        before += r["count"]
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    start = df.sparkSession.createDataFrame(starts, "_part int, _start long")  # one row per range
    return dealt.withColumn("_local", local).join(F.broadcast(start), "_part").select(*df.columns, (F.col("_local") + F.col("_start")).alias(name))


def kth_smallest(df: DataFrame, column: str, k: int, most: int = 10_000) -> float:
    """The exact k-th smallest (from 0) by narrowing histograms; at most ``most``
    distinct values, or those of one tie, are looked at one by one. Nulls and NaN do
    not count; with no other value the answer is NaN, and a k beyond the last takes
    the greatest."""
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return float("nan")
    while low < high:
        # infinite ends, and ranges too narrow or too wide to be divided, are looked at by value
        width = (high - low) / 1000
        if not 0 < width < float("inf"):
            for s in values.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").count().orderBy("x").toLocalIterator():
                if k < s["count"]:
                    return s["x"]
                k -= s["count"]
            return high
        cell = F.least(F.floor((F.col("x") - low) / width), F.lit(999))
        held = values.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.approx_count_distinct("x").alias("u"))
        for r in held.orderBy("cell").collect():  # at most 1000 rows
            if k < r["n"]:
                low, high = r["a"], r["b"]
                break
            k -= r["n"]
        if r["u"] <= most / 2:
            for s in values.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy("x").count().orderBy("x").collect():
                if k < s["count"]:
                    return s["x"]
                k -= s["count"]
            return high
        if k >= r["n"]:
            return high
    return low


def header_sort(headers: DataFrame, key: str, tie: str) -> DataFrame:
    """New trace numbers ``new`` in the order of a key; ties keep their old order."""
    return global_rank(headers, [key, tie], "new")


def sort_values(df: DataFrame, column: str, tie: str, ascending: bool = False) -> DataFrame:
    """Places by absolute value, the largest first unless ``ascending``."""
    return global_rank(df.withColumn("_abs", F.abs(column)), ["_abs", tie], "place", descending=not ascending).drop("_abs")


def local_maxima(grid: Grid, count: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """The ``count`` largest strict local maxima of each line: rank, place (by a parabola) and value."""
    w = grid.along(1)
    a, b, c = F.lag("v").over(w), F.col("v"), F.lead("v").over(w)
    shift = F.try_divide(F.lit(0.5) * (a - c), a - 2 * b + c)
    df = grid.df.withColumns({"_a": a, "_c": c, "_t": shift, "_x": grid.x(1)})
    df = df.where((F.col("v") > F.col("_a")) & (F.col("v") > F.col("_c")))
    if low is not None:
        df = df.where(F.col("_x") >= low)
    if high is not None:
        df = df.where(F.col("_x") <= high)
    df = df.select(*grid.others(1), (F.col("_x") + F.col("_t") * F.lit(float(grid.axis(1).d))).alias("x"), (F.col("v") - F.lit(0.25) * (F.col("_a") - F.col("_c")) * F.col("_t")).alias("v"))
    rank = F.row_number().over(Window.partitionBy(*grid.others(1)).orderBy(F.desc("v"), "x"))
    return df.withColumn("rank", rank).where(F.col("rank") <= count)


def unique(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values with their places."""
    return global_rank(df.select(F.col(column).alias("v")).distinct(), ["v"], "i1")


def equalise(grid: Grid, levels: int = 256) -> Grid:
    """Histogram equalisation of the values of each slice: int(share at or below * (levels - 1))."""
    keys = grid.others(1, 2)
    counts = grid.df.groupBy(*keys, "v").agg(F.count("*").alias("_n"))
    line = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = F.sum("_n").over(line.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = counts.withColumn("_level", F.floor(below * F.lit(levels - 1) / F.sum("_n").over(line)).cast("int"))
    df = grid.df.join(table.drop("_n"), [*keys, "v"])
    return Grid(df.select(*grid.indices, F.col("_level").alias("v")), grid.header)


def otsu(histogram: DataFrame, o: float, d: float) -> DataFrame:
    """The threshold of a histogram (bin, n) with the largest variance between classes.

    The histogram has a fixed number of bins, so it is one small table.
    """
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    h = histogram.withColumns({"_w": F.sum("n").over(up), "_m": F.sum(F.col("n") * F.col("bin")).over(up), "_all": F.sum("n").over(every), "_moment": F.sum(F.col("n") * F.col("bin")).over(every)})
    w1, w2 = F.col("_w"), F.col("_all") - F.col("_w")
    between = F.coalesce(w1 * w2 * F.pow(F.try_divide(F.col("_m"), w1) - F.try_divide(F.col("_moment") - F.col("_m"), w2), F.lit(2.0)), F.lit(0.0))
    best = h.withColumn("_b", between).orderBy(F.desc("_b"), "bin").limit(1)
    return best.select((F.lit(o) + (F.col("bin") + 0.5) * F.lit(d)).alias("threshold"))


def quantile_rank(n: int, percent: float) -> int:
    """The rank of a percentile clip: int(n * percent / 100 + 0.5), within the data."""
    return min(max(int(n * percent / 100 + 0.5), 0), n - 1)


def order_expr(column: Column, descending: bool = False) -> Column:
    return column.desc() if descending else column.asc()
