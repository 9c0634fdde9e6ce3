"""Dense algebra and spectra as joins and sums: matrices, convolution, correlation, DFT."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid


def matvec(matrix: DataFrame, grid: Grid, rows: int, adjoint: bool = False) -> Grid:
    """Multiply each line of axis 1 by a matrix (row, col, a); the adjoint by its transpose."""
    row, col = ("col", "row") if adjoint else ("row", "col")
    hit = matrix.select(F.col(row).alias("_r"), F.col(col).alias("i1"), "a").join(grid.df, "i1")
    df = hit.groupBy(F.col("_r").alias("i1"), *grid.others(1)).agg(F.sum(F.col("a") * F.col("v")).alias("v"))
    return Grid(df, grid.header.with_axis(1, n=rows))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, col, a of a product of coordinate matrices (row, col, a)."""
    right = b.select(F.col("row").alias("col"), F.col("col").alias("_c"), F.col("a").alias("_b"))
    return a.join(right, "col").groupBy("row", F.col("_c").alias("col")).agg(F.sum(F.col("a") * F.col("_b")).alias("a"))


def complex_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same with complex entries (row, col, re, im)."""
    right = b.select(F.col("row").alias("col"), F.col("col").alias("_c"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    hit = a.join(right, "col").groupBy("row", F.col("_c").alias("_d"))
    return hit.agg(F.sum(F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"), F.sum(F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im")).withColumnRenamed("_d", "col")


def convolve(grid: Grid, taps: list[float], lag: int = 0, adjoint: bool = False) -> Grid:
    """Each line convolved with a short filter, cut to the line: out(i) = sum f(k) in(i - k + lag)."""
    w = grid.along(1)
    total = F.lit(0.0)
    for k, f in enumerate(taps):
        by = k - lag if not adjoint else lag - k
        moved = F.col("v") if by == 0 else (F.lag("v", by).over(w) if by > 0 else F.lead("v", -by).over(w))
        total = total + F.lit(float(f)) * F.coalesce(moved, F.lit(0.0))
    return grid.with_v(total)


def complex_matvec(matrix: DataFrame, grid: Grid, rows: int, adjoint: bool = False) -> Grid:
    """Multiply each complex line of axis 1 by a matrix (row, col, re, im); the adjoint by its conjugate transpose."""
    row, col, sign = ("col", "row", -1.0) if adjoint else ("row", "col", 1.0)
    hit = matrix.select(F.col(row).alias("_r"), F.col(col).alias("i1"), "re", (F.col("im") * sign).alias("im")).join(grid.df, "i1")
    re = F.sum(F.col("re") * F.col("v.re") - F.col("im") * F.col("v.im"))
    im = F.sum(F.col("re") * F.col("v.im") + F.col("im") * F.col("v.re"))
    df = hit.groupBy(F.col("_r").alias("i1"), *grid.others(1)).agg(F.struct(re.alias("re"), im.alias("im")).alias("v"))
    return Grid(df, grid.header.with_axis(1, n=rows))


def matched(data: Grid, other: Grid, taps: int) -> Grid:
    """The adjoint of filtering ``other``: for each tap j, the sum of data(i) other(i - j + taps div 2) along a line."""
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(taps - 1).cast("long")))
    moved = other.df.withColumn("_j", j).select(*other.others(1), "_j", (F.col("i1") + F.col("_j") - F.lit(taps // 2)).alias("i1"), F.col("v").alias("_w"))
    df = moved.join(data.df, data.indices).groupBy(F.col("_j").alias("i1"), *data.others(1)).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return Grid(df, data.header.with_axis(1, n=taps))


def autocorrelation(grid: Grid, lags: int) -> Grid:
    """Sums of products of each line with itself at lags 0 to lags - 1."""
    w = grid.along(1)
    keys = grid.others(1)
    products = [F.sum(F.col("v") * F.coalesce(F.col(f"_l{k}"), F.lit(0.0))).alias(f"_s{k}") for k in range(lags)]
    df = grid.df.withColumns({f"_l{k}": F.col("v") if k == 0 else F.lead("v", k).over(w) for k in range(lags)})
    sums = df.groupBy(*keys).agg(*products)
    df = sums.select(*keys, F.posexplode(F.array(*[F.col(f"_s{k}") for k in range(lags)])).alias("_i", "v"))
    return Grid(df.select(F.col("_i").cast("long").alias("i1"), *keys, "v"), grid.header.with_axis(1, n=lags, o=0.0))


def dft(grid: Grid, frequencies: int) -> DataFrame:
    """i1 (frequency number), other indices, re, im of the first frequencies of each line.

    A definition-level transform, for checks and for a few frequencies of long lines;
    ``traces.fft1`` is the fast one. Each sample makes one term per frequency, which
    is summed before the shuffle.
    """
    n = grid.axis(1).n
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frequencies - 1).cast("long")))
    angle = F.lit(-2 * math.pi / n) * ((F.col("i1") * F.col("_k")) % n)
    terms = grid.df.withColumn("_k", k).withColumn("_a", angle)
    return terms.groupBy(F.col("_k").alias("i1"), *grid.others(1)).agg(F.sum(F.col("v") * F.cos("_a")).alias("re"), F.sum(F.col("v") * F.sin("_a")).alias("im"))


def covariance(grid: Grid) -> DataFrame:
    """row, col, a: products of samples of axis 1 averaged over all other axes (uncentred).

    Lines become arrays; each task adds up the products of its lines in one matrix, so a
    matrix per task is shuffled. Lines must have all samples of the axis.
    """
    n = grid.axis(1).n

    def products(batches):
        import numpy as np
        import pyarrow as pa

        total, lines = np.zeros((n, n)), 0
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), "f8").reshape(-1, n)
            total += x.T @ x
            lines += len(x)
        if lines:
            at = np.arange(n * n)
            yield pa.RecordBatch.from_arrays([pa.array(at // n), pa.array(at % n), pa.array(total.ravel()), pa.array(np.full(n * n, lines))], names=["row", "col", "total", "lines"])

    sums = grid.to_traces().select("trace").mapInArrow(products, "row long, col long, total double, lines long")
    return sums.groupBy("row", "col").agg((F.sum("total") / F.sum("lines")).alias("a"))


def as_matrix(grid: Grid) -> DataFrame:
    return grid.df.select(F.col("i1").alias("row"), F.col("i2").alias("col"), F.col("v").alias("a"))


def from_matrix(df: DataFrame, n1: int, n2: int) -> Grid:
    return Grid(df.select(F.col("row").alias("i1"), F.col("col").alias("i2"), F.col("a").alias("v")), Header((Axis(n1), Axis(n2))))


def relative_error(a: Grid, b: Grid) -> DataFrame:
    """error: the rms of the difference over that of the first; differing headers are refused, a zero first gives null."""
    from hyperstrata.operators.grid import inner

    x, d = F.col("v"), F.col("v") - F.col("w")
    return inner(a, b).agg(F.try_divide(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(x * x))).alias("error"))


def richardson(fine: Grid, coarse: Grid, order: float) -> DataFrame:
    """Indices, v and error of a scheme of an order at two steps, one twice the other: the extrapolated values and the fine ones' errors."""
    from hyperstrata.operators.grid import inner

    error = (F.col("v") - F.col("w")) / F.lit(2.0**order - 1)
    return inner(fine, coarse).select(*fine.indices, (F.col("v") + error).alias("v"), error.alias("error"))
