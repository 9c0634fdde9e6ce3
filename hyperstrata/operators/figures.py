"""The data side of figures: what a plotting tool would draw, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperstrata.operators.grid import Grid


def curve(grid: Grid) -> DataFrame:
    """x, y and the line's indices: each line of axis 1 as a curve over its coordinate."""
    return grid.df.select(grid.x(1).alias("x"), F.col("v").alias("y"), *grid.others(1))


def bars(grid: Grid, width: float = 0.8) -> DataFrame:
    """left, right, bottom and top of a bar for each sample, as wide as a part of the step."""
    half = F.lit(width * abs(float(grid.axis(1).d)) / 2)
    zero = F.lit(0.0)
    return grid.df.select(*grid.indices, (grid.x(1) - half).alias("left"), (grid.x(1) + half).alias("right"), F.least("v", zero).alias("bottom"), F.greatest("v", zero).alias("top"))


def wiggles(grid: Grid, clip: float, room: float = 1.0) -> DataFrame:
    """Traces of axis 1 side by side along axis 2: x, y (axis 1's coordinate) and the filled part of positive samples.

    Samples beyond the clip are drawn at it; a sample at the clip is ``room`` traces wide.
    """
    base = grid.x(2)
    cut = F.greatest(F.least(F.col("v"), F.lit(clip)), F.lit(-clip)) * F.lit(room * float(grid.axis(2).d) / clip)
    return grid.df.select(*grid.indices, (base + cut).alias("x"), grid.x(1).alias("y"), F.greatest(cut, F.lit(0.0)).alias("fill"))


def crossings(grid: Grid, levels: list[float]) -> DataFrame:
    """level, axis, indices and x, y: where contours cross the edges between neighbouring samples of axes 1 and 2.

    A sample on a level counts as above it; each edge is crossed at most once a level.
    """
    level = F.explode(F.array(*[F.lit(float(c)) for c in levels])).alias("level")
    out = None
    for axis in (1, 2):
        edges = grid.df.withColumn("_w", F.lead("v").over(grid.along(axis))).where("_w IS NOT NULL").select("*", level)
        part = (F.col("level") - F.col("v")) / (F.col("_w") - F.col("v"))
        place = {k: grid.x(k) + (part * F.lit(float(grid.axis(k).d)) if k == axis else F.lit(0.0)) for k in (1, 2)}
        found = edges.where((F.col("v") < F.col("level")) != (F.col("_w") < F.col("level")))
        found = found.select("level", F.lit(axis).alias("axis"), *grid.indices, place[1].alias("y"), place[2].alias("x"))
        out = found if out is None else out.unionAll(found)
    return out
