"""Grids: long-form DataFrames ``(i1, i2, ..., v)`` with a header, and their column algebra."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header


@dataclass(frozen=True)
class Grid:
    """One regularly sampled array. Indices start at 0; axis 1 is the fastest.

    Coordinates are never stored: they are ``o + i*d`` of the header. Columns
    besides the indices and ``v`` (a gather's key, say) ride along where an
    operator keeps rows, and are dropped where it makes new ones.

    ``arrays`` is a frame of long form and the same samples with a line of axis 1 as an
    array in each row; whoever asks for lines of that very frame need not gather them.
    """

    df: DataFrame
    header: Header
    arrays: tuple[DataFrame, DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def dims(self) -> int:
        return len(self.header.axes)

    @property
    def indices(self) -> list[str]:
        return [f"i{k}" for k in range(1, self.dims + 1)]

    def axis(self, k: int) -> Axis:
        return self.header.axis(k)

    def others(self, *axes: int) -> list[str]:
        return [f"i{k}" for k in range(1, self.dims + 1) if k not in axes]

    def x(self, k: int) -> Column:
        """The coordinate along axis k."""
        a = self.axis(k)
        return F.lit(float(a.o)) + F.col(f"i{k}") * F.lit(float(a.d))

    def along(self, axis: int, *partition: str) -> WindowSpec:
        """The window of a line along an axis, in order."""
        keys = list(partition) or self.others(axis)
        return Window.partitionBy(*keys).orderBy(f"i{axis}") if keys else Window.partitionBy(F.lit(0)).orderBy(f"i{axis}")

    def size(self, axis: int) -> Column:
        """The number of samples along an axis; counted where the header has none."""
        n = self.axis(axis).n
        if n is not None:
            return F.lit(n).cast("long")
        return F.max(f"i{axis}").over(Window.partitionBy(*self.others(axis)) if self.others(axis) else Window.partitionBy(F.lit(0))) + 1

    def with_v(self, v: Column) -> Grid:
        return replace(self, df=self.df.withColumn("v", v))

    def put(self, **keys) -> Grid:
        return replace(self, header=self.header.put(**keys))

    def mean(self) -> float:
        return self.df.agg(F.avg("v")).first()[0]

    def rms(self) -> float:
        return self.df.agg(F.sqrt(F.avg(F.col("v") * F.col("v")))).first()[0]

    def max(self) -> float:
        return self.df.agg(F.max("v")).first()[0]

    def dot(self, other: Grid) -> float:
        return inner(self, other).agg(F.sum(F.col("v") * F.col("w"))).first()[0]

    def __add__(self, other):
        return combine([self, other], "add") if isinstance(other, Grid) else self.with_v(F.col("v") + F.lit(other))

    def __mul__(self, other):
        return combine([self, other], "mul") if isinstance(other, Grid) else self.with_v(F.col("v") * F.lit(other))

    def _has_arrays(self) -> bool:
        return bool(self.arrays) and self.arrays[0] is self.df and {*self.others(1), "trace"} <= set(self.arrays[1].columns)

    def to_traces(self) -> DataFrame:
        """One row per line of axis 1, its samples as an array in order (a line must fit a task)."""
        if self._has_arrays():
            return self.arrays[1].select(*self.others(1), "trace")
        pairs = F.sort_array(F.collect_list(F.struct("i1", "v")))
        return self.df.groupBy(*self.others(1)).agg(F.transform(pairs, lambda s: s["v"]).alias("trace"))

    def dense(self, axis: int = 1) -> DataFrame:
        """One row per line of an axis, ``trace`` its samples by index: null where there is none, the sum where there are several.

        A line must fit a task. Lines that are arrays already come as they are.
        """
        if axis == 1 and self._has_arrays():
            return self.to_traces()
        keys, i, n = self.others(axis), F.col(f"i{axis}"), self.axis(axis).n
        df = self.df.repartition(*keys) if keys else self.df  # serves both groupings
        once = df.groupBy(*keys, i).agg(F.sum("v").alias("v"))
        known = F.sort_array(F.collect_list(F.when((i >= 0) & (i < n), F.struct(i.alias("i"), "v"))))
        lines, s = once.groupBy(*keys).agg(known.alias("_s")), F.col("_s")
        nothing = lambda size: F.array_repeat(F.lit(None).cast("double"), size.cast("int"))
        place = lambda k: F.coalesce(F.get(s, k)["i"], F.lit(n))
        with_gaps = F.concat(nothing(place(F.lit(0))), F.flatten(F.transform(s, lambda x, k: F.concat(F.array(x["v"]), nothing(place(k + 1) - x["i"] - 1)))))
        return lines.select(*keys, F.when(F.size(s) == n, F.transform(s, lambda x: x["v"])).otherwise(with_gaps).alias("trace"))


def every(n: int) -> Column:
    """A row for each index of an axis of n samples."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def sample(trace: Column, place: Column) -> Column:
    """The value of an array at a fractional index, by linear interpolation; null samples count 0 beside others."""
    base, part = F.floor(place).cast("int"), place - F.floor(place)
    low, high = F.get(trace, base) * (F.lit(1.0) - part), F.when(part > 0, F.get(trace, base + 1) * part)
    return F.coalesce(low + high, low, high)


def from_traces(df: DataFrame, header: Header, column: str = "trace") -> Grid:
    """A grid from one row per line of axis 1; lines that are null or empty hold no samples."""
    keys = [f"i{k}" for k in range(2, len(header.axes) + 1)]
    lines = df.select(*keys, F.col(column).alias("trace")).where(F.size("trace") > 0)
    long = lines.select(*keys, F.posexplode("trace").alias("i1", "v")).select(F.col("i1").cast("long").alias("i1"), *keys, "v")
    return Grid(long, header, (long, lines))


def index_grid(spark: SparkSession, header: Header) -> DataFrame:
    """All index tuples of a header, from one range."""
    total = 1
    for a in header.axes:
        total *= a.n
    df, size = spark.range(total), 1
    for k, a in enumerate(header.axes, 1):
        df = df.withColumn(f"i{k}", F.expr(f"(id div {size}) % {a.n}"))
        size *= a.n
    return df.drop("id")


def inner(a: Grid, b: Grid) -> DataFrame:
    """Element k of one with element k of the other: columns v and w."""
    a.header.check_like(b.header)
    return a.df.join(b.df.select(*b.indices, F.col("v").alias("w")), a.indices)


def combine(grids: list[Grid], mode: str, scale: list[float] | None = None, shift: list[float] | None = None) -> Grid:
    """Sum, product or ratio of grids, each first shifted and scaled.

    A ratio is 0 where the divisor is 0.
    """
    first, *rest = grids
    scale, shift = scale or [1.0] * len(grids), shift or [0.0] * len(grids)
    term = lambda k, c: (F.col(c) + F.lit(float(shift[k]))) * F.lit(float(scale[k]))
    df = first.df.withColumn("v", term(0, "v"))
    for k, g in enumerate(rest, 1):
        first.header.check_like(g.header)
        df = df.join(g.df.select(*g.indices, term(k, "v").alias("_w")), first.indices)
        v = {"add": F.col("v") + F.col("_w"), "mul": F.col("v") * F.col("_w"), "div": F.when(F.col("_w") != 0, F.try_divide("v", "_w")).otherwise(0.0)}[mode]
        df = df.withColumn("v", v).drop("_w")
    return replace(first, df=df)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without the setting a local one, in local mode alone."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hyperstrata-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ragged(header_axes: int = 2) -> Header:
    """A header of traces that differ in length."""
    return Header(tuple(Axis() for _ in range(header_axes)))
