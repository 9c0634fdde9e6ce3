"""Reshaping: index arithmetic without moving values."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid


def transp(grid: Grid, a: int = 1, b: int = 2) -> Grid:
    axes = list(grid.header.axes)
    axes[a - 1], axes[b - 1] = axes[b - 1], axes[a - 1]
    df = grid.df.withColumnsRenamed({f"i{a}": "_a", f"i{b}": f"i{a}"}).withColumnRenamed("_a", f"i{b}")
    return Grid(df.select(grid.df.columns), Header(tuple(axes), grid.header.kind, grid.header.extra))


def reverse(grid: Grid, axes: list[int], opt: str = "y") -> Grid:
    """Turn axes around; ``y``: the header too, ``i``: leave it, ``n``: only the origin moves."""
    df, header = grid.df, grid.header
    for k in axes:
        df = df.withColumn(f"i{k}", grid.size(k) - 1 - F.col(f"i{k}"))
        a = grid.axis(k)
        if a.n is not None and opt != "i":
            last = a.coordinate(a.n - 1)
            header = header.with_axis(k, o=last, d=-a.d) if opt == "y" else header.with_axis(k, o=last)
    return Grid(df, header)


def rotate(grid: Grid, by: dict[int, int]) -> Grid:
    """Input index i goes to i + rot, around the end."""
    df = grid.df
    for k, rot in by.items():
        df = df.withColumn(f"i{k}", F.pmod(F.col(f"i{k}") + F.lit(rot), grid.size(k)))
    return Grid(df, grid.header)


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def pad(grid: Grid, begin: dict[int, int] | None = None, end: dict[int, int] | None = None, to: dict[int, int] | None = None) -> Grid:
    """Zeros before, after, or up to a length (0: the next power of two); sizes must be known."""
    begin, end, to = begin or {}, end or {}, to or {}
    header, shift = grid.header, {}
    for k in range(1, grid.dims + 1):
        a = grid.axis(k)
        b = begin.get(k, 0)
        n = a.n + b + end.get(k, 0)
        if k in to:
            n = to[k] or next_power_of_two(n)
        shift[k] = b
        header = header.with_axis(k, n=n, o=a.o - b * a.d)
    moved = grid.df.select(*[(F.col(f"i{k}") + b).alias(f"i{k}") for k, b in shift.items()], "v")
    from hyperstrata.operators.grid import index_grid

    df = index_grid(grid.spark, header).join(moved, grid.indices, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return Grid(df, header)


def spray(grid: Grid, axis: int, n: int, o: float = 0.0, d: float = 1.0, label: str = "", unit: str = "") -> Grid:
    """A new axis along which the data repeat; the adjoint of a stack."""
    names = {f"i{k}": f"i{k + 1}" for k in range(axis, grid.dims + 1)}
    df = grid.df
    for old in sorted(names, reverse=True):
        df = df.withColumnRenamed(old, names[old])
    df = df.withColumn(f"i{axis}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    axes = list(grid.header.axes)
    axes.insert(axis - 1, Axis(n, o, d, label, unit))
    out = Header(tuple(axes), grid.header.kind, grid.header.extra)
    return Grid(df.select(*[f"i{k}" for k in range(1, grid.dims + 2)], "v"), out)


def cat(grids: list[Grid], axis: int, space: int = 0) -> Grid:
    """One after another along an axis, with ``space`` zero samples between."""
    first, at, df = grids[0], 0, None
    for g in grids:
        first.header.check_like(g.header, but=axis)
        moved = g.df.select(*g.indices, "v").withColumn(f"i{axis}", F.col(f"i{axis}") + F.lit(at))
        df = moved if df is None else df.unionByName(moved)
        at += g.axis(axis).n + space
    out = Grid(df, first.header.with_axis(axis, n=at - space))
    return pad(out) if space else out


def interleave(grids: list[Grid], axis: int) -> Grid:
    """Sample i of grid k goes to i * number of grids + k."""
    first, df = grids[0], None
    for k, g in enumerate(grids):
        first.header.check_like(g.header)
        moved = g.df.select(*g.indices, "v").withColumn(f"i{axis}", F.col(f"i{axis}") * len(grids) + k)
        df = moved if df is None else df.unionByName(moved)
    a = first.axis(axis)
    return Grid(df, first.header.with_axis(axis, n=None if a.n is None else a.n * len(grids), d=a.d / len(grids)))


def interleave_zeros(grid: Grid, axis: int, jump: int) -> tuple[Grid, Grid]:
    """jump - 1 zero traces after each trace, and the mask of true ones."""
    a = grid.axis(axis)
    wide = Grid(grid.df.withColumn(f"i{axis}", F.col(f"i{axis}") * jump), grid.header.with_axis(axis, n=a.n * jump, d=a.d / jump))
    full = pad(wide)
    return full, full.with_v((F.col(f"i{axis}") % jump == 0).cast("int"))


def reshape(grid: Grid, sizes: list[int]) -> Grid:
    """The same samples in the same order under other sizes."""
    line, stride = F.lit(0).cast("long"), 1
    for k in range(1, grid.dims + 1):
        line = line + F.col(f"i{k}") * stride
        stride *= grid.axis(k).n
    df, size = grid.df.select(line.alias("_l"), "v"), 1
    for k, n in enumerate(sizes, 1):
        df = df.withColumn(f"i{k}", F.expr(f"(_l div {size}) % {n}"))
        size *= n
    if size != stride:
        raise ValueError(f"{stride} samples do not fill {sizes}")
    return Grid(df.select(*[f"i{k}" for k in range(1, len(sizes) + 1)], "v"), Header(tuple(Axis(n) for n in sizes)))
