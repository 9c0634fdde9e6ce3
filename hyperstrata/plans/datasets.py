"""Named datasets: a Parquet table with its header beside it."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from hyperstrata.functions.header import Axis, Header
from hyperstrata.operators.grid import Grid
from hyperstrata.sources.native import _open


def _to_json(h: Header) -> str:
    return json.dumps({"axes": [[a.n, a.o, a.d, a.label, a.unit] for a in h.axes], "kind": h.kind, "extra": h.extra})


def _from_json(text: str) -> Header:
    d = json.loads(text)
    return Header(tuple(Axis(*a) for a in d["axes"]), d["kind"], d["extra"])


def save(grid: Grid, folder: str, mode: str = "error") -> None:
    """Write samples, clustered by the slow axes so that windows of them read little, and the header."""
    slow = grid.indices[-1]
    grid.df.sortWithinPartitions(slow).write.mode(mode).parquet(f"{folder}/samples")
    fs, p = _open(folder)
    with fs.open_output_stream(f"{p}/header.json") as out:
        out.write(_to_json(grid.header).encode())


def load(spark: SparkSession, folder: str) -> Grid:
    fs, p = _open(folder)
    with fs.open_input_stream(f"{p}/header.json") as f:
        return Grid(spark.read.parquet(f"{folder}/samples"), _from_json(f.read().decode()))


def copy(spark: SparkSession, source: str, target: str) -> None:
    save(load(spark, source), target)


def remove(folder: str) -> None:
    fs, p = _open(folder)
    fs.delete_dir(p)


def put(folder: str, **keys) -> Header:
    """Change header keys; the samples stay as they are."""
    fs, p = _open(folder)
    with fs.open_input_stream(f"{p}/header.json") as f:
        header = _from_json(f.read().decode()).put(**keys)
    with fs.open_output_stream(f"{p}/header.json") as out:
        out.write(_to_json(header).encode())
    return header


def describe(grid: Grid) -> str:
    """The axes of a grid, a line each, and its size."""
    lines, total = [], 1
    for k, a in enumerate(grid.header.axes, 1):
        lines.append(f'n{k}={a.n} d{k}={a.d:g} o{k}={a.o:g} label{k}="{a.label}" unit{k}="{a.unit}"')
        total = total * a.n if total is not None and a.n is not None else None
    return "\n".join([*lines, f"{total} elements of type {grid.header.kind}"])
