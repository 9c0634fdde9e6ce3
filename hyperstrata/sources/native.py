"""Native datasets: a text header and one flat binary array, axis 1 fastest.

Reading: the header is parsed on the driver, the array is cut into byte ranges that
tasks read by themselves. Writing: each task writes the bytes of a range of whole
lines; the parts are listed in the header in order (``in=`` may name several).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hyperstrata.functions.header import Axis, Header, parse_parameters
from hyperstrata.operators.grid import Grid

#: Sample types of the binary, little- and big-endian.
FORMATS = {"native_float": "<f4", "xdr_float": ">f4", "native_double": "<f8", "native_int": "<i4", "xdr_int": ">i4", "native_short": "<i2", "native_uchar": "u1", "native_char": "i1", "native_long": "<i8", "native_complex": "<c8"}
BLOCK = 1 << 20  # samples of one task's range


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def read_header(path: str) -> tuple[Header, dict[str, str]]:
    fs, p = _open(path)
    with fs.open_input_stream(p) as f:
        keys = parse_parameters(f.read().decode())
    axes = []
    for k in range(1, 10):
        if f"n{k}" not in keys:
            break
        axes.append(Axis(int(keys[f"n{k}"]), float(keys.get(f"o{k}", 0)), float(keys.get(f"d{k}", 1)), keys.get(f"label{k}", ""), keys.get(f"unit{k}", "")))
    kind = keys.get("data_format", "native_float").partition("_")[2]
    return Header(tuple(axes), kind), keys


def read(spark: SparkSession, path: str) -> Grid:
    header, keys = read_header(path)
    form = keys.get("data_format", "native_float")
    parts = keys["in"].split(",")
    if form.startswith("ascii"):
        return _read_ascii(spark, header, parts[0])
    dtype = np.dtype(FORMATS[form])
    fs, _ = _open(path)
    starts, total = [], 0
    for p in parts:
        file_system, q = _open(p)
        starts.append(total)
        total += file_system.get_file_info(q).size // dtype.itemsize
    ranges = [(p, at, min(BLOCK, end - at), start + at) for p, start, end in zip(parts, starts, [b - a for a, b in zip(starts, [*starts[1:], total])]) for at in range(0, end, BLOCK)]
    is_complex = dtype.kind == "c"
    value = "struct<re: double, im: double>" if is_complex else "double"

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            for p, at, n, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
                file_system, q = _open(p)
                with file_system.open_input_file(q) as f:
                    x = np.frombuffer(f.read_at(n * dtype.itemsize, at * dtype.itemsize), dtype)
                v = pa.StructArray.from_arrays([pa.array(x.real.astype("f8")), pa.array(x.imag.astype("f8"))], names=["re", "im"]) if is_complex else pa.array(x.astype("f8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(line, line + len(x)), "int64"), v], names=["line", "v"])

    tasks = spark.createDataFrame(ranges, "path string, at long, n long, line long").repartition(max(1, len(ranges)))
    df, size = tasks.mapInArrow(load, f"line long, v {value}"), 1
    for k, a in enumerate(header.axes, 1):
        df = df.withColumn(f"i{k}", F.expr(f"(line div {size}) % {a.n}"))
        size *= a.n
    return Grid(df.select(*[f"i{k}" for k in range(1, len(header.axes) + 1)], "v"), header)


def _read_ascii(spark: SparkSession, header: Header, path: str) -> Grid:
    """White-space separated numbers; a text dataset is small, one file is one task."""
    words = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("line", "w"))
    df, size = words.select("line", F.col("w").cast("double").alias("v")), 1
    for k, a in enumerate(header.axes, 1):
        df = df.withColumn(f"i{k}", F.expr(f"cast((line div {size}) % {a.n} as bigint)"))
        size *= a.n
    return Grid(df.select(*[f"i{k}" for k in range(1, len(header.axes) + 1)], "v"), header)


def write(grid: Grid, path: str, data_format: str = "native_float") -> None:
    """Write ``path`` (header) and ``path@/part-*``: ranges of whole lines in order."""
    dtype = np.dtype(FORMATS[data_format])
    line, size, total = F.lit(0).cast("long"), 1, 1
    for k in range(1, grid.dims + 1):
        line = line + F.col(f"i{k}") * size
        size *= grid.axis(k).n
    total = size
    n1 = grid.axis(1).n
    block = max(n1, BLOCK // n1 * n1)
    parts = -(-total // block)
    fs, p = _open(path)
    fs.create_dir(f"{p}@", recursive=True)
    base = f"{path}@"

    def store(key, table):
        import uuid

        import pyarrow as pa

        number = key[0].as_py()
        at = np.asarray(table.column("line")) - number * block
        v = table.column("v")
        x = np.zeros(min(block, total - number * block), dtype)
        if len(np.unique(at)) != len(x):
            raise ValueError("some samples of the grid are missing or given twice")
        if dtype.kind == "c":
            s = v.combine_chunks()
            x[at] = np.asarray(s.field("re")) + 1j * np.asarray(s.field("im"))
        else:
            x[at] = np.asarray(v).astype(dtype)
        file_system, q = _open(base)
        name, part = f"{q}/part-{number:06d}", f"{q}/.{uuid.uuid4().hex}"
        with file_system.open_output_stream(part) as out:
            out.write(x.tobytes())
        file_system.move(part, name)
        return pa.table({"number": pa.array([number], "int64")})

    written = grid.df.select(line.alias("line"), "v").withColumn("_b", F.expr(f"line div {block}")).groupBy("_b").applyInArrow(store, "number long").collect()
    if len(written) != parts:
        raise ValueError("some lines of the grid are missing")
    text = [f"n{k}={a.n} o{k}={a.o} d{k}={a.d} label{k}=\"{a.label}\" unit{k}=\"{a.unit}\"" for k, a in enumerate(grid.header.axes, 1)]
    text += [f"data_format={data_format} esize={dtype.itemsize}", 'in="' + ",".join(f"{base}/part-{k:06d}" for k in range(parts)) + '"']
    with fs.open_output_stream(p) as out:
        out.write("\n".join(text).encode())
