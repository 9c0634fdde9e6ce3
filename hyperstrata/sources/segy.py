"""SEG-Y: fixed-size traces after a 3600-byte file header, as two tables.

A file of n traces is cut into ranges of traces, each read by one task; reading
``headers`` alone skips the samples. Sample formats: 1 (IBM float), 2 (int32),
3 (int16), 5 (IEEE float), 8 (int8).
"""

from __future__ import annotations

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from hyperstrata.sources.native import _open

# Byte offsets (from 0) and sizes of trace header words of the SEG-Y standard.
WORDS = {"tracl": (0, 4), "tracr": (4, 4), "fldr": (8, 4), "tracf": (12, 4), "ep": (16, 4), "cdp": (20, 4), "cdpt": (24, 4), "trid": (28, 2), "nvs": (30, 2), "nhs": (32, 2), "offset": (36, 4), "gelev": (40, 4), "selev": (44, 4), "scalco": (70, 2), "sx": (72, 4), "sy": (76, 4), "gx": (80, 4), "gy": (84, 4), "counit": (88, 2), "delrt": (108, 2), "muts": (110, 2), "mute": (112, 2), "ns": (114, 2), "dt": (116, 2), "cdpx": (180, 4), "cdpy": (184, 4), "iline": (188, 4), "xline": (192, 4)}
FILE_HEADER, TRACE_HEADER, TRACES = 3600, 240, 4096
_SIZES = {1: 4, 2: 4, 3: 2, 5: 4, 8: 1}


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """Big-endian IBM hexadecimal floats (as uint32) to double."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    power = ((raw >> 24) & 0x7F).astype("i4") - 64
    return sign * (raw & 0xFFFFFF) / float(1 << 24) * np.power(16.0, power)


def float_to_ibm(x: np.ndarray) -> np.ndarray:
    a = np.abs(x.astype("f8"))
    with np.errstate(divide="ignore"):
        power = np.where(a > 0, np.floor(np.log2(np.where(a > 0, a, 1)) / 4) + 1, 0).astype("i8")
    fraction = np.round(a / np.power(16.0, power) * (1 << 24)).astype("i8")
    over = fraction >= 1 << 24
    fraction, power = np.where(over, fraction >> 4, fraction), np.where(over, power + 1, power)
    return np.where(a > 0, (x < 0).astype("i8") << 31 | (power + 64) << 24 | fraction, 0).astype(">u4")


def layout(path: str) -> dict:
    """Samples per trace, sample interval (seconds), format and number of traces."""
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        head, size = f.read_at(FILE_HEADER, 0), f.size()
    word = lambda at: int.from_bytes(head[at : at + 2], "big")
    ns, form = word(3220), word(3224)
    if form not in _SIZES:
        raise ValueError(f"SEG-Y format {form} is not known")
    return {"ns": ns, "dt": word(3216) * 1e-6, "format": form, "traces": (size - FILE_HEADER) // (TRACE_HEADER + ns * _SIZES[form]), "text": head[:3200].decode("cp037")}


def read(spark: SparkSession, path: str, what: str = "both") -> DataFrame:
    """i2 (trace number), the header words, and ``trace`` unless ``what`` is ``head``."""
    info = layout(path)
    ns, form = info["ns"], info["format"]
    step = TRACE_HEADER + ns * _SIZES[form]
    ranges = [(a, min(TRACES, info["traces"] - a)) for a in range(0, info["traces"], TRACES)]
    schema = "i2 long, " + ", ".join(f"{w} int" for w in WORDS) + ("" if what == "head" else ", trace array<double>")
    if not ranges:
        return spark.createDataFrame([], schema)

    def load(batches):
        import pyarrow as pa

        fs, p = _open(path)
        with fs.open_input_file(p) as f:
            for batch in batches:
                for first, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = np.frombuffer(f.read_at(count * step, FILE_HEADER + first * step), "u1").reshape(count, step)
                    columns = [pa.array(np.arange(first, first + count), "int64")]
                    for at, size in WORDS.values():
                        columns.append(pa.array(np.ascontiguousarray(raw[:, at : at + size]).view(f">i{size}").ravel().astype("i4")))
                    names = ["i2", *WORDS]
                    if what != "head":
                        body = np.ascontiguousarray(raw[:, TRACE_HEADER:])
                        kind = {1: ">u4", 2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}[form]
                        x = body.view(kind).reshape(count, ns)
                        x = ibm_to_float(x.astype("u4")) if form == 1 else x.astype("f8")
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, count * ns + 1, ns), "int32"), pa.array(x.ravel())))
                        names.append("trace")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.createDataFrame(ranges, "first long, n long").repartition(len(ranges)).mapInArrow(load, schema)


def write(traces: DataFrame, path: str, dt: float, ns: int, form: int = 5, text: str = "") -> int:
    """Write traces (i2, header words, trace) as one file; the number of traces.

    Tasks write ranges of traces as parts, which are joined in order at the end by
    the driver's file system, block by block.
    """
    from pyspark.sql import functions as F

    fs, p = _open(path)
    fs.create_dir(f"{p}@", recursive=True)
    words = [w for w in WORDS if w in traces.columns]
    base = f"{path}@"

    def store(key, table):
        import uuid

        import pyarrow as pa

        number, order = key[0].as_py(), np.argsort(np.asarray(table.column("i2")), kind="stable")
        out = np.zeros((len(order), TRACE_HEADER + ns * _SIZES[form]), "u1")
        fixed = {"ns": np.full(len(order), ns), "dt": np.full(len(order), round(dt * 1e6))}
        for w in {*words, *fixed}:
            at, size = WORDS[w]
            values = fixed[w] if w in fixed else np.asarray(table.column(w))[order]
            out[:, at : at + size] = values.astype(f">i{size}").reshape(-1, 1).view("u1").reshape(-1, size)
        x = np.array(table.column("trace").to_pylist(), "f8")[order]
        kind = {1: None, 2: ">i4", 3: ">i2", 5: ">f4", 8: "i1"}[form]
        body = float_to_ibm(x) if form == 1 else x.astype(kind)
        out[:, TRACE_HEADER:] = np.ascontiguousarray(body).view("u1").reshape(len(order), -1)
        file_system, q = _open(base)
        part = f"{q}/.{uuid.uuid4().hex}"
        with file_system.open_output_stream(part) as f:
            f.write(out.tobytes())
        file_system.move(part, f"{q}/part-{number:09d}")
        return pa.table({"number": pa.array([number], "int64"), "n": pa.array([len(order)], "int64")})

    done = traces.withColumn("_b", F.expr(f"i2 div {TRACES}")).groupBy("_b").applyInArrow(store, "number long, n long").collect()
    head = bytearray(text.ljust(3200)[:3200].encode("cp037") + bytes(400))
    for at, value in ((3216, round(dt * 1e6)), (3220, ns), (3224, form)):
        head[at : at + 2] = int(value).to_bytes(2, "big")
    with fs.open_output_stream(p) as out:
        out.write(bytes(head))
        for row in sorted(done):
            with fs.open_input_stream(f"{p}@/part-{row['number']:09d}") as f:
                while data := f.read(1 << 24):
                    out.write(data)
    fs.delete_dir(f"{p}@")
    return sum(r["n"] for r in done)


__all__ = ["WORDS", "layout", "read", "write", "pafs"]
