"""What the corpus operators share: the shared folder, column clashes, files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token characters of the contracts: runs between ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: that of ``spark.checkpoint.dir``.

    Without the setting, a local folder in local mode; on a cluster that is an error,
    since executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hyperstrata-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: for wide rows read twice."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def kept(df: DataFrame, run, schema: str, folder: str) -> DataFrame:
    """What ``run`` makes of a DataFrame's Arrow batches, as a Parquet table of ``schema`` in a shared folder, read back.

    The workers write it, a file for each partition (so a task run again replaces its file) and a row group for each
    batch. Wide rows thus stay out of the executor's JVM, and no process is started: for each local file that Spark
    writes, Hadoop starts two (``chmod``), which until they run count as much memory as the JVM once more.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        made = run(batches)
        first = next(made, None)
        if first is not None:

            def put(out):
                with pq.ParquetWriter(out, first.schema, compression="none", use_dictionary=False, write_statistics=False) as writer:
                    writer.write_batch(first)
                    for batch in made:
                        writer.write_batch(batch)

            fs, root = filesystem(folder)
            write_whole(fs, part_of(root, TaskContext.get().partitionId()), put)
        yield from ()

    df.mapInArrow(releasing(write), "none long").count()
    return df.sparkSession.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(folder)


def row_places(table: DataFrame) -> DataFrame:
    """Where the rows of a table of ``kept`` stand: file and number in it."""
    return table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def reading(run, columns: list[str]):
    """A function on the columns' Arrow batches of one row each, as one on ``row_places`` of a table written in such batches.

    The workers read the rows themselves, one at a time: wide rows stay out of the executor's JVM.
    """

    def read(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for file, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = filesystem(unquote(file))
                with fs.open_input_file(path) as f:
                    (own,) = pq.ParquetFile(f).read_row_group(row, columns).select(columns).to_batches()
                assert len(own) == 1
                yield own

    return releasing(lambda batches: run(read(batches)))


def part_of(folder: str, partition: int) -> str:
    """The file of a partition in a folder of ``kept``."""
    return f"{folder}/part-{partition:05d}.parquet"


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """One column ``row``, a struct of all columns of ``df``, and ``more``: no name can clash."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select(F.struct(*quoted).alias("row"), *[c.alias(name) for name, c in more.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` put into ``row``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def text_keys(id_col: str, text_col: str) -> dict[str, Column]:
    """128 bits of an id and a text: rows that share them are alike to the operators."""
    return {"k1": F.xxhash64(id_col, text_col), "k2": F.xxhash64(F.lit(1), text_col, id_col)}


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder given as a path or a URI."""
    import pyarrow.fs as pafs

    if local := re.match("file:(?://)?(/[^/].*)", uri, re.DOTALL):  # as Hadoop tells paths, without escapes
        return pafs.LocalFileSystem(), local[1]
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def write_whole(fs, path: str, write) -> None:
    """Write a file under another name and move it into place, so that a retried
    or speculative task never leaves half a file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_crc(column: Column) -> Column:
    """crc32 of a key as text; null keys count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


#: bytes.translate table that lower-cases A-Z only; safe on UTF-8.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text: str | None) -> str:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).decode("utf-8", "surrogatepass")


def batches_of(rows, schema, most_bytes: int = 8_000_000, most_rows: int = 5_000):
    """Arrow batches of bounded size from an iterator of (row tuple, bytes it takes)."""
    import pyarrow as pa

    held, taken = [], 0

    def batch():
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row, nbytes in rows:
        held.append(row)
        taken += nbytes
        if taken >= most_bytes or len(held) >= most_rows:
            yield batch()
            held, taken = [], 0
    if held:
        yield batch()


def releasing(run):
    """A function on Arrow batches that gives freed memory back to the system when its task ends.

    Python workers are kept for later tasks and stages; what their allocators hold on to
    would add up on an executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return wrapped


def give_back(spark: SparkSession) -> bool:
    """Have the driver's JVM return memory that it has freed outside its heap to the system; False if it cannot.

    Compiling many plans leaves its allocator with as much as a small heap.
    """
    from py4j.protocol import Py4JError

    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *items):
        out = new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:
        lang = jvm.java.lang
        # the server's own class is closed to py4j; its public interface is not
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", array(lang.Class, *map(lang.Class.forName, names)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JError:  # another JVM, or an older one
        return False
    return True


def give_back_heap(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, after which they return heap beyond what is in use to the system.

    A task for each core, so each executor that is idle gets one.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def keep_rows(df: DataFrame, text_col: str, test) -> DataFrame:
    """The rows whose text passes a test; ``test`` tells an Arrow array of texts at once."""
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(test(batch.column(at)), pa.bool_()))

    return df.mapInArrow(releasing(run), df.schema)
