"""Token ids in binary shards, one zstandard frame per document, one shared dictionary.

A folder of token files holds

* ``dictionary.zdict``: the dictionary, trained on serialized id arrays;
* ``shard-NNNNNN.ztok``: frames of documents in ascending id order, then the
  offset index and a footer;
* ``manifest.json``: the shards in order, with their first and last ids, their
  numbers of documents and ids, the ids before them, and the dictionary's SHA-256.

Shard layout (little-endian): ``MAGIC``; the frames; for each document the arrays
key int64, key-is-null uint8, offset uint64, frame bytes uint32, n_tokens uint64;
footer: n_docs uint64, index offset uint64, crc32 of the index uint32, SHA-256 of
the dictionary (32 bytes), ``MAGIC``. A frame holds the ids as little-endian
uint32 (uint16 shards are written if every id of the vocabulary fits; the flag is
the last byte of ``MAGIC``). A reader that wants one document reads the manifest,
one footer, one index and one frame.

Scale: one range shuffle by document id (then hash of the text, then row, so that a
repeated id can span shards) writes the shards where the rows are, about
``SHARD_CHARS`` characters each; only one row per shard reaches the driver. Shards are
written under another name and moved into place, so tasks may be retried. Reading joins
neighbouring frames to reads of at most ``READ_BYTES``. The dictionary is fitted on a
bounded sample (the ``SAMPLE_DOCS`` documents with the smallest hashes of their ids, of
each a run of ``SAMPLE_BYTES`` characters from a place that the hash picks); every
document is encoded whole.

Cases: null and empty texts hold the end id alone; null ids come first and stay
null; repeated ids stand side by side, ordered by a hash of the text; an empty table gives a
folder without shards, from which no rows are read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.llm.common import batches_of, filesystem, write_whole
from hyperstrata.llm.encoding import encoder

SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 16_384, 65_536
LEVEL = 3
SHARD_CHARS, READ_BYTES = 1 << 28, 8 << 20
MAGIC16, MAGIC32 = b"ZTOK001\x02", b"ZTOK001\x04"
_FOOTER = "<QQI32s8s"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
_INDEX = [("key", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8")]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; with too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _open_dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Write the folder; returns its manifest. ``id_col`` is an integer column."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    seen = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen["chars"] or 0) // SHARD_CHARS))
    draw, unit = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)), 1 << 30
    drawn = docs.where(draw < F.lit(int(min(1.0, 2 * SAMPLE_DOCS / max(1, seen["n"])) * unit)))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES + 1)).cast("int") + 1
    picked = drawn.select(F.substring("text", at, F.lit(SAMPLE_BYTES)).alias("text"), draw.alias("draw")).orderBy("draw", "text").limit(SAMPLE_DOCS)
    vocabulary = len(encoder(tokenizer_path, special=True).tokenizer.get_vocab())
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    dtype, magic = ("<u2", MAGIC16) if width == 2 else ("<u4", MAGIC32)

    def serialized(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path, special=True)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(ids, "<u4").astype(dtype).tobytes()[:SAMPLE_BYTES] for ids in enc.encode_all(t.as_py() for t in batch.column(0))], "binary")], names=["ids"])

    dictionary = train_dictionary([bytes(r["ids"]) for r in picked.select("text").mapInArrow(serialized, "ids binary").collect()])
    digest = hashlib.sha256(dictionary).digest()
    write_whole(fs, f"{path}/dictionary.zdict", lambda out: out.write(dictionary))
    end = np.array([end_id], "<u4").tobytes()

    def write_shard(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        enc, index = encoder(tokenizer_path, special=True), [array(t) for t in "qBQLQ"]
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=_open_dictionary(dictionary))
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, path = filesystem(folder)
        name = f"shard-{number:06d}.ztok"

        def rows():
            yield first
            yield from batches

        def write(out):
            out.write(magic)
            at = len(magic)
            for batch in rows():
                for key, ids in zip(batch.column(0).to_pylist(), enc.encode_all(text.as_py() for text in batch.column(1))):
                    ids += end
                    frame = zip_.compress(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                    out.write(frame)
                    for column, value in zip(index, (key or 0, key is None, at, len(frame), len(ids) // 4)):
                        column.append(value)
                    at += len(frame)
            table = b"".join(np.array(c, t).tobytes() for c, (_, t) in zip(index, _INDEX))
            out.write(table)
            out.write(struct.pack(_FOOTER, len(index[0]), at, zlib.crc32(table), digest, magic))

        write_whole(fs, f"{path}/{name}", write)
        yield pa.RecordBatch.from_pylist([{"number": number, "name": name, "n_docs": len(index[0]), "n_tokens": sum(index[4]), "first": None if index[1][0] else index[0][0], "last": None if index[1][-1] else index[0][-1]}], schema=pa.schema([("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))

    written = (
        docs.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(shards, F.col("key").asc_nulls_first(), "hash", "row")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "hash")
        .select("key", "text")
        .mapInArrow(write_shard, "number int, name string, n_docs long, n_tokens long, first long, last long")
        .collect()  # one row per shard
    )
    before, entries = 0, []
    for row in sorted(written, key=lambda r: r["number"]):
        entries.append(row.asDict() | {"start": before})
        before += row["n_tokens"]
    manifest = {"dictionary_sha256": digest.hex(), "id_bytes": width, "end_id": end_id, "n_tokens": before, "shards": entries}
    write_whole(fs, f"{path}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def read_manifest(folder: str) -> dict:
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


class Shard:
    """An opened shard: its index is in memory, its frames are read when asked for."""

    def __init__(self, folder: str, name: str, dictionary_sha256: str):
        import zstandard

        fs, path = filesystem(folder)
        with fs.open_input_stream(f"{path}/dictionary.zdict") as f:
            dictionary = f.read()
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        n, at, crc, digest, magic = struct.unpack(_FOOTER, self.file.read_at(_FOOTER_BYTES, size - _FOOTER_BYTES))
        if magic not in (MAGIC16, MAGIC32):
            raise ValueError(f"{name} is not a token shard")
        if digest.hex() != dictionary_sha256 or hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name} was written with another dictionary")
        table = self.file.read_at(size - _FOOTER_BYTES - at, at)
        if zlib.crc32(table) != crc:
            raise ValueError(f"the index of {name} is damaged")
        self.index, place = {}, 0
        for column, kind in _INDEX:
            self.index[column] = np.frombuffer(table, kind, n, place)
            place += n * np.dtype(kind).itemsize
        self.dtype = "<u2" if magic == MAGIC16 else "<u4"
        self._unzip = zstandard.ZstdDecompressor(dict_data=_open_dictionary(dictionary))

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document of the shard as little-endian uint32."""
        return self._ids(k, self.file.read_at(int(self.index["size"][k]), int(self.index["offset"][k])))

    def all_ids(self):
        """Ids of all documents in order; neighbouring frames are read together."""
        offsets, sizes = self.index["offset"].astype("i8"), self.index["size"].astype("i8")
        first = 0
        while first < len(offsets):
            last = max(first + 1, int(np.searchsorted(offsets + sizes, offsets[first] + READ_BYTES, "right")))
            data = self.file.read_at(int(offsets[last - 1] + sizes[last - 1] - offsets[first]), int(offsets[first]))
            for k in range(first, last):
                at = offsets[k] - offsets[first]
                yield self._ids(k, data[at : at + sizes[k]])
            first = last

    def _ids(self, k: int, frame: bytes) -> bytes:
        ids = self._unzip.decompress(frame, max_output_size=int(self.index["n_tokens"][k]) * 4)
        return ids if self.dtype == "<u4" else np.frombuffer(ids, self.dtype).astype("<u4").tobytes()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian uint32)."""
    out = "doc_id long, start long, n_tokens long, ids binary"
    shards = len(read_manifest(folder)["shards"])
    if not shards:
        return spark.createDataFrame([], out)

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        manifest = read_manifest(folder)

        def rows():
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    entry = manifest["shards"][number]
                    shard, start = Shard(folder, entry["name"], manifest["dictionary_sha256"]), entry["start"]
                    for k, ids in enumerate(shard.all_ids()):
                        yield (None if shard.index["null"][k] else int(shard.index["key"][k]), start, len(ids) // 4, ids), len(ids)
                        start += len(ids) // 4

        yield from batches_of(rows(), schema)

    return spark.range(0, shards, 1, shards).mapInArrow(read, out)


def read_document(folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document with this id, by the offset index alone."""
    manifest, found = read_manifest(folder), []
    for entry in manifest["shards"]:
        if entry["last"] is None or entry["last"] < doc_id or (entry["first"] is not None and entry["first"] > doc_id):
            continue
        shard = Shard(folder, entry["name"], manifest["dictionary_sha256"])
        for k in np.flatnonzero((shard.index["key"] == doc_id) & (shard.index["null"] == 0)):
            found.append(np.frombuffer(shard.ids(int(k)), "<u4"))
    return found
