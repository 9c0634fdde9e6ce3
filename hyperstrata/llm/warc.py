"""WARC archives, index first.

Writing: one WARC/1.1 record per row, each its own gzip member. Of records with
equal payloads of at least ``min_bytes`` bytes, the one with the smallest key is a
response; the others are revisits (profile identical-payload-digest) that hold the
HTTP header alone and refer to it. While a shard is written, one index row per
record is kept: key, file, offset, length, URL, digest, type.

Reading: the index is selected first; the wanted byte ranges of a file are sorted
and those at most ``gap`` bytes apart are joined to one read of at most
``most_bytes`` bytes, so a whole file is a few large reads and a few records are a
few small ones.

Scale: payloads are shuffled once, in the join of the pages to the narrow table of
revisits, whose tasks write the shards. The search for equal payloads hashes each once
into a narrow checkpointed table and moves that alone; counts are pre-aggregated, so a
payload that a third of the rows hold is one row per task. The smallest keys are
checkpointed too: both sides of each join are plain exchanges, which adaptive execution
splits where one payload is hot. Files are written under another name and moved into
place, so tasks may be retried. The index is a Parquet table in the same folder.

Cases: a null payload is empty; a null URL gives a record without a target; a null
key is never referred to while a key exists; rows that repeat the
smallest key of a payload are all responses; an empty table gives no records;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.llm.common import batches_of, cut_lineage, filesystem, write_whole

DATE = "1970-01-01T00:00:00Z"  # the tables hold no time of capture
GAP, MOST_BYTES = 64 << 10, 32 << 20
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
INDEX_COLUMNS = ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type"]
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{key} {url}')}>"


def _one_line(url: str) -> str:
    return re.sub(r"[\r\n]+", " ", url)


def record(key, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None) -> bytes:
    """A response (``refers_to`` is None) or a revisit as one gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, url)}", f"WARC-Date: {DATE}"]
    if key is not None:
        head.append(f"WARC-X-Key: {key}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, refers_url)}", f"WARC-X-Refers-To-Key: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The headers, the payload and its declared size of one gzip member."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(member)).read()
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": headers, "payload": payload, "payload_bytes": declared}


def first_of_equal(pages: DataFrame, min_bytes: int) -> DataFrame:
    """key, url, payload, sha1 (hex), and the key and URL a revisit refers to (else null)."""
    hashed = cut_lineage(pages.select("page_id", "url", F.sha1("payload").alias("sha1"), F.length("payload").alias("size")).where(F.col("size") >= min_bytes))
    groups = (
        hashed.groupBy("sha1", "size")
        .agg(F.count("*").alias("_n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("_first"))
        .where("_n > 1")
    )
    first = cut_lineage(groups.select("sha1", "size", F.col("_first.page_id").alias("first_id"), F.col("_first.url").alias("first_url")).where("first_id is not null"))
    revisits = (
        hashed.join(first, ["sha1", "size"])
        .where(~F.col("page_id").eqNullSafe(F.col("first_id")))
        .select(F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.col("sha1").alias("_sha1"), F.col("first_id").alias("refers_to"), F.col("first_url").alias("refers_url"))
        .distinct()
    )
    whole = pages.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("sha1") == F.col("_sha1"))
    return whole.join(revisits, same, "left").select("page_id", "url", "payload", "sha1", "refers_to", "refers_url")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives and ``folder``/index; returns the index. ``id_col`` is an integer column."""
    spark = pages.sparkSession
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))

    def write_shard(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        index = []

        def all_batches():
            yield first
            yield from batches

        def write(out):
            at = 0
            for batch in all_batches():
                for row in zip(*(batch.column(k) for k in range(6))):
                    key, url, payload, sha1, refers_to, refers_url = (x.as_py() for x in row)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = record(key, url, payload, digest, refers_to, refers_url)
                    out.write(member)
                    index.append((key, name, at, len(member), url, digest, "response" if refers_to is None else "revisit"))
                    at += len(member)

        fs, path = filesystem(folder)
        write_whole(fs, f"{path}/{name}", write)
        schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])
        yield from batches_of(((x, 200) for x in index), schema)

    first_of_equal(rows, min_bytes).mapInArrow(write_shard, _INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def ranges(wanted: list[tuple[int, int]], gap: int = GAP, most_bytes: int = MOST_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, records) of joined reads for records (offset, length)."""
    out: list[tuple[int, int, list]] = []
    for offset, length in sorted(wanted):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most_bytes:
            start, end, records = out[-1]
            records.append((offset, length))
            out[-1] = (start, max(end, offset + length), records)
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read_warc(selected: DataFrame, folder: str, gap: int = GAP, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The records that the selected index rows name, read back and parsed.

    Rows: page_id, url, record_type, payload_digest, payload_bytes (of the full
    payload), refers_to, payload (null for revisits). A digest that does not fit
    the payload read is an error.
    """
    out = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        fs, path = filesystem(folder)

        def fetched():
            name, file = None, None
            for batch in batches:
                rows: dict[str, list[tuple[int, int]]] = {}
                for f, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    rows.setdefault(f, []).append((offset, length))
                for f, wanted in rows.items():
                    if f != name:
                        name, file = f, fs.open_input_file(f"{path}/{f}")
                    for start, end, records in ranges(wanted, gap, most_bytes):
                        data = file.read_at(end - start, start)
                        for offset, length in records:
                            yield parse(data[offset - start : offset - start + length])

        def rows():
            for got in fetched():
                h = got["headers"]
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = h["WARC-Type"] == "revisit"
                if not revisit and payload_digest(got["payload"]) != digest:
                    raise ValueError(f"damaged record {h['WARC-Record-ID']}")
                key, to = h.get("WARC-X-Key"), h.get("WARC-X-Refers-To-Key")
                row = (None if key is None else int(key), h.get("WARC-Target-URI"), h["WARC-Type"], digest, got["payload_bytes"], None if to is None else int(to), None if revisit else got["payload"])
                yield row, 300 + len(got["payload"])

        yield from batches_of(rows(), schema)

    plan = selected.select("file", "offset", "length").repartitionByRange(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "offset").sortWithinPartitions("file", "offset")
    return plan.mapInArrow(read, out)
