"""Best-fit packing of token sequences, planned on a histogram of lengths.

Documents are encoded where they lie; a document longer than a sequence is cut
into full pieces with the shorter piece first. Only the number of pieces of
each length (at most ``max_len`` numbers) reaches the driver. There, best-fit
decreasing runs over counts, not pieces: equal lengths are placed run by run,
so the plan is a short list of "the next c pieces of length L go to sequences
s, s+1, ... at offset o". Pieces take their planned slots by a join on their
rank within their length.

Scale: texts are never shuffled. The narrow piece table is checkpointed once.
Ranks are counted within (length, salt) groups plus offsets, so a length that
holds a third of all rows is spread over many groups: ``SALTS``, or one for each
``SALTED`` pieces if these are more. The plan is joined by (length, rank // CHUNK),
so no join key has over ``CHUNK`` pieces.

Cases: null and empty texts are one piece that holds the end id alone; repeated
rows and null ids are packed like any others, each row by itself; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.llm.common import cut_lineage, releasing
from hyperstrata.llm.encoding import encoder

SALTS, SALTED, CHUNK = 256, 1 << 20, 4096


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    first = n % max_len
    edges = ([0] if first else []) + list(range(first, n + 1, max_len))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", payload: str = "ids") -> DataFrame:
    """Pieces of every encoded document: id, piece, start, length and ``payload``.

    payload ``ids``: the ids as little-endian uint32 bytes; ``crc32``: their
    checksum alone, for plans and digests that need no ids.
    """
    kind = dict(docs.dtypes)[id_col]
    out = f"{id_col} {kind}, piece int, start long, length long, " + ("ids binary" if payload == "ids" else "ids_crc32 long")
    end = int(end_id).to_bytes(4, "little")

    def encode(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path, special=True)
        for batch in batches:
            keys, rows = [], []
            for k, ids in enumerate(enc.encode_all(text.as_py() for text in batch.column(1))):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, max_len)):
                    part = ids[4 * start : 4 * (start + length)]
                    keys.append(k)
                    rows.append((piece, start, length, part if payload == "ids" else zlib.crc32(part)))
            if rows:
                piece, start, length, last = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keys, "int64")), pa.array(piece, "int32"), pa.array(start, "int64"), pa.array(length, "int64"), pa.array(last, "binary" if payload == "ids" else "int64")],
                    names=[id_col, "piece", "start", "length", "ids" if payload == "ids" else "ids_crc32"],
                )

    return docs.select(id_col, text_col).mapInArrow(releasing(encode), out)


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns rows (length, first rank, count, first sequence, offset) and the
    number of sequences. ``room[r]`` holds runs (first sequence, count) of
    sequences with r free places. Equal items fill a sequence before the next
    one is opened, as best fit would do one by one.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sequences, free = 0, 0  # bit r of free: some sequence has r free places
    for length in sorted(histogram, reverse=True):
        need, rank = histogram[length], 0
        while need:
            fits = free >> length
            if fits:
                r = length + (fits & -fits).bit_length() - 1
                first, count = room[r].pop()
            else:
                r, first = capacity, sequences
                count = max(1, need // (capacity // length))
                sequences += count
            copies = min(need, r // length)
            use = min(count, need // copies)
            if count > use:
                room[r].append((first + use, count - use))
            if not room[r]:
                free &= ~(1 << r)
            for j in range(copies):
                plan.append((length, rank, use, first, capacity - r + j * length))
                rank += use
            need -= copies * use
            if left := r - copies * length:
                room[left].append((first, use))
                free |= 1 << left
    return plan, sequences


def pack(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``max_len``) with sequence_id and offset."""
    spark = pieces.sparkSession
    columns = pieces.columns
    rows = cut_lineage(pieces.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(max(SALTS, rows.count() // SALTED))).cast("int"))
    sizes = rows.groupBy("length", "_salt").count()
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most max_len rows
    plan, _ = best_fit_plan(histogram, max_len)
    slots = spark.createDataFrame(plan, "length long, _rank0 long, _n long, _seq0 long, offset long")
    slots = slots.withColumn("_chunk", F.explode(F.expr(f"sequence(_rank0 div {CHUNK}, (_rank0 + _n - 1) div {CHUNK})")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1)
        .join(offsets, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .withColumn("_chunk", F.expr(f"_rank div {CHUNK}"))
    )
    placed = ranked.alias("p").join(
        slots.alias("s"),
        (F.col("p.length") == F.col("s.length")) & (F.col("p._chunk") == F.col("s._chunk")) & (F.col("_rank") >= F.col("_rank0")) & (F.col("_rank") < F.col("_rank0") + F.col("_n")),
    )
    return placed.select(*[F.col(f"p.{c}") for c in columns], (F.col("_seq0") + F.col("_rank") - F.col("_rank0")).alias("sequence_id"), F.col("s.offset"))


def packed_sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids (little-endian uint32) joined in order of offset.

    ``packed`` needs the payload ``ids``. A group holds at most one sequence.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("input_ids"), F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"))
