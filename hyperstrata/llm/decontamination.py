"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) runs between ASCII white space with ASCII punctuation
stripped from both ends; their 64-bit hashes stand for them. A document and a
benchmark item are compared if they share a seed, a run of ``MIN_MATCH`` words (the
whole item, if it is shorter). Greedy string tiling then repeatedly marks the longest
match of words that no earlier match has marked, down to ``MIN_MATCH`` words, finding
matches by running Karp-Rabin hashes and checking them word by word. The share of the
item's words that are marked (its coverage) does not depend on the order in which its
passages stand in the document. A pair is kept from a coverage of ``THRESHOLD`` on.

Scale: seeds of documents and items are joined by Spark; the driver holds no item. In
one pass over the documents a bitmap of the benchmark's seeds (at most ``BITMAP_BITS``
bits, so its size has a bound) passes the few documents with a possible seed, which
are written with these seeds; only they go on. Their seeds meet those of the items in
a plain equi-join, pairs are made distinct before their shuffle, and each pair is
tiled by itself. Tables of known size are written, so the planner broadcasts them only
if they are small, and adaptive execution splits hot seeds and items.

Cases: null and empty texts, and items without words, match nothing; repeated
document rows each give their pairs; repeated items each give theirs; ties go to
the match that stands first in the item, then in the document; a match is found once,
at its start, so repetitive texts do not multiply the work; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperstrata.llm.common import LOWER_ASCII, packed, releasing, text_keys, unpacked, written

MIN_MATCH, THRESHOLD = 5, 0.6
BITMAP_BITS, PROBES = 1 << 27, (0, 18, 37)  # a seed sets one bit for each part of its hash
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    found = [w.strip(_PUNCTUATION) for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()]
    return [w for w in found if w]


def word_hashes():
    """text -> the 64-bit hashes of its words."""
    import xxhash

    def hashes(text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(xxhash.xxh64_intdigest, found), "u8", len(found))

    return hashes


def running_hashes(numbers: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``k`` numbers, modulo 2**64."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, "u8")
    out = np.full(n, k, "u8")  # runs of different lengths differ
    for j in range(k):
        out *= _BASE
        out += numbers[j : j + n].astype("u8")
        out ^= out >> np.uint64(32)
    return out


def tile(item: np.ndarray, doc: np.ndarray, min_match: int, places: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length) of greedy string tiling.

    ``places``: the document's runs in order of their hashes, and these, if known.
    """
    order, hashes = places or sorted_runs(doc, min_match)
    wanted = running_hashes(item, min_match)
    low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
    matches = []
    for i in np.flatnonzero(high > low).tolist():
        js = order[low[i] : high[i]]
        if i:  # only where a match starts
            js = js[(js == 0) | (doc[js - 1] != item[i - 1])]
        for j in js.tolist():
            room = min(len(item) - i, len(doc) - j)
            same = item[i : i + room] == doc[j : j + room]
            length = room if same.all() else int(same.argmin())
            if length >= min_match:
                matches.append((-length, i, j))
    heapq.heapify(matches)
    in_item, in_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while matches:
        length, i, j = heapq.heappop(matches)
        taken = in_item[i : i - length] | in_doc[j : j - length]
        if not taken.any():
            tiles.append((i, j, -length))
            in_item[i : i - length] = True
            in_doc[j : j - length] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype("i1")))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what is left of the match
            if b - a >= min_match:
                heapq.heappush(matches, (a - b, i + a, j + a))
    return tiles


def sorted_runs(doc: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = running_hashes(doc, min_match)
    order = np.argsort(hashes, kind="stable")
    return order, hashes[order]


def seed_table(items: DataFrame, min_match: int) -> DataFrame:
    """item, k and hash (as a signed long) of the different seeds of each item."""

    def run(batches):
        import pyarrow as pa

        hashes = word_hashes()
        for batch in batches:
            owners, ks, found = [], [], [np.zeros(0, "u8")]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = hashes(text.as_py())
                if len(numbers):
                    k = min(min_match, len(numbers))
                    found.append(np.unique(running_hashes(numbers, k)))
                    owners += [item] * len(found[-1])
                    ks += [k] * len(found[-1])
            yield pa.RecordBatch.from_arrays([pa.array(owners, "int64"), pa.array(ks, "int32"), pa.array(np.concatenate(found).view("i8"))], names=["item", "k", "hash"])

    return items.select("item", "text").mapInArrow(run, "item long, k int, hash long")


def bitmap_of(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(a bitmap of the seeds' hashes, the lengths of seeds); both of bounded size."""
    lengths = {r["k"]: r["n"] for r in seeds.groupBy("k").agg(F.count("*").alias("n")).collect()}
    bits = min(BITMAP_BITS, 1 << max(16, (512 * sum(lengths.values())).bit_length()))
    at = F.col("at")
    probes = F.explode(F.array(*[F.shiftrightunsigned("hash", p).bitwiseAND(F.lit(bits - 1)) for p in PROBES]))
    cells = seeds.select(probes.alias("at")).select(F.shiftright(at, 6).alias("cell"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, "i8")
    bitmap[np.asarray(cells.column("cell"))] = np.asarray(cells.column("bits"))
    return bitmap.view("u1"), sorted(lengths)


def suspects(docs: DataFrame, carry: list[str], text_col: str, bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """row, ``carry``, text and the possible seeds of the documents that have any."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    kept = docs.select(*carry, F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        hashes, bits = word_hashes(), sent.value
        mask = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            at, seeds = [], []
            for k, text in enumerate(batch.column(len(carry))):
                numbers = hashes(text.as_py())
                found = np.concatenate([np.zeros(0, "u8"), *(running_hashes(numbers, n) for n in lengths)])
                for probe in PROBES:
                    place = found >> np.uint64(probe) & mask
                    found = found[bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype("u1") & 1 == 1]
                if len(found):
                    at.append(k)
                    seeds.append(np.unique(found).view("i8"))
            if at:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, "int64")) for c in batch.columns), pa.array(seeds, pa.list_(pa.int64()))], names=[*carry, "text", "seeds"])

    kinds = dict(kept.dtypes)
    out = kept.mapInArrow(releasing(run), ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", text string, seeds array<long>")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "suspects")


def pairs(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str, item_col: str, min_match: int, threshold: float) -> DataFrame:
    """``carry`` of the document, item_id, coverage, n_tiles, longest and tiles of each pair covered far enough."""
    items = written(benchmark.select(F.col(item_col).alias("item_id"), F.col("text").alias("text")).where("text is not null").withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = written(seed_table(items, min_match), "seeds")
    found = suspects(docs, carry, text_col, *bitmap_of(seeds))
    near = written(found.select("row", F.explode("seeds").alias("hash")).join(seeds.select("hash", "item"), "hash").select("row", "item").distinct(), "pairs")
    work = near.join(items.withColumnRenamed("text", "item_text"), "item").join(found.select("row", *carry, "text"), "row").select("row", "text", "item_text", "item_id", *carry)
    kinds = dict(work.dtypes)

    def run(batches):
        import pyarrow as pa

        tile_type = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
        hashes, last, doc, runs = word_hashes(), None, None, {}
        for batch in batches:
            at, rows = [], []
            for k, (row, text, item_text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2))):
                if row != last:
                    last, doc, runs = row, hashes(text.as_py()), {}
                item = hashes(item_text.as_py())
                least = min(min_match, len(item))
                if least not in runs:
                    runs[least] = sorted_runs(doc, least)
                tiles = tile(item, doc, least, runs[least])
                covered = sum(t[2] for t in tiles) / len(item)
                if tiles and covered >= threshold:
                    at.append(k)
                    rows.append((covered, len(tiles), max(t[2] for t in tiles), [dict(zip(("item_at", "doc_at", "length"), t)) for t in tiles]))
            if rows:
                covered, count, longest, tiles = zip(*rows)
                same = [c.take(pa.array(at, "int64")) for c in batch.columns[3:]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(covered, "float64"), pa.array(count, "int32"), pa.array(longest, "int32"), pa.array(tiles, tile_type)], names=["item_id", *carry, "coverage", "n_tiles", "longest", "tiles"])

    out = ", ".join(f"`{c}` {kinds[c]}" for c in ["item_id", *carry]) + ", coverage double, n_tiles int, longest int, tiles array<struct<item_at: int, doc_at: int, length: int>>"
    return work.mapInArrow(run, out)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item it holds: id, item_id, coverage, n_tiles, longest and tiles."""
    found = pairs(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), benchmark, ["_id"], "_text", item_col, min_match, threshold)
    return found.select(F.col("_id").alias(id_col), "item_id", "coverage", "n_tiles", "longest", "tiles")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    keys = text_keys(id_col, text_col)
    keyed = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text_col).alias("_text"))
    bad = written(pairs(keyed, benchmark, ["k1", "k2"], "_text", item_col, min_match, threshold).select("k1", "k2").distinct(), "contaminated")
    return unpacked(packed(docs, **keys).join(bad, ["k1", "k2"], "left_anti"), docs.columns)
