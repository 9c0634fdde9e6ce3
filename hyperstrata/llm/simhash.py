"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: lower-cased (A-Z) text, words between ASCII white space, shingles
of four words; bit b is set if over half of the shingles' XXH64 hashes have it.

Search: each fingerprint is embedded as the bit counts of its ``SEGMENT``-bit
segments. Turning one bit moves one count by one, so the Manhattan distance of
two embeddings is a lower bound of the Hamming distance. The segments are dealt
to ``max_distance + s`` groups; a distance of at most ``max_distance`` touches at
most as many groups, so two linked fingerprints agree in the counts of at least s
groups: they share a grid cell (s groups, counts of their segments). ``s`` grows
with the number of fingerprints, so that chance does not fill the cells; any s gives
the same links. Within a cell pairs are first tested by the Manhattan bound and then
exactly.

Scale: documents with one fingerprint are one node of the search. A cell is cut
into tiles of ``TILE`` fingerprints and each pair of tiles is one unit of work,
so a hot cell is spread over many tasks; a pair of tiles returns a spanning
forest of its links (fewer edges than nodes), never all pairs of a group. The
forests keep every connection, so components are those of all links. Components
come from alternating large-star and small-star steps with reliable checkpoints, where
a node's edges are pre-aggregated to its smallest neighbour and that table is
checkpointed, so the exchanges of a hub's join can be split by adaptive execution.
Nothing but counts and a checksum reaches the driver.

Cases: null, empty and blank texts have no words and the fingerprint zero, and
are linked like any other; fewer than four words make one shingle; repeated rows
each get a row; a null id never is a component's id unless all its ids are null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperstrata.llm.common import LOWER_ASCII, cut_lineage, packed, releasing, text_keys, unpacked, written

SEED, SEGMENT, TILE, SMALL = 42, 2, 2048, 64
_ALIKE = 0.375  # two random segments of two bits have equal counts so often
_CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    import xxhash

    buffer = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split())
    if not buffer:
        return 0
    ends = np.flatnonzero(np.frombuffer(buffer, "u1") == 32)
    n = len(ends) + 1
    if n <= words:
        starts, stops = [0], [len(buffer)]
    else:
        starts = [0, *(ends[: n - words] + 1).tolist()]
        stops = [*ends[words - 1 :].tolist(), len(buffer)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, "i8")
    for k in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(buffer[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    bits = counts * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """Some columns and the fingerprint (as a signed 64-bit integer ``_fp``) of each row."""
    kept = docs.select(*carry, F.col(text_col).alias("_text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(len(carry))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), pa.array(fp)], names=[*carry, "_fp"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(releasing(run), ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", _fp long")


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of 2-bit segments, each count c written as c ones.

    The Manhattan distance of two embeddings is the Hamming distance of these.
    """
    low = np.uint64(0x5555555555555555)
    a, b = fp & low, (fp >> np.uint64(1)) & low
    return ((a & b) << np.uint64(1)) | (a | b)


def group_masks(groups: int) -> list[int]:
    """Masks of ``groups`` runs of whole segments that together cover 64 bits."""
    edges = [SEGMENT * round(k * (64 // SEGMENT) / groups) for k in range(groups + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def shared_groups(nodes: int, max_distance: int) -> int:
    """In how many groups, of ``max_distance`` and as many more, linked fingerprints are to agree:

    the fewest for which cells of random fingerprints are far smaller than a tile, at most four.
    """
    for s in (1, 2, 3):
        if nodes * _ALIKE ** (64 // SEGMENT * s / (max_distance + s)) <= 64:
            return s
    return 4


def cells(nodes: DataFrame, max_distance: int, shared: int) -> DataFrame:
    """fp, group (a choice of ``shared`` groups) and cell (counts of their segments) of distinct fingerprints."""
    low = F.lit(0x5555555555555555)
    a, b = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    unary = F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseOR(b))
    masks = [sum(some) for some in combinations(group_masks(max_distance + shared), shared)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    grid = F.array(*[F.struct(F.lit(k).alias("group"), F.col("unary").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])
    return nodes.select("fp", unary.alias("unary")).select("fp", F.inline(grid))


def _forest(a: np.ndarray, b: np.ndarray, same: bool, max_distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between (or within) two tiles."""
    ua, ub, far = unary_counts(a), unary_counts(b), np.uint8(max_distance)
    nodes = a if same else np.concatenate([a, b])
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for k in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(ub[k + 1 :] ^ ua[k] if same else ub ^ ua[k]) <= far) + (k + 1 if same else 0)
        for j in near[np.bitwise_count(b[near] ^ a[k]) <= far].tolist():
            x, y = find(k), find(j if same else len(a) + j)
            if x != y:
                root[x] = y
                edges.append((int(a[k].view("i8")), int(b[j].view("i8"))))
    return edges


def _unit_links(rows: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Spanning forests of the links of units of work: rows (group, cell, i, j, tile, fp) in this order, units whole.

    Units of few fingerprints are compared all at once, by their distance in the table;
    links found are united unit by unit.
    """
    starts = np.concatenate([[0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1])
    sizes = np.diff(np.append(starts, rows.shape[1]))
    fp, same = rows[5].view("u8"), rows[2, starts] == rows[3, starts]
    small, edges = same & (sizes <= SMALL), []
    for a, n, one in zip(starts[~small].tolist(), sizes[~small].tolist(), same[~small].tolist()):
        own = fp[a : a + n]
        cut = n if one else int(np.searchsorted(rows[4, a : a + n], rows[2, a], "right"))
        edges += _forest(own[:cut], own if one else own[cut:], one, max_distance)
    some = np.repeat(small, sizes)
    nodes, unit = fp[some], np.repeat(np.arange(len(sizes)), sizes)[some]
    unary, near = unary_counts(nodes), []
    for d in range(1, int(sizes[small].max(initial=1))):
        at = np.flatnonzero(unit[d:] == unit[:-d])
        at = at[np.bitwise_count(unary[at] ^ unary[at + d]) <= max_distance]
        at = at[np.bitwise_count(nodes[at] ^ nodes[at + d]) <= max_distance]
        near += zip(at.tolist(), (at + d).tolist())
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in near:  # places of one unit are never those of another
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            edges.append((int(nodes[a].view("i8")), int(nodes[b].view("i8"))))
    return edges


def links(nodes: DataFrame, max_distance: int = 4, shared: int | None = None) -> DataFrame:
    """Edges (a, b) that connect just what links within ``max_distance`` connect."""
    in_cells = cells(nodes, max_distance, shared or shared_groups(nodes.count(), max_distance)).withColumn("_spread", F.xxhash64("fp"))
    sizes = cut_lineage(in_cells.groupBy("group", "cell").count().where("count > 1").select("group", "cell", F.ceil(F.col("count") / TILE).cast("int").alias("_tiles")))
    tiles = in_cells.join(sizes, ["group", "cell"]).select("group", "cell", "fp", "_tiles", F.pmod("_spread", "_tiles").cast("int").alias("_tile"))
    # tile t meets every tile: as the first of (t, u) for u >= t and the second of (u, t) for u < t
    partners = F.expr("transform(sequence(0, _tiles - 1), u -> struct(least(_tile, u) as i, greatest(_tile, u) as j))")
    work = tiles.select("group", "cell", "fp", "_tile", F.inline(partners))

    unit = ["group", "cell", "i", "j"]

    def join(batches):
        import pyarrow as pa

        def found(rows):
            edges = _unit_links(rows, max_distance)
            x, y = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, "int64"), pa.array(y, "int64")], names=["a", "b"])

        held = np.zeros((6, 0), "i8")  # the rows of the last unit, which may go on in the next batch
        for batch in batches:
            rows = np.concatenate([held, np.stack([np.asarray(c).astype("i8") for c in batch.columns])], axis=1)
            fresh = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0))
            last = fresh[-1] + 1 if len(fresh) else 0
            held = rows[:, last:]
            if last:
                yield found(rows[:, :last])
        if held.size:
            yield found(held)

    ordered = work.select(*unit, "_tile", "fp").repartition(*unit).sortWithinPartitions(*unit, "_tile", "fp")
    return ordered.mapInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge.

    Alternating large-star and small-star steps: each keeps the components and
    moves edges towards the smallest node, in a number of rounds logarithmic in
    the component sizes; ends when a round changes nothing.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v"), F.col("u"))) if large else e
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m")))
        joined = both.join(least, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        else:
            moved = joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct(F.col("u"), F.col("_m").alias("v")))))
        return moved.where("u <> v").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()

    seen = mark(edges)
    while True:
        edges = cut_lineage(star(star(edges, True), False))
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _roots(marked: DataFrame, max_distance: int) -> DataFrame:
    """_fp and root (the least fingerprint of its component) of all fingerprints."""
    nodes = cut_lineage(marked.select(F.col("_fp").alias("fp")).distinct())
    roots = components(links(nodes, max_distance))
    return cut_lineage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("_root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4) -> DataFrame:
    """id, fp (signed 64-bit) and component_id (the smallest id reachable) of each row."""
    marked = cut_lineage(fingerprints(docs, text_col, [id_col]))
    roots = _roots(marked, max_distance)
    least = marked.groupBy("_fp").agg(F.min(id_col).alias("_least")).join(roots, "_fp").groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = cut_lineage(roots.join(cut_lineage(least), "_root").select("_fp", "component_id"))
    return marked.join(named, "_fp").select(id_col, F.col("_fp").alias("fp"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest id (ids
    before null), then the smallest hash of its text; of equal rows any one."""
    keys = text_keys(id_col, text_col)
    marked = cut_lineage(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in keys.items()]), "text", ["id", "k1", "k2"]))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    least = marked.groupBy("_fp").agg(F.min(order).alias("_least")).join(_roots(marked, max_distance), "_fp")
    kept = written(least.groupBy("_root").agg(F.min("_least").alias("_least")).select("_least.k1", "_least.k2"), "survivors")
    return unpacked(packed(docs, **keys).join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), docs.columns)
