"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector o, padded with zeros to the length D of its code, is rotated by a random
orthogonal matrix and kept as the signs of its coordinates: D packed bits, and one
correction scalar c = <o, s>, where s is the sign vector scaled to unit length. For a
rotated unit query q, <s, q> / c estimates <o, q> without bias, with an error over
EPS * sqrt((1 - c*c) / (c*c * (D - 1))) only rarely. The rows whose upper bound reaches
the k-th largest lower bound over all rows are reranked with the exact cosine; no other
limit is put on them.

Scale: a stated query set meets the codes of all rows block by block; vectors stay where
they are. Of equal vectors only the rows with the k + 1 smallest ids have a code (a query's
own id may be one of them), found by limited windows, so a vector that a third of the rows
share is a few candidates. Codes are packed into blocks of ``BLOCK`` rows, queries into
blocks of ``QUERIES``; blocks are dealt in turn to groups of ``MEET``, and a group of one
meets a block of the other. A group keeps a running k-th bound over its blocks and returns
ids alone; the bound over all groups cuts them further, and only what is left is joined to
its vectors, once for each block of queries, in parts of ``RERANK`` rows. In numpy a
product with unpacked signs costs no more than popcounts of a quantised query; what the
bits save is memory and exchange, of which a code takes 64 bytes and three numbers.

Cases: vectors that are null, zero, or hold a null or a value that is not finite
take no part; vectors of different lengths are never compared; rows with the
query's own id are not its candidates; ties go to the smaller id, repeated rows
each count, and repeated query rows are each a query; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.llm.common import cut_lineage, written

EPS, SEED, CODE = 2.5, 5, 512
BLOCK, QUERIES, MEET, RERANK = 4096, 1024, 32, 8192
_NONE = -3.0  # below every bound


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of the code's length."""
    size = max(dim, CODE)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars) of the rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(turn.shape[1])


def estimate(queries: np.ndarray, bits: np.ndarray, scalars: np.ndarray, turn: np.ndarray, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines queries x rows, error bound of each row)."""
    size = turn.shape[1]
    unit = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ turn
    signs = np.unpackbits(bits, axis=1, count=size).astype("f4") * 2 - 1
    c = scalars.astype("f4")
    est = (unit.astype("f4") @ signs.T) / (np.float32(np.sqrt(size)) * c)
    return est, eps * np.sqrt(np.maximum(0, 1 - c * c) / (c * c) / max(1, size - 1))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision; the same row always gives the same value."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _valid(vector: str) -> Column:
    """Non-empty, without nulls and values that are not finite, and not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def codes(rows: DataFrame, k: int) -> DataFrame:
    """row, key, dim, bits and scalar of the rows that can be among the k nearest of some query.

    Of equal vectors that is at most k rows of each of the k + 1 smallest keys.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = np.asarray(batch.column(2))
            bits, scalars = np.zeros(len(dims), object), np.zeros(len(dims))
            flat, offsets = np.asarray(batch.column(3).flatten()), np.asarray(batch.column(3).offsets)
            offsets = offsets - offsets[0]
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                packed, scalars[at] = encode(flat[offsets[at][:, None] + np.arange(dim)], rotation(dim))
                bits[at] = [x.tobytes() for x in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits.tolist(), pa.binary()), pa.array(scalars), *batch.columns[4:]], names=["row", "key", "dim", "bits", "scalar", "h1", "h2"])

    same = [F.xxhash64("dim", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]
    coded = rows.select("row", "key", "dim", "vector", *same).mapInArrow(run, "row long, key long, dim int, bits binary, scalar double, h1 long, h2 long")
    repeats, copies = Window.partitionBy("dim", "h1", "h2", "key").orderBy("row"), Window.partitionBy("dim", "h1", "h2").orderBy("key")
    few = coded.withColumn("n", F.row_number().over(repeats)).where(F.col("n") <= k)
    return few.withColumn("n", F.dense_rank().over(copies)).where(F.col("n") <= k + 1).drop("n", "h1", "h2")


def _blocks(df: DataFrame, size: int, columns: dict[str, str]) -> DataFrame:
    """Rows of one ``dim`` (the first column) packed into blocks: the columns as binaries of the given types, numbered from 0."""

    def pack(batches):
        import pyarrow as pa

        held: dict[int, list[tuple]] = {}

        def block(dim, rows):
            packed = [b"".join(c) if t == "bytes" else np.array(c, t).tobytes() for c, t in zip(zip(*rows), columns.values())]
            return pa.RecordBatch.from_arrays([pa.array([dim], "int32"), *(pa.array([x], pa.binary()) for x in packed)], names=["dim", *columns])

        for batch in batches:
            for dim, *row in zip(*(c.to_pylist() for c in batch.columns)):
                rows = held.setdefault(dim, [])
                rows.append(row)
                if len(rows) == size:
                    yield block(dim, held.pop(dim))
        for dim, rows in held.items():
            yield block(dim, rows)

    packed = df.select("dim", *columns).mapInArrow(pack, "dim int, " + ", ".join(f"{c} binary" for c in columns))
    packed = written(packed.withColumn("at", F.monotonically_increasing_id()), "blocks")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task that packed
    offsets = packed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return packed.withColumn("part", part).join(offsets, "part").withColumn("number", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "offset", "at")


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the k nearest rows of each query."""
    rows = table.select(F.col(id_col).cast("long").alias("key"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("key").isNotNull() & _valid("vector")).withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()})
    rows = written(rows, "vectors")
    queries = cut_lineage(_blocks(rows.where("asks"), QUERIES, {"row": "i8", "key": "i8", "vector": "f8"}))
    blocks = cut_lineage(_blocks(codes(rows, k), BLOCK, {"row": "i8", "key": "i8", "bits": "bytes", "scalar": "f8"}))
    q_groups, b_groups = max(1, queries.count()), max(1, -(-blocks.count() // MEET))
    left = queries.withColumnsRenamed({"number": "g"}).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(b_groups - 1))))
    right = blocks.withColumn("h", F.pmod("number", F.lit(b_groups)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_groups - 1))))

    def meet(queries, blocks):
        """For each query of the block: the k largest lower bounds, and the rows whose upper bound reaches the last."""
        import pyarrow as pa

        g, dim, q_row, q_key, q_vec = queries.column("g")[0].as_py(), queries.column("dim")[0].as_py(), *(queries.column(c)[0].as_py() for c in ("row", "key", "vector"))
        q_row, q_key, q_vec = np.frombuffer(q_row, "i8"), np.frombuffer(q_key, "i8"), np.frombuffer(q_vec, "f8").reshape(-1, dim)
        turn, low = rotation(dim), np.full((len(q_row), k), _NONE, "f4")
        whose, near, upper = [], [], []
        for d, row, key, bits, scalar in zip(*(blocks.column(c) for c in ("dim", "row", "key", "bits", "scalar"))):
            if d.as_py() != dim:
                continue
            row, key = np.frombuffer(row.as_py(), "i8"), np.frombuffer(key.as_py(), "i8")
            est, err = estimate(q_vec, np.frombuffer(bits.as_py(), "u1").reshape(len(row), -1), np.frombuffer(scalar.as_py(), "f8"), turn)
            err = err.astype("f4")
            est[q_key[:, None] == key[None]] = -9
            low = np.partition(np.concatenate([low, np.maximum(est - err, _NONE)], axis=1), -k, axis=1)[:, -k:]
            est += err
            at = np.flatnonzero((est >= low.min(1)[:, None]) & (est > -8))
            whose.append(at // len(row))
            near.append(row[at % len(row)])
            upper.append(est.ravel()[at])
        whose, near, upper = (np.concatenate(x) if x else np.zeros(0, "i8") for x in (whose, near, upper))
        keep = upper >= low.min(1)[whose]
        whose, near, upper = whose[keep], near[keep], upper[keep]
        order = np.argsort(whose, kind="stable")
        edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(q_row)))]), "int32")
        return pa.table(
            {
                "g": pa.array([g] * len(q_row), "int64"),
                "asker": pa.array(q_row),
                "low": pa.ListArray.from_arrays(pa.array(np.arange(len(q_row) + 1) * k, "int32"), pa.array(low.ravel(), "float32")),
                "near": pa.ListArray.from_arrays(edges, pa.array(near[order], "int64")),
                "upper": pa.ListArray.from_arrays(edges, pa.array(upper[order], "float32")),
            }
        )

    met = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, "g long, asker long, low array<float>, near array<long>, upper array<float>")
    met = written(met, "met")
    floors = met.groupBy("asker").agg(F.element_at(F.sort_array(F.flatten(F.collect_list("low")), False), k).alias("floor"))  # k numbers a group of blocks
    pairs = met.join(floors, "asker").select("g", "asker", "floor", F.explode(F.arrays_zip("near", "upper")).alias("x")).where("x.upper >= floor").select("g", "asker", F.col("x.near").alias("row"))
    asked = written(pairs.groupBy("g", "row").agg(F.collect_list("asker").alias("askers")), "asked")  # at most QUERIES in a list
    parts = cut_lineage(asked.groupBy("g").agg(F.ceil(F.count("*") / RERANK).cast("int").alias("parts")))
    need = asked.join(rows.select("row", "key", "vector"), "row").join(parts, "g").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    ask = queries.withColumnRenamed("number", "g").join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def rerank(queries, rows):
        import pyarrow as pa

        out = []
        if queries.num_rows and rows.num_rows:
            dim = queries.column("dim")[0].as_py()
            q_row, q_key = (np.frombuffer(queries.column(c)[0].as_py(), "i8") for c in ("row", "key"))
            q_vec = np.frombuffer(queries.column("vector")[0].as_py(), "f8").reshape(-1, dim)
            keys, vectors = np.asarray(rows.column("key")), np.asarray(rows.column("vector").combine_chunks().flatten()).reshape(-1, dim)
            askers = rows.column("askers").combine_chunks()
            who = np.asarray(askers.flatten())
            at = np.repeat(np.arange(len(keys)), np.asarray(askers.value_lengths()))
            order = np.argsort(who, kind="stable")
            who, at = who[order], at[order]
            place = {r: n for n, r in enumerate(q_row.tolist())}
            edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                n = place[int(who[a])]
                score = cosines(q_vec[n], vectors[at[a:b]])
                top = best(keys[at[a:b]], score, k)
                out += [(int(who[a]), int(q_key[n]), int(keys[at[a + t]]), float(score[t])) for t in top.tolist()]
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("asker", "query_id", "vec_id", "score"), columns, ("int64", "int64", "int64", "float64"))})

    found = ask.groupBy("g", "part").cogroup(need.groupBy("g", "part")).applyInArrow(rerank, "asker long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
