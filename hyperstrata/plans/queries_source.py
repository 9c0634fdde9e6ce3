"""Sources and sinks as round trips: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hyperstrata.operators.grid import shared_folder
from hyperstrata.plans import datasets
from hyperstrata.plans.adapters import VECTORS, vectors, whole
from hyperstrata.plans.catalog import query, rounded
from hyperstrata.plans.queries_select import R
from hyperstrata.sources import native, segy, tables


def _path(spark, kind: str) -> str:
    folder = shared_folder(spark)
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder[len("file:") :]
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


@query(f"WITH {VECTORS} SELECT i1, i2, v FROM g")
def native_round_trip(spark, sf):
    path = _path(spark, "native")
    native.write(whole(spark, sf), path)
    return native.read(spark, path).df.select("i1", "i2", F.col("v").cast("double").alias("v"))


@query(f"WITH {VECTORS} SELECT i1, i2, {R('v', 5)} AS v FROM g")
def segy_round_trip(spark, sf):
    path = _path(spark, "segy")
    segy.write(vectors(spark, sf).to_traces(), path, 0.004, 64)
    back = segy.read(spark, path).select(F.col("i2").cast("long").alias("i2"), F.posexplode("trace").alias("i1", "v"))
    return rounded(back.select(F.col("i1").cast("long").alias("i1"), "i2", F.col("v").cast("double").alias("v")), 5)


@query("SELECT count(*) AS traces, CAST(64 AS BIGINT) AS samples FROM embeddings")
def segy_headers(spark, sf):
    """The header words of every trace, read without the samples."""
    path = _path(spark, "segy")
    segy.write(vectors(spark, sf).to_traces(), path, 0.004, 64)
    found, form = segy.read(spark, path, "head"), segy.layout(path)
    return found.agg(F.count("*").alias("traces")).withColumn("samples", F.lit(form["ns"]).cast("long"))


@query("SELECT CAST(k.k AS BIGINT) AS i1, row_number() OVER (PARTITION BY k.k ORDER BY s_suppkey) - 1 AS i2, CASE WHEN k.k = 0 THEN CAST(s_suppkey AS DOUBLE) ELSE s_acctbal END AS v FROM supplier, range(2) AS k(k)")
def csv_round_trip(spark, sf):
    path = _path(spark, "csv")
    spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", "s_acctbal").coalesce(1).sortWithinPartitions("s_suppkey").write.csv(path)
    return tables.read_csv(spark, path, 2).df


@query(f"WITH {VECTORS} SELECT i1, i2, v FROM g")
def dataset_copy(spark, sf):
    """Saved, copied, the first removed, and the copy loaded."""
    first, second = _path(spark, "dataset"), _path(spark, "dataset")
    datasets.save(whole(spark, sf), first)
    datasets.copy(spark, first, second)
    datasets.remove(first)
    return datasets.load(spark, second).df.select("i1", "i2", "v")


@query("SELECT CAST(64 AS BIGINT) AS n1, max(vec_id) + 1 AS n2, 0.5 AS d1 FROM embeddings")
def header_get(spark, sf):
    """Header values of a saved dataset after one of them is put."""
    path = _path(spark, "dataset")
    datasets.save(whole(spark, sf), path)
    datasets.put(path, d1=0.5)
    h = datasets.load(spark, path).header
    return spark.createDataFrame([(h.axis(1).n, h.axis(2).n, float(h.axis(1).d))], "n1 long, n2 long, d1 double")


@query(f"WITH {VECTORS} SELECT i2, CAST(count(*) AS INTEGER) AS n, max(CASE WHEN i1 = 3 THEN v END) AS fourth FROM g GROUP BY 1")
def print_rows(spark, sf):
    """Lines as they are printed: their lengths and fourth samples."""
    return tables.to_rows(whole(spark, sf)).select("i2", F.size("trace").alias("n"), F.col("trace")[3].alias("fourth"))
