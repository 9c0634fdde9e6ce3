"""Queries on panels take every vector."""

import pytest
from pyspark.sql import functions as F

from hyperstrata.plans import catalog

WIDTHS = {"diffusion": 64, "lapfill": 64, "dipfilter": 64, "spectra2": 64, "canny": 64, "label_components": 64, "dip": 64, "stolt": 32, "automatic_pick": 24}


@pytest.mark.parametrize("name", list(WIDTHS))
def test_every_vector_is_in_a_panel(spark, tmp_path, name):
    rows = [(k, [float((7 * k + 3 * j) % 11) for j in range(64)], k % 5) for k in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["i3"]: r["n"] for r in catalog.queries()[name](spark, str(tmp_path)).groupBy("i3").agg(F.count("*").alias("n")).collect()}
    assert sorted(got) == list(range(-(-150 // WIDTHS[name]))) and len(set(got.values())) == 1
