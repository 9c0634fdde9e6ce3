"""Running operators on live feeds. The grids themselves are finite; these are additions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_feed(events: DataFrame, time: str, value: str, by: str, width: str, late: str) -> DataFrame:
    """Counts and sums in windows of event time; results are final once ``late`` has passed."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), F.col(by))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), by, "n", "total")
    )


def causal_sum_feed(events: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Running sums of each key across micro-batches, in order within a batch; the state is one number a key."""
    kind = dict(events.dtypes)[by]

    def run(key, frames: Iterator, state):
        import pandas as pd

        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values([order, value])
        sums = rows[value].cumsum() + total
        state.update((float(sums.iloc[-1]),))
        yield pd.DataFrame({by: key[0], order: rows[order], "running": sums})

    return events.select(by, order, value).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {order} {dict(events.dtypes)[order]}, running double", "total double", "append", "NoTimeout")
