"""Ingestion of generated rows: first of each key, at most so many a signature, running profiles; as streams and as batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accepted(rows: DataFrame, key: str, signature: str, cap: int, order: list) -> DataFrame:
    """The first row of each key and, of those, the first ``cap`` of each signature, in the given order."""
    once = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")
    return once.withColumn("__r", F.row_number().over(Window.partitionBy(signature).orderBy(*order))).filter(F.col("__r") <= cap).drop("__r")


def accept_stream(stream: DataFrame, key: str, signature: str, cap: int, order: str) -> DataFrame:
    """The same over a stream, batch after batch (``order`` settles ties within one): a signature's state holds how many were
    accepted and the keys of those, at most ``cap`` of them. A key belongs to one signature."""
    schema = stream.schema

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        known, out = set(taken), []
        for f in frames:
            for r in f.sort_values(order).to_dict("records"):
                if len(taken) < cap and str(r[key]) not in known:
                    known.add(str(r[key]))
                    taken.append(str(r[key]))
                    out.append(r)
        state.update((taken,))
        yield pd.DataFrame(out, columns=schema.names)

    return stream.groupBy(signature).applyInPandasWithState(step, schema, "taken array<string>", "append", GroupStateTimeout.NoTimeout)


def running_profile(stream: DataFrame, category: str, key: str) -> DataFrame:
    """Counts, the range of keys and the least hash of each category, kept up to date by a stream (complete mode). Every part
    is an aggregate with a fixed-size state."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    return stream.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key).alias("keys"), F.min(key).alias("least"), F.max(key).alias("most"), F.min(F.struct(h.alias("h"), F.col(key).alias("key"))).alias("first"))


def lowest_hashes(rows: DataFrame, category: str, key: str, n: int) -> DataFrame:
    """The n keys of least hash of each category: what a bounded heap a category would hold at the end of a stream."""
    h = F.md5(F.col(key).cast("string").cast("binary"))
    rank = F.row_number().over(Window.partitionBy(category).orderBy(h, key))
    return rows.select(category, key).distinct().withColumn("turn", rank).filter(F.col("turn") <= n)
