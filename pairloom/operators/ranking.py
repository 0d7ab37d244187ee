"""Ranks, budgets, bands and sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as gr, pairs as pr


def average_rank(df: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks from 1 where equal values share their mean. Values are counted first, so the running sum is over distinct
    values rather than rows."""
    keys = keys or []
    values = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    up = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = values.select(*keys, column, (F.sum("__n").over(up) - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, column])


def percent_rank_average(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """The average rank as a share of the group's rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    ranked = average_rank(df, column, "__rank", keys)
    ranked = ranked.join(pr.small(sizes), keys) if keys else ranked.join(F.broadcast(sizes))
    return ranked.withColumn(name, F.col("__rank") / F.col("__total")).drop("__rank", "__total")


def row_numbers(df: DataFrame, order: list, keys: list[str] | None = None) -> Column:
    return F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(*order))


def equal_frequency_bands(df: DataFrame, order: list, bands: int, name: str) -> DataFrame:
    """Bands by the linear quantiles of row numbers (sizes differ from ntile where rows don't divide evenly)."""
    numbered = running_sum(df, None, order, "__n")
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    edge = lambda k: 1 + (F.col("__total") - 1) * (k / bands)
    band = sum(((F.col("__n") > edge(k)).cast("int") for k in range(1, bands)), F.lit(0))
    return numbered.join(F.broadcast(total)).withColumn(name, band).drop("__n", "__total")


def calibration_table(df: DataFrame, bins: int, order: list[str], score: str = "score", target: str = "target") -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    numbered = running_sum(df, None, order, "__n").join(F.broadcast(total))  # one row
    # the first (total % bins) bins have one row more, as ntile deals them
    size, more = F.floor(F.col("__total") / bins), F.col("__total") % bins
    nth = F.col("__n") - 1
    bin_ = F.when(nth < more * (size + 1), F.floor(nth / (size + 1))).otherwise(more + F.floor((nth - more * (size + 1)) / F.greatest(size, F.lit(1))))
    binned = numbered.select(score, target, (bin_ + 1).cast("int").alias("decile"))
    return binned.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(target), 6).alias("rate"))


def purity(df: DataFrame, key: str, concept: str, least: float) -> DataFrame:
    """For each key its most frequent concept (ties: the least), where it has that share of the key's rows."""
    counts = df.groupBy(F.col(key).alias("key"), F.col(concept).alias("top")).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy("key").agg(F.min(F.struct((-F.col("votes")).alias("neg"), "top")).alias("b"), F.sum("votes").alias("support"))
    out = best.select("key", F.col("b.top").alias("top"), (-F.col("b.neg")).alias("votes"), "support")
    return out.withColumn("purity", F.col("votes") / F.col("support")).filter(F.col("purity") >= least)


def top_budget(df: DataFrame, share: float, order: list, keys: list[str] | None = None) -> DataFrame:
    """Mark (``chosen``) the first floor(n * share) rows of the whole, or of each group."""
    sizes = df.groupBy(*(keys or [])).agg(F.floor(F.count(F.lit(1)) * share + 1e-12).alias("__k"))
    if not keys:
        return running_sum(df, None, order, "__n").join(F.broadcast(sizes)).withColumn("chosen", F.col("__n") <= F.col("__k")).drop("__k", "__n")  # one row
    return df.join(pr.small(sizes), keys).withColumn("chosen", row_numbers(df, order, keys) <= F.col("__k")).drop("__k")


def top_within(df: DataFrame, outer: float, outer_order: list, inner: float, inner_order: list) -> DataFrame:
    """The first floor(n * inner) rows, by the second order, of the first floor(n * outer) by the first."""
    size = df.agg(F.floor(F.count(F.lit(1)) * inner + 1e-12).alias("__k"))
    eligible = top_budget(df, outer, outer_order).filter("chosen").drop("chosen")
    ranked = running_sum(eligible, None, inner_order, "__r").join(F.broadcast(size))  # one row
    return ranked.filter("__r <= __k").drop("__r", "__k")


def head(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups down before the shuffle."""
    return df.withColumn("__r", row_numbers(df, order, keys)).filter(F.col("__r") <= n).drop("__r")


def review_queue(parts: list[tuple[str, DataFrame, list]], n: int) -> DataFrame:
    """Union of several top-n lists, with the sorted reasons of each pair."""
    rows = None
    for reason, df, order in parts:
        top = df.orderBy(*order).limit(n).select("id1", "id2", F.lit(reason).alias("reason"))
        rows = top if rows is None else rows.union(top)
    return rows.groupBy("id1", "id2").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def pareto(df: DataFrame, better_high: list[str]) -> DataFrame:
    """Rows that no other row beats or equals everywhere and beats somewhere."""
    other = df.select(*(F.col(c).alias(f"__{c}") for c in better_high)).distinct()
    reach = [F.col(f"__{c}") >= F.col(c) for c in better_high]
    beats = [F.col(f"__{c}") > F.col(c) for c in better_high]
    condition = beats[0]
    for b in beats[1:]:
        condition = condition | b
    for r in reach:
        condition = condition & r
    return df.join(other, condition, "left_anti")


def next_after(x: Column, up: bool) -> Column:
    """The next double above or below (Arrow batches; for short curves)."""
    to = float("inf") if up else float("-inf")

    @F.pandas_udf("double")
    def step(s: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(s.to_numpy(np.float64), to))

    return step(x)


#: Rows whose estimated size is below this are ordered in one task; more are ordered by ranges.
ONE_TASK_BYTES = 64 << 20


def running_sum(df: DataFrame, value: str | None, order: list, name: str) -> DataFrame:
    """Add the running sum of a column (or, for None, the row number) in a total order over all rows. Large tables are dealt
    into sorted ranges, whose totals, one row a range, give each its start; no task sees more than its range."""
    step = F.col(value) if value else F.lit(1).cast("long")
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if pr.estimated_bytes(df) < ONE_TASK_BYTES:
        return df.withColumn(name, F.sum(step).over(before))
    dealt = gr.cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    start = F.sum("__t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("__range").agg(F.sum(step).alias("__t")).select("__range", F.coalesce(start, F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn(name, F.sum(step).over(inside)).join(F.broadcast(starts), "__range").withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")  # one row a range
