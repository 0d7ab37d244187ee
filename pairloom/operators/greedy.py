"""Greedy selections without a sequential pass: rounds of windows or joins that decide all rows whose fate is certain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph as gr


def capped(members: DataFrame) -> DataFrame:
    """(row) of the rows that a greedy pass takes. ``members`` has row, place (a row's rank, one order for all), grp and cap:
    in ascending places, a row is taken if every group that it is in has had fewer than ``cap`` rows taken.

    In each round a row is taken if it would be even were all undecided rows before it taken, and dropped if those already
    taken before it fill a group. The first undecided row is always decided, and usually most are, as groups are many."""
    state = gr.cut(members.select("row", "place", "grp", "cap", F.lit(False).alias("taken")))
    while True:
        before = Window.partitionBy("grp").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, -1)
        seen = state.select("*", F.coalesce(F.sum(F.col("taken").cast("int")).over(before), F.lit(0)).alias("had"), F.count(F.lit(1)).over(before).alias("ahead"))
        judged = seen.groupBy("row").agg(F.bool_or("taken").alias("was"), F.bool_and(F.col("ahead") < F.col("cap")).alias("sure"), F.bool_or(F.col("had") >= F.col("cap")).alias("full"))
        judged = gr.cut(judged.select("row", (F.col("was") | (~F.col("full") & F.col("sure"))).alias("now"), (~F.col("was") & F.col("full")).alias("out")))
        after = gr.cut(state.drop("taken").join(judged.filter(~F.col("out")), "row").select("row", "place", "grp", "cap", F.col("now").alias("taken")))
        open_ = after.filter(~F.col("taken")).isEmpty()
        gr.drop(state, judged)
        state = after
        if open_:
            return state.select("row").distinct()


def independent(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(node) of the nodes that a pass in ascending ``place`` keeps: each that is no neighbour of one kept before. ``near``
    has a, b, in both directions. In each round a node without undecided neighbours before it is kept, and what it is next
    to goes."""
    placed = nodes.select("node", "place")
    left = gr.cut(placed)
    links = gr.cut(
        near.select("a", "b").filter("a <> b").distinct().join(placed.select(F.col("node").alias("a"), F.col("place").alias("pa")), "a")
        .join(placed.select(F.col("node").alias("b"), F.col("place").alias("pb")), "b")
    )
    kept = None
    while True:
        blocked = links.filter((F.col("pb") < F.col("pa")) | ((F.col("pb") == F.col("pa")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("node")).distinct()
        chosen = gr.cut(left.join(blocked, "node", "left_anti").select("node"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        gone = links.join(chosen.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).unionByName(chosen).distinct()
        gone = gr.cut(gone)
        rest = gr.cut(left.join(gone, "node", "left_anti"))
        fewer = gr.cut(links.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti"))
        gr.drop(left, links, gone)
        left, links = rest, fewer
        if left.isEmpty():
            return kept
