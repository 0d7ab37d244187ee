"""Selections that depend on one another: assignments, folds, suppression, prevalence search, two-tailed policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import greedy as gd, ranking as rk


def round_robin(needs: DataFrame, pool: DataFrame, scope: list[str], need_order: list, pool_order: list) -> DataFrame:
    """Give every need of a scope the least-used member of the scope's pool, ties by the pool's order: with disjoint
    pools that is the pool in turn."""
    sizes = pool.groupBy(*scope).agg(F.count(F.lit(1)).alias("__n"))
    nth = F.row_number().over(Window.partitionBy(*scope).orderBy(*need_order)) - 1
    wanted = needs.withColumn("__k", nth).join(F.broadcast(sizes), scope).withColumn("__k", F.col("__k") % F.col("__n"))
    given = pool.withColumn("__k", F.row_number().over(Window.partitionBy(*scope).orderBy(*pool_order)) - 1)
    return wanted.join(given, [*scope, "__k"]).drop("__k", "__n")


def prevalence_for(df: DataFrame, wanted: float, rounds: int = 80, digits: int = 4) -> float:
    """The prevalence at which macro AP, with negatives reweighted, is ``wanted``: bisection over a curve. Scores are rounded
    to ``digits`` places, which bounds the curve that reaches the driver."""
    at = F.round("score", digits)
    points = df.groupBy("category", at.alias("score")).agg(F.sum("target").cast("double").alias("p"), F.sum(1 - F.col("target")).cast("double").alias("n")).toPandas()
    curves = [g.sort_values("score", ascending=False)[["p", "n"]].to_numpy().T for _, g in points.groupby("category")]
    curves = [(p, n) for p, n in curves if p.sum() and n.sum()]

    def macro(prevalence: float) -> float:
        out = []
        for p, n in curves:
            found = p.cumsum()
            out.append((p * found / (found + p.sum() * (1 - prevalence) / (prevalence * n.sum()) * n.cumsum())).sum() / p.sum())
        return sum(out) / len(out) if out else float("nan")

    low, high = 1e-6, 1 - 1e-6
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if macro(mid) < wanted else (low, mid)
    return (low + high) / 2


def suppress_neighbours(candidates: DataFrame, neighbours: DataFrame, block: str, node: str, score: str) -> DataFrame:
    """Representatives of each block: by descending score (ties by node), each node that no chosen node has as neighbour
    (neighbours are (a, b) in both directions, within blocks)."""
    placed = rk.running_sum(candidates.select(block, node, score), None, [F.desc(score), node], "place")
    kept = gd.independent(placed.select(F.col(node).alias("node"), "place"), neighbours)
    return placed.join(kept.withColumnRenamed("node", node), node, "left_semi").select(block, node, score)
