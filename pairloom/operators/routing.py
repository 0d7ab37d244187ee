"""Budgeted routing of pairs to further models, and what it gains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import greedy as gd, metrics as me, pairs as pr, ranking as rk


def slice_metrics(df: DataFrame, slices: list[tuple[Column, Column]], before: str, after: str, threshold: float = 0.5) -> DataFrame:
    """For each named slice (condition, name): rows, corrected and regressed decisions, gain in absolute error. A row is
    read once and unpivoted to the slices that it is in."""
    names = F.filter(F.array(*(F.when(c, n) for c, n in slices)), lambda x: x.isNotNull())
    rows = df.select("target", before, after, F.explode(names).alias("slice"))
    right = lambda s: (F.col(s) >= threshold).cast("int") == F.col("target")
    gain = F.abs(F.col(before) - F.col("target")) - F.abs(F.col(after) - F.col("target"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if(~right(before) & right(after)).alias("corrected"), F.count_if(right(before) & ~right(after)).alias("regressed"), F.avg(gain).alias("mae_gain"))


def staged(df: DataFrame, first: float = 0.4, second: float = 0.05) -> DataFrame:
    """Model b for the share of pairs where model a is least certain, model c for the share of all where, within those,
    b is; each blend halves with the one before."""
    one = rk.top_budget(df, first, [F.abs(F.col("score") - 0.5), "id1", "id2"]).withColumnRenamed("chosen", "e1")
    two = rk.top_budget(one, second, [F.desc("e1"), F.abs(F.col("score_b") - 0.5), "id1", "id2"])
    e2 = F.col("chosen") & F.col("e1")
    mid = (F.col("score") + F.col("score_b")) / 2
    return two.withColumn("final", F.when(e2, mid * 0.5 + F.col("score_c") * 0.5).when(F.col("e1"), mid).otherwise(F.col("score")))


def oracle_grid(df: DataFrame, budgets: list[float]) -> DataFrame:
    """Mean absolute error if the pairs of most benefit are routed, for several budgets, from one ranking."""
    gain = F.abs(F.col("score") - F.col("target")) - F.abs(F.col("score_b") - F.col("target"))
    ranked = df.withColumn("gain", gain)
    ranked = ranked.withColumn("r", F.row_number().over(Window.orderBy(F.desc("gain"), "id1", "id2"))).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))
    kept, better = F.abs(F.col("score") - F.col("target")), F.abs(F.col("score_b") - F.col("target"))
    errors = [F.avg(F.when((F.col("r") <= F.floor(F.col("n") * b + 1e-12)) & (F.col("gain") > 0), better).otherwise(kept)).alias(f"b{i}") for i, b in enumerate(budgets)]
    one = ranked.agg(*errors)
    return one.select(F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), F.col(f"b{i}").alias("mae")) for i, b in enumerate(budgets)))).alias("x")).select("x.*")


def exclusive_allocation(df: DataFrame, share: float) -> DataFrame:
    """Two experts with a quota each; a pair goes to one of them, in the order of the larger gain over both (ties by expert and
    ids); only gains above zero count."""
    gain = lambda c: F.round(F.abs(F.col("score") - F.col("target")) - F.abs(F.col(c) - F.col("target")), 9)
    both = F.array(*(F.struct(F.lit(c[-1]).alias("expert"), gain(c).alias("gain")) for c in ("score_b", "score_c")))
    rows = df.select("id1", "id2", F.explode(both).alias("x")).select("id1", "id2", "x.*").filter("gain > 0")
    quota = int(df.count() * share + 1e-12)
    placed = rk.running_sum(rows, None, [F.desc("gain"), "expert", "id1", "id2"], "__place")
    groups = F.array(F.struct(F.concat_ws(":", "id1", "id2").alias("grp"), F.lit(1).alias("cap")), F.struct(F.concat(F.lit("expert "), "expert").alias("grp"), F.lit(quota).alias("cap")))
    members = placed.select(F.col("__place").alias("row"), F.col("__place").alias("place"), F.explode(groups).alias("g")).select("row", "place", "g.*")
    return placed.join(gd.capped(members).withColumnRenamed("row", "__place"), "__place", "left_semi").select("id1", "id2", "expert")


def oracle_routes(df: DataFrame, modes: dict[str, float], experts: list[str], budgets: list[float], base: str = "score") -> DataFrame:
    """(mode, expert, policy, budget, routed, macro_ap): macro AP if the pairs of most benefit get the blend of the base with an
    expert (``best``: whichever helps more), for several weights, over the whole or within each category. A pair is ranked
    once a mode, expert and policy; budgets are cut from those ranks."""
    y, s = F.col("target"), F.col(base)
    cells = []
    for mode, w in modes.items():
        blends = {e: (1 - w) * s + w * F.col(e) for e in experts}
        gains = {e: F.round(F.abs(s - y) - F.abs(b - y), 9) for e, b in blends.items()}
        for e in experts:
            cells.append(F.struct(F.lit(mode).alias("mode"), F.lit(e).alias("expert"), blends[e].alias("other"), gains[e].alias("gain")))
        top = F.greatest(*gains.values()) if len(experts) > 1 else gains[experts[0]]
        pick = reduce(lambda c, e: c.when(gains[e] == top, blends[e]), experts[1:], F.when(gains[experts[0]] == top, blends[experts[0]]))  # noqa: B023
        cells.append(F.struct(F.lit(mode).alias("mode"), F.lit("best").alias("expert"), pick.alias("other"), top.alias("gain")))
    rows = df.select("id1", "id2", "category", "target", s.alias("base"), F.explode(F.array(*cells)).alias("c")).select("id1", "id2", "category", "target", "base", "c.*")
    order = [F.desc("gain"), "id1", "id2"]
    parts = []
    for policy, keys in (("global", ["mode", "expert"]), ("category", ["mode", "expert", "category"])):
        n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(pr.small(n), keys)
        parts.append(ranked.select("mode", "expert", F.lit(policy).alias("policy"), "category", "target", "base", "other", "gain", "r", "n"))
    each = parts[0].unionByName(parts[1]).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    go = (F.col("r") <= F.floor(F.col("budget") * F.col("n") + 1e-12)) & (F.col("gain") > 0)
    each = each.withColumn("final", F.round(F.when(go, F.col("other")).otherwise(F.col("base")), 9)).withColumn("go", go)
    keys = ["mode", "expert", "policy", "budget"]
    routed = each.groupBy(*keys).agg(F.count_if("go").alias("routed"))
    ap = me.average_precision(each, [*keys, "category"], score="final").groupBy(*keys).agg(F.avg("ap").alias("macro_ap"))
    return routed.join(ap, keys)


def blend_grid(df: DataFrame, weights: list[float], first: float = 0.4, second: float = 0.05) -> DataFrame:
    """(scheme, weight_b, weight_c, macro_ap) of blends with model b on the share of pairs where the base is least certain, and
    with model c on those of them where b is (``hierarchical``) or on those outside them (``exclusive``)."""
    far = lambda c: F.abs(F.col(c) - 0.5)
    one = rk.top_budget(df, first, [far("score"), "id1", "id2"]).withColumnRenamed("chosen", "e1")
    two = rk.top_budget(one, second, [F.desc("e1"), far("score_b"), "id1", "id2"]).withColumnRenamed("chosen", "inside")
    rows = rk.top_budget(two, second, [F.col("e1").cast("int"), far("score_b"), "id1", "id2"]).withColumnRenamed("chosen", "outside")
    cells = []
    for wb in weights:
        mid = F.when(F.col("e1"), (1 - wb) * F.col("score") + wb * F.col("score_b")).otherwise(F.col("score"))
        for wc in weights:
            inner = F.when(F.col("inside") & F.col("e1"), (1 - wc) * mid + wc * F.col("score_c")).otherwise(mid)
            outer = F.when(F.col("outside") & ~F.col("e1"), (1 - wc) * F.col("score") + wc * F.col("score_c")).otherwise(mid)
            cells += [F.struct(F.lit(n).alias("scheme"), F.lit(wb).alias("weight_b"), F.lit(wc).alias("weight_c"), F.round(x, 9).alias("s")) for n, x in (("hierarchical", inner), ("exclusive", outer))]
    grid = rows.select("category", "target", F.explode(F.array(*cells)).alias("g")).select("category", "target", "g.*")
    keys = ["scheme", "weight_b", "weight_c"]
    return me.average_precision(grid, [*keys, "category"], score="s").groupBy(*keys).agg(F.avg("ap").alias("macro_ap"))


def best_blends(grid: DataFrame) -> DataFrame:
    """Of each scheme the weights of greatest macro AP, ties to smaller weights."""
    best = grid.groupBy("scheme").agg(F.max(F.struct(F.round("macro_ap", 9).alias("m"), (-F.col("weight_b")).alias("b"), (-F.col("weight_c")).alias("c"))).alias("x"))
    return best.select("scheme", (-F.col("x.b")).alias("weight_b"), (-F.col("x.c")).alias("weight_c"), F.col("x.m").alias("macro_ap"))
