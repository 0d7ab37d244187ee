"""Rule statistics over a long table of occurrences (id1, id2, target, category, rule[, fold])."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as nm


def rule_counts(occurrences: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return occurrences.groupBy(*(keys or []), "rule").agg(F.count(F.lit(1)).alias("support"), F.sum("target").alias("positives"))


def holm(tests: DataFrame, p: str, name: str) -> DataFrame:
    """Step-down adjusted p-values: the running maximum of p times the tests not yet passed."""
    order = Window.orderBy(p, name)
    left = F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1
    return tests.withColumn("__a", F.col(p) * left).withColumn("adjusted", F.least(F.lit(1.0), F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__a")


def benjamini_hochberg(tests: DataFrame, p: str, name: str) -> DataFrame:
    """q-values: the running minimum, from the largest p down, of p times tests over rank."""
    q = F.col(p) * F.count(F.lit(1)).over(Window.partitionBy()) / F.row_number().over(Window.orderBy(p, name))
    down = Window.orderBy(F.desc(p), F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("__q", q).withColumn("q", F.least(F.lit(1.0), F.min("__q").over(down))).drop("__q")


def hypergeometric_tail(k: int, support: int, positives: int, total: int) -> float:
    """P(at least k positives among ``support`` draws of ``total`` rows with ``positives``)."""

    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    whole = choose(total, support)
    low, high = max(k, support - (total - positives)), min(support, positives)
    return min(1.0, math.fsum(math.exp(choose(positives, i) + choose(total - positives, support - i) - whole) for i in range(low, high + 1)))


def fisher_in(counts: DataFrame) -> DataFrame:
    """Add p_value to rules (support, positives, and __n pairs with __p positives in all); one short row a rule."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = [hypergeometric_tail(*map(int, x)) for x in zip(f["positives"], f["support"], f["__p"], f["__n"])]
            yield f.assign(p_value=values)

    return counts.mapInPandas(run, T.StructType([*counts.schema.fields, T.StructField("p_value", T.DoubleType())]))


def fisher(counts: DataFrame) -> DataFrame:
    """One-sided exact test of each rule's positives against all occurrences."""
    whole = counts.agg(F.sum("support").alias("__n"), F.sum("positives").alias("__p"))
    return fisher_in(counts.join(F.broadcast(whole))).drop("__n", "__p")  # one row


def target_encoding(occurrences: DataFrame, fold: str | None, smooth: float = 1.0) -> DataFrame:
    """The mean over a pair's rules of the smoothed log odds of each rule, without the pair itself, or without its fold.
    Rules that then have no row left don't count. Totals are aggregated and joined back, so no rule's rows meet."""
    total = occurrences.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("pos"))
    rows = occurrences.join(total, "rule")
    if fold:
        own = occurrences.groupBy("rule", fold).agg(F.count(F.lit(1)).alias("own_n"), F.sum("target").alias("own_pos"))
        rows = rows.join(own, ["rule", fold])
    else:
        rows = rows.withColumn("own_n", F.lit(1)).withColumn("own_pos", F.col("target"))
    n, pos = F.col("n") - F.col("own_n"), F.col("pos") - F.col("own_pos")
    odds = F.log((pos + smooth) / (n - pos + smooth))
    return rows.filter(n > 0).groupBy("id1", "id2").agg(F.avg(odds).alias("encoded"))


def co_occurring(occurrences: DataFrame) -> DataFrame:
    """Pairs of rules that hold together, and for how many pairs; rules of a pair are gathered (a pair has few)."""
    sets = occurrences.groupBy("id1", "id2").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    each = sets.select("rules", F.posexplode("rules").alias("i", "rule_a"))
    both = each.select("rule_a", F.explode(F.slice("rules", F.col("i") + 2, F.size("rules"))).alias("rule_b"))
    return both.groupBy("rule_a", "rule_b").agg(F.count(F.lit(1)).alias("pairs"))


def gate_sweep(counts: DataFrame, supports: list[int], bound: float) -> DataFrame:
    """How many rules of at least each support have a Wilson lower bound of at least ``bound``."""
    good = counts.filter(nm.wilson(F.col("positives"), F.col("support")) >= bound)
    rows = good.select(F.explode(F.filter(F.array(*map(F.lit, supports)), lambda s: F.col("support") >= s)).alias("min_support"))
    return rows.groupBy("min_support").agg(F.count(F.lit(1)).alias("rules"))


def shrunk_effects(effects: DataFrame, value: str, variance: str, key: str) -> DataFrame:
    """Empirical-Bayes shrinkage of effects towards their weighted mean; between-group variance by moments."""
    w = 1 / F.col(variance)
    sums = effects.agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * F.col(value)).alias("swx"), F.sum(w * F.col(value) * F.col(value)).alias("swx2"), F.count(F.lit(1)).alias("k"))
    q = F.col("swx2") - F.col("swx") * F.col("swx") / F.col("sw")
    tau = F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / F.nullif(F.col("sw") - F.col("sw2") / F.col("sw"), F.lit(0.0)))
    rows = effects.join(F.broadcast(sums.select((F.col("swx") / F.col("sw")).alias("centre"), F.coalesce(tau, F.lit(0.0)).alias("tau"))))
    keep = F.col("tau") / (F.col("tau") + F.col(variance))
    return rows.select(key, value, (F.col("centre") + keep * (F.col(value) - F.col("centre"))).alias("shrunk"))


def rule_table(occurrences: DataFrame) -> DataFrame:
    """For each rule: support, positives, rate, the rate over all pairs, both Wilson bounds, Fisher's one-sided p for more
    positives than among the other pairs, and its q-value over all rules."""
    base = occurrences.select("id1", "id2", "target").distinct().agg(F.count(F.lit(1)).alias("__n"), F.sum("target").alias("__p"))
    counts = rule_counts(occurrences).join(F.broadcast(base))  # one row
    tested = fisher_in(counts).withColumn("rate", F.col("positives") / F.col("support")).withColumn("baseline", F.col("__p") / F.col("__n"))
    tested = tested.withColumn("lower", nm.wilson(F.col("positives"), F.col("support"))).withColumn("upper", nm.wilson(F.col("positives"), F.col("support"), upper=True))
    return benjamini_hochberg(tested, "p_value", "rule").withColumnRenamed("q", "q_value").drop("__n", "__p")
