"""Resampling statistics with replicates as a column: every draw is a hash of the replicate and the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as me


def draw(seed: str, *keys) -> Column:
    """A uniform number in [0, 1) for a replicate and keys."""
    text = F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") if isinstance(k, str) else k for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def replicated(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))


def macro_ap(df: DataFrame, keys: list[str], score: str, weight: Column | None = None) -> DataFrame:
    ap = me.average_precision(df, [*keys, "category"], score=score, weight=weight)
    return ap.groupBy(*keys).agg(F.avg("ap").alias("macro_ap"))


def permutation_test(pairs: DataFrame, a: str, b: str, n: int, seed: str = "perm") -> DataFrame:
    """Swap two models' scores in whole components, n times; (extreme + 1) / (n + 1) for the difference of macro AP."""
    swap = draw(seed, "replicate", "component_id") < 0.5
    rows = replicated(pairs.select("category", "target", "component_id", a, b), n)
    rows = rows.select("replicate", "category", "target", F.when(swap, F.col(b)).otherwise(F.col(a)).alias("x"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("y"))
    drawn = macro_ap(rows, ["replicate"], "x").join(macro_ap(rows, ["replicate"], "y").withColumnRenamed("macro_ap", "other"), "replicate")
    seen = macro_ap(pairs, [], a).join(macro_ap(pairs, [], b).withColumnRenamed("macro_ap", "other")).select((F.col("macro_ap") - F.col("other")).alias("observed"))
    extreme = drawn.join(F.broadcast(seen)).groupBy("observed").agg(F.count_if(F.abs(F.col("macro_ap") - F.col("other")) >= F.abs("observed")).alias("extreme"))
    return extreme.select(F.round("observed", 9).alias("observed"), ((F.col("extreme") + 1) / (n + 1)).alias("p_value"))


def poisson(u: Column) -> Column:
    """A Poisson(1) count from a uniform draw: the times that a component is in a bootstrap sample."""
    # The cumulative distribution of the Poisson law of mean 1.
    return sum(((u >= c).cast("int") for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))


def component_bootstrap(pairs: DataFrame, a: str, b: str, n: int, seed: str = "boot") -> DataFrame:
    """Percentile interval of the difference of macro AP, whole components drawn with replacement."""
    times = poisson(draw(seed, "replicate", "component_id"))
    rows = replicated(pairs.select("category", "target", "component_id", a, b), n).withColumn("times", times).filter("times > 0")
    one = macro_ap(rows, ["replicate"], a, F.col("times")).join(macro_ap(rows, ["replicate"], b, F.col("times")).withColumnRenamed("macro_ap", "other"), "replicate")
    p = one.agg(F.percentile(F.col("macro_ap") - F.col("other"), [0.025, 0.5, 0.975]).alias("p"), F.count(F.lit(1)).alias("replicates"))
    return p.select(*(F.round(F.col("p")[i], 9).alias(c) for i, c in enumerate(("low", "median", "high"))), "replicates")


def resampled_prevalence(df: DataFrame, keep: float, n: int, seed: str = "neg") -> DataFrame:
    """Macro AP over n draws that keep all positives and a share of the negatives: mean and spread."""
    rows = replicated(df.select("id1", "id2", "category", "target", "score"), n)
    rows = rows.filter((F.col("target") == 1) | (draw(seed, "replicate", "id1", "id2") < keep))
    out = macro_ap(rows, ["replicate"], "score")
    return out.agg(F.round(F.avg("macro_ap"), 9).alias("mean"), F.round(F.stddev_pop("macro_ap"), 9).alias("spread"), F.count(F.lit(1)).alias("repeats"))
