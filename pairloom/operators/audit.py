"""Predicates with reasons, validity checks, data-set audits and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(x: Column, edges: list[float], labels: list[str], right_closed: bool = False) -> Column:
    """The label of the bin that x falls into: left-closed (or right-closed) between edges, the last label beyond."""
    out = None
    for edge, label in zip(edges, labels):
        hit = x <= edge if right_closed else x < edge
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(labels[-1])


def side_state(match: Column, conflict: Column, missing: Column) -> Column:
    return F.when(match, "match").when(conflict, "conflict").when(missing, "missing").otherwise("neutral")


def signature(flags: list[tuple[Column, str]], none: str = "none") -> Column:
    """Names of the flags that hold, in order, joined by '+'."""
    joined = F.concat_ws("+", *(F.when(c, F.lit(n)) for c, n in flags))
    return F.when(joined == "", none).otherwise(joined)


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """Array of the names of the rules that hold."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in rules)), lambda x: x.isNotNull())


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """An indicator for each listed value; unknown values and nulls have none."""
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}={v}") for v in values))


def leaking_columns(columns: list[str], allowed: set[str], words: tuple[str, ...] = ("target", "label", "fold", "split")) -> list[str]:
    """Feature names that could carry the label."""
    return sorted(c for c in columns if c not in allowed and any(w in c.lower() for w in words))


def prediction_faults(df: DataFrame) -> DataFrame:
    """For each category what is wrong with its predictions: labels, range, finiteness, a class missing."""
    s, y = F.col("score"), F.col("target")
    bad_label, bad_score = F.count_if(~y.isin(0, 1) | y.isNull()), F.count_if(s.isNull() | F.isnan(s) | (s < 0) | (s > 1))
    out = df.groupBy("category").agg(bad_label.alias("bad_labels"), bad_score.alias("bad_scores"), F.count_distinct(F.when(y.isin(0, 1), y)).alias("classes"))
    return out.withColumn("valid", (F.col("bad_labels") == 0) & (F.col("bad_scores") == 0) & (F.col("classes") == 2))


def anchored(df: DataFrame, keys: list[str], share: float, order: list) -> DataFrame:
    """Of each group, the given share of rows in order, at least one."""
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("__k"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).join(F.broadcast(sizes), keys).filter("__r <= __k").drop("__r", "__k")


def capped(df: DataFrame, keys: list[str], cap: int, order: list) -> DataFrame:
    """At most ``cap`` rows of each signature."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= cap).drop("__r")


def stable_slices(metrics: DataFrame, split: str, slice_: str, gain: str, splits: int) -> DataFrame:
    """Slices whose gain has one sign in all splits."""
    g = metrics.groupBy(slice_).agg(F.count_distinct(split).alias("splits"), F.min(gain).alias("low"), F.max(gain).alias("high"))
    return g.withColumn("stable", (F.col("splits") == splits) & ((F.col("low") > 0) | (F.col("high") < 0)))


def supplement(weak: DataFrame, plan: DataFrame, order: list) -> DataFrame:
    """Rows of weak labels that a balance plan (category, target, needed) asks for, most confident first."""
    ranked = weak.withColumn("__r", F.row_number().over(Window.partitionBy("category", "target").orderBy(*order)))
    return ranked.join(F.broadcast(plan), ["category", "target"]).filter("__r <= needed").drop("__r", "needed")


def ngram_error_rates(df: DataFrame, grams: str, error: str, support: int) -> DataFrame:
    """Error rate and lift of the n-grams (array column) of at least that support, each counted once a row."""
    base = df.agg(F.avg(error).alias("base"))
    rows = df.select(error, F.explode(F.array_distinct(grams)).alias("gram"))
    out = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("support"), F.sum(error).alias("errors")).filter(F.col("support") >= support)
    return out.join(F.broadcast(base)).select("gram", "support", "errors", (F.col("errors") / F.col("support")).alias("rate"), (F.col("errors") / F.col("support") / F.col("base")).alias("lift"))


def resolve_aliases(aliases: DataFrame, rounds: int = 32) -> DataFrame:
    """Follow alias -> name chains to their end (cycles stop at their least member reached)."""
    out = aliases.select("alias", "name")
    for _ in range(rounds):
        hop = out.select(F.col("alias").alias("name"), F.col("name").alias("next"))
        moved = out.join(hop, "name", "left").select("alias", F.coalesce("next", "name").alias("next"), "name")
        if moved.filter("next <> name and next <> alias").isEmpty():
            return out
        out = moved.select("alias", F.when(F.col("next") == F.col("alias"), F.col("name")).otherwise(F.col("next")).alias("name"))
    return out
