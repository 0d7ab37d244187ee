"""Ranking metrics over grouped curves: equal scores are one point, whatever the order of rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from . import pairs as pr


def curve(df: DataFrame, keys: list[str], score: str = "score", target: str = "target", weight: Column | None = None) -> DataFrame:
    """For each group and distinct score (descending): weight, positive weight, their running sums and totals."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    points = df.groupBy(*keys, F.col(score).alias("at")).agg(F.sum(w).alias("w"), F.sum(w * F.col(target)).alias("p"))
    down = Window.partitionBy(*keys).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return points.select("*", F.sum("w").over(down).alias("cw"), F.sum("p").over(down).alias("cp"), F.sum("w").over(whole).alias("tw"), F.sum("p").over(whole).alias("tp"))


def average_precision(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """ap by group; null where no positive weight is."""
    points = curve(df, keys, **options)
    return points.groupBy(*keys).agg((F.sum(F.col("p") * F.col("cp") / F.col("cw")) / F.nullif(F.first("tp"), F.lit(0.0))).alias("ap"))


def roc_auc(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """auc by group, ties counted half; null where a class is missing."""
    points = curve(df, keys, **options)
    negatives = F.col("w") - F.col("p")
    above = F.col("cp") - F.col("p") / 2
    return points.groupBy(*keys).agg((F.sum(negatives * above) / F.nullif(F.first("tp") * (F.first("tw") - F.first("tp")), F.lit(0.0))).alias("auc"))


def macro(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias(f"macro_{value}"), F.count(value).alias("groups"))


def recall_at_precision(df: DataFrame, keys: list[str], precision: float, **options) -> DataFrame:
    """The greatest recall at that precision, and the lowest threshold that reaches it (0 and null if none does)."""
    points = curve(df, keys, **options).withColumn("recall", F.col("cp") / F.nullif(F.col("tp"), F.lit(0.0)))
    good = F.when(F.col("cp") / F.col("cw") >= precision, F.struct("recall", (-F.col("at")).alias("neg")))
    best = points.groupBy(*keys).agg(F.max(good).alias("b"))
    return best.select(*keys, F.coalesce(F.col("b.recall"), F.lit(0.0)).alias("recall"), (-F.col("b.neg")).alias("threshold"))


def best_f1(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """The greatest F1 and its lowest threshold."""
    points = curve(df, keys, **options).withColumn("f1", 2 * F.col("cp") / (F.col("cw") + F.col("tp")))
    best = points.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("at")).alias("neg"))).alias("b"))
    return best.select(*keys, F.col("b.f1").alias("f1"), (-F.col("b.neg")).alias("threshold"))


def confusion(df: DataFrame, keys: list[str], threshold: Column, score: str = "score", target: str = "target") -> DataFrame:
    hit, yes = F.col(score) >= threshold, F.col(target) == 1
    out = df.groupBy(*keys).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    ratio = lambda a, b: F.col(a) / F.nullif((F.col(a) + F.col(b)).cast("double"), F.lit(0.0))
    return out.select("*", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"), ratio("tn", "fp").alias("specificity"))


def eligible_metrics(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Macro AP and ROC over the categories that have both labels, the same over all rows, rates of missed positives and
    accepted negatives, mean score of each label: one row."""
    both = df.groupBy("category").agg(F.count_distinct("target").alias("k")).filter("k = 2").select("category")
    rows = df.join(both, "category", "left_semi")
    macros = average_precision(rows, ["category"], score=score).join(roc_auc(rows, ["category"], score=score), "category")
    macros = macros.agg(F.count("ap").alias("eligible_categories"), F.avg("ap").alias("macro_ap"), F.avg("auc").alias("macro_auc"))
    whole = df.withColumn("__one", F.lit(1))
    overall = average_precision(whole, ["__one"], score=score).withColumnRenamed("ap", "overall_ap").join(roc_auc(whole, ["__one"], score=score).withColumnRenamed("auc", "overall_auc"), "__one").drop("__one")
    s, yes = F.col(score), F.col("target") == 1
    rates = df.agg(F.avg(F.when(yes, (s < threshold).cast("int"))).alias("fnr"), F.avg(F.when(~yes, (s >= threshold).cast("int"))).alias("fpr"), F.avg(F.when(yes, s)).alias("positive_mean"), F.avg(F.when(~yes, s)).alias("negative_mean"))
    return macros.join(overall).join(rates)  # one row each


def slice_metrics(rows: DataFrame, keys: list[str], before: str, after: str, least: int, threshold: float = 0.5) -> DataFrame:
    """For each slice of at least ``least`` rows: corrected and regressed decisions, their net rate, gains in log-loss and
    absolute error, and the difference of macro AP (over the categories with positives)."""
    y = F.col("target")
    right = lambda s: (F.col(s) >= threshold).cast("int") == y
    gains = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~right(before) & right(after)).alias("corrected"), F.count_if(right(before) & ~right(after)).alias("regressed"),
        F.avg(nm.log_loss(y, F.col(before)) - nm.log_loss(y, F.col(after))).alias("logloss_gain"), F.avg(F.abs(F.col(before) - y) - F.abs(F.col(after) - y)).alias("mae_gain"),
    )
    aps = [average_precision(rows, [*keys, "category"], score=s).groupBy(*keys).agg(F.avg("ap").alias(n)) for s, n in ((before, "ap_before"), (after, "ap_after"))]
    out = gains.filter(F.col("n") >= least).join(aps[0], keys, "left").join(aps[1], keys, "left")
    return out.withColumn("net_rate", (F.col("corrected") - F.col("regressed")) / F.col("n")).withColumn("macro_ap_delta", F.col("ap_after") - F.col("ap_before"))


def stable_slices(slices: DataFrame, keys: list[str], splits: dict[str, object], least: int) -> DataFrame:
    """Whether each slice is better on each of the named splits (enough rows, gains in log-loss and absolute error, no net
    regressions, no loss of AP where that is known), ``stable`` on the first two, and the lesser of their log-loss gains."""
    good = (F.col("n") >= least) & (F.col("logloss_gain") > 0) & (F.col("mae_gain") > 0) & (F.col("net_rate") >= 0) & (F.col("macro_ap_delta").isNull() | (F.col("macro_ap_delta") > 0))
    of = lambda s, c: F.when(F.col("split") == s, c)
    names = list(splits)
    flags = [F.coalesce(F.bool_or(of(s, good)), F.lit(False)).alias(f"{n}_better") for n, s in splits.items()]
    gains = [F.max(of(splits[n], F.col("logloss_gain"))) for n in names[:2]]
    out = slices.groupBy(*keys).agg(*flags, gains[0].alias("__a"), gains[1].alias("__b"))
    return out.withColumn("stable", F.col(f"{names[0]}_better") & F.col(f"{names[1]}_better")).withColumn("least_gain", F.least("__a", "__b")).drop("__a", "__b")


def prevalence_sweep(df: DataFrame, prevalences: list[float], score: str = "score") -> DataFrame:
    """Macro AP and ROC with negatives weighted so that positives have each prevalence, from one curve of counts."""
    sums = df.agg(F.sum("target").alias("__p"), F.sum(1 - F.col("target")).alias("__n"))
    counts = df.groupBy("category", score, "target").agg(F.count(F.lit(1)).alias("__c"))
    rows = counts.withColumn("prevalence", F.explode(F.array(*map(F.lit, prevalences)))).join(F.broadcast(sums))  # one row
    weight = F.col("__c") * F.when(F.col("target") == 1, 1.0).otherwise(nm.negative_weight(F.col("__p"), F.col("__n"), F.col("prevalence")))
    keys = ["prevalence", "category"]
    both = average_precision(rows, keys, score=score, weight=weight).join(roc_auc(rows, keys, score=score, weight=weight), keys)
    return both.groupBy("prevalence").agg(F.avg("ap").alias("macro_ap"), F.avg("auc").alias("macro_auc"))


def with_priors(df: DataFrame, priors: DataFrame, score: str = "score") -> DataFrame:
    """AP and ROC of each category with negatives weighted to a prior of its own (category, prior)."""
    own = df.groupBy("category").agg(F.avg("target").alias("own_prevalence")).join(priors, "category")
    own = own.withColumn("negative_weight", F.col("own_prevalence") * (1 - F.col("prior")) / (F.col("prior") * (1 - F.col("own_prevalence"))))
    rows = df.join(pr.small(own), "category")
    weight = F.when(F.col("target") == 1, 1.0).otherwise(F.col("negative_weight"))
    ap = average_precision(rows, ["category"], score=score, weight=weight).withColumnRenamed("ap", "weighted_ap")
    return own.join(ap, "category").join(roc_auc(rows, ["category"], score=score, weight=weight).withColumnRenamed("auc", "weighted_auc"), "category")


def agreement(df: DataFrame, models: list[str], threshold: float = 0.5) -> DataFrame:
    """For every two models: rows both get right, both wrong, where they disagree, and the share that either gets right."""
    right = {m: (F.col(m) >= threshold).cast("int") == F.col("target") for m in models}
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    sums = [x for i, (a, b) in enumerate(pairs) for x in (F.count_if(right[a] & right[b]).alias(f"r{i}"), F.count_if(~right[a] & ~right[b]).alias(f"w{i}"), F.count_if(right[a] != right[b]).alias(f"d{i}"))]
    one = df.agg(*sums)
    total = lambda i: F.col(f"r{i}") + F.col(f"w{i}") + F.col(f"d{i}")
    rows = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"r{i}").alias("both_right"), F.col(f"w{i}").alias("both_wrong"), F.col(f"d{i}").alias("disagree"), ((F.col(f"r{i}") + F.col(f"d{i}")) / total(i)).alias("oracle_accuracy")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def ensemble_grid(df: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Macro AP of the mean and the maximum of every combination of models, by split: one unpivoted frame, one curve."""
    combos = [c for n in range(1, len(models) + 1) for c in itertools.combinations(models, n)]
    cells = []
    for c in combos:
        mean = sum((F.col(m) for m in c[1:]), F.col(c[0])) / len(c)
        most = F.greatest(*c) if len(c) > 1 else F.col(c[0])
        cells += [F.struct(F.lit("+".join(c)).alias("combo"), F.lit(k).alias("agg"), F.round(s, 9).alias("s")) for k, s in (("mean", mean), ("max", most))]
    rows = df.select(*keys, "category", "target", F.explode(F.array(*cells)).alias("g")).select(*keys, "category", "target", "g.*")
    ap = average_precision(rows, [*keys, "combo", "agg", "category"], score="s")
    return ap.groupBy(*keys, "combo", "agg").agg(F.avg("ap").alias("macro_ap"))
