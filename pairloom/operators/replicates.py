"""Replicated average precision: permutations and bootstraps with thousands of replicates over one pass of the pairs.

A replicate only changes the weights with which a pair counts at its scores. So every batch of pairs adds up, for each
category and distinct score, a vector of weights with one place a replicate; the vectors are summed by category, and there
the curve of all replicates is run down at once. Nothing is exploded, and what is shuffled grows with distinct scores, not
with pairs times replicates.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Replicates whose weights are held together.
BLOCK = 125
U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def draws(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) for every key and replicate; the same wherever and however often they are drawn."""
    at = _mixed(keys.astype(np.int64).view(U64)[:, None] * U64(0x9E3779B97F4A7C15) + _mixed(replicates.astype(U64) + U64(seed * 2 + 1))[None, :])
    return (at >> U64(11)).astype(np.float64) / float(1 << 53)


def replicate_ap(rows: DataFrame, n: int, weigh: Callable[[pd.DataFrame, np.ndarray], list[tuple[str, np.ndarray]]], models: int, first: int = 0) -> DataFrame:
    """(category, replicate, ap_0, ..) of ``n`` replicates from number ``first`` on. ``weigh(rows, replicates)`` gives for each
    model pairs (score column, weights rows x replicates) that count; ``rows`` has category and target. Categories without
    positive weight have null."""
    blocks = [np.arange(lo, min(lo + BLOCK, first + n)) for lo in range(first, first + n, BLOCK)]
    schema = "category string, block int, model int, score double, positive binary, weight binary"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            target = f["target"].to_numpy(np.float64)[:, None]
            category = f["category"].fillna("").astype(str)
            for k, replicates in enumerate(blocks):
                for model, parts in enumerate(weigh(f, replicates)):
                    codes, names = pd.factorize(pd.MultiIndex.from_arrays([np.concatenate([category] * len(parts)), np.concatenate([f[c].to_numpy(np.float64) for c, _ in parts])]))
                    weights = np.concatenate([w for _, w in parts])
                    order = np.argsort(codes, kind="stable")
                    starts = np.searchsorted(codes[order], np.arange(len(names)))
                    total = np.add.reduceat(weights[order], starts, axis=0)
                    positive = np.add.reduceat((weights * np.concatenate([target] * len(parts)))[order], starts, axis=0)
                    yield pd.DataFrame({
                        "category": [c for c, _ in names], "block": k, "model": model, "score": [s for _, s in names],
                        "positive": [r.tobytes() for r in positive], "weight": [r.tobytes() for r in total],
                    })

    def down(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        replicates = blocks[key[1]]
        out = {"category": key[0], "replicate": replicates}
        for model in range(models):
            g = f[f["model"] == model].sort_values("score", ascending=False)
            p = np.frombuffer(b"".join(g["positive"])).reshape(-1, len(replicates))
            w = np.frombuffer(b"".join(g["weight"])).reshape(-1, len(replicates))
            scores = g["score"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], scores[1:] != scores[:-1])))
            p, w = np.add.reduceat(p, starts, axis=0), np.add.reduceat(w, starts, axis=0)
            found, seen = np.cumsum(p, axis=0), np.cumsum(w, axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                gained = np.where(p > 0, p * found / np.maximum(seen, 1e-300), 0.0).sum(0)
                out[f"ap_{model}"] = np.where(found[-1] > 0, gained / found[-1], np.nan)
        return pd.DataFrame(out)

    sums = rows.mapInPandas(add, schema)
    aps = ", ".join(f"ap_{m} double" for m in range(models))
    return sums.groupBy("category", "block").applyInPandas(down, f"category string, replicate int, {aps}")


def macro(replicated: DataFrame, models: int) -> DataFrame:
    """(replicate, macro_0, ..): the mean over categories; null where any category has no positive weight."""
    whole = lambda m: F.when(F.count(f"ap_{m}") == F.count(F.lit(1)), F.avg(f"ap_{m}"))
    return replicated.groupBy("replicate").agg(*(whole(m).alias(f"macro_{m}") for m in range(models)))


def permutation_test(pairs: DataFrame, a: str, b: str, n: int = 2000, seed: int = 1) -> DataFrame:
    """Paired test of the difference of macro AP (one row: observed, p_value): two models' scores are swapped in whole
    components, ``n`` times; p is (as extreme + 1) / (n + 1). Replicate 0 is the observed one."""
    rows = pairs.select("category", "target", "component_id", F.col(a).alias("x"), F.col(b).alias("y"))

    def weigh(f: pd.DataFrame, replicates: np.ndarray) -> list:
        swap = (draws(f["component_id"].to_numpy(), replicates, seed) < 0.5) & (replicates > 0)
        swapped = swap.astype(np.float64)
        return [[("x", 1.0 - swapped), ("y", swapped)], [("y", 1.0 - swapped), ("x", swapped)]]

    delta = macro(replicate_ap(rows, n + 1, weigh, 2), 2).select("replicate", (F.col("macro_0") - F.col("macro_1")).alias("delta"))
    seen = delta.filter("replicate = 0").select(F.col("delta").alias("observed"))
    both = delta.filter("replicate > 0").join(F.broadcast(seen))  # one row
    return both.groupBy("observed").agg(((F.count_if(F.abs("delta") >= F.abs("observed") - 1e-12) + 1) / (n + 1)).alias("p_value"))


def drawn_times(units: DataFrame, stratum: list[str], n: int, seed: int, first: int = 0, size: Column | None = None) -> DataFrame:
    """(unit, times): how often each unit is drawn in each replicate (16-bit counts as bytes), if every stratum draws as many
    of its units, with replacement, as it has (or ``size``, by stratum). A stratum's units, one short row each, are drawn
    in one task."""
    sized = units.select("unit", *stratum, (size if size is not None else F.lit(-1)).cast("long").alias("size"))

    def draw(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("unit")
        k = len(f)
        m = int(f["size"].iloc[0]) if f["size"].iloc[0] >= 0 else k
        name = _name(key)
        times = np.empty((n, k), np.uint16)
        for r in range(n):
            rng = np.random.Generator(np.random.PCG64([seed, first + r, name]))
            times[r] = np.bincount(rng.integers(0, k, m), minlength=k)
        return pd.DataFrame({"unit": f["unit"], "times": [row.tobytes() for row in np.ascontiguousarray(times.T)]})

    return sized.groupBy(*stratum).applyInPandas(draw, "unit long, times binary")


def _name(key: tuple) -> int:
    """A number for a stratum's key, the same in every process."""
    return zlib.crc32(repr(tuple(map(str, key))).encode())


def _times(f: pd.DataFrame, replicates: np.ndarray, first: int, n: int) -> np.ndarray:
    all_ = np.frombuffer(b"".join(f["times"]), np.uint16).reshape(-1, n)
    return all_[:, replicates - first].astype(np.float64)


def interval(delta: DataFrame) -> DataFrame:
    """mean, low, median, high (2.5, 50 and 97.5 %), share above zero, replicates of the values in ``delta``."""
    p = delta.agg(F.avg("delta").alias("mean"), F.percentile("delta", [0.025, 0.5, 0.975]).alias("p"), F.avg((F.col("delta") > 0).cast("double")).alias("positive_share"), F.count("delta").alias("replicates"))
    return p.select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("median"), F.col("p")[2].alias("high"), "positive_share", "replicates")


def bootstrap(pairs: DataFrame, a: str, b: str, unit: str, stratum: list[str], n: int = 2000, seed: int = 2, retries: int = 20) -> DataFrame:
    """Interval of the difference of macro AP when units (components, or pairs) are drawn with replacement within strata.
    Replicates in which a category lacks positives are drawn again, up to ``retries`` times ``n`` in all."""
    rows = pairs.select("category", "target", F.col(unit).alias("unit"), *(F.col(c) for c in stratum if c not in ("category", "target")), F.col(a).alias("x"), F.col(b).alias("y"))
    units = rows.groupBy("unit").agg(*(F.min(c).alias(c) for c in stratum))
    good, first, parts = 0, 0, None
    while good < n and first < retries * n:
        k = max(BLOCK, n - good) if first else n
        drawn = drawn_times(units, stratum, k, seed, first)
        counted = rows.join(drawn, "unit").select("category", "target", "x", "y", "times")

        def weigh(f: pd.DataFrame, replicates: np.ndarray, first: int = first, k: int = k) -> list:
            t = _times(f, replicates, first, k)
            return [[("x", t)], [("y", t)]]

        made = macro(replicate_ap(counted, k, weigh, 2, first), 2).select((F.col("macro_0") - F.col("macro_1")).alias("delta"), "replicate")
        made = made.filter("delta is not null").cache()
        good, first = good + made.count(), first + k
        parts = made if parts is None else parts.unionByName(made)
    if good < n:
        raise ValueError("too few samples in which every category has positives")
    return interval(parts.orderBy("replicate").limit(n))


def category_bootstrap(deltas: list[float], n: int, seed: int = 3) -> dict[str, float]:
    """Interval of the mean of a few categories' differences, categories drawn with replacement."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x = np.array(deltas)
    means = x[rng.integers(0, len(x), (n, len(x)))].mean(1)
    low, median, high = np.quantile(means, [0.025, 0.5, 0.975])
    return {"mean": float(means.mean()), "low": float(low), "median": float(median), "high": float(high), "positive_share": float((means > 0).mean()), "replicates": n}


def resampled_negatives(df: DataFrame, prevalence: float, repeats: int = 30, seed: int = 4) -> DataFrame:
    """Macro AP when every positive stays once and each category draws its negatives with replacement, as many as bring the
    whole to ``prevalence`` (weight times its negatives, rounded, at least one): mean, spread (n - 1), repeats, and the macro
    AP that the constant weight itself gives."""
    sums = df.agg(F.sum("target").alias("p"), F.sum(1 - F.col("target")).alias("n")).first()
    weight = sums.p * (1 - prevalence) / (prevalence * sums.n)
    rows = df.select("category", "target", "score", F.xxhash64("id1", "id2").alias("unit"))
    negatives = rows.filter("target = 0")
    sizes = negatives.groupBy("category").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) * weight)).alias("m"))
    drawn = drawn_times(negatives.join(F.broadcast(sizes), "category"), ["category"], repeats, seed, 0, F.col("m"))  # one row a category
    counted = rows.join(drawn, "unit", "left")

    def weigh(f: pd.DataFrame, replicates: np.ndarray) -> list:
        blank = np.zeros(repeats, np.uint16).tobytes()
        t = _times(f.assign(times=[x if x is not None else blank for x in f["times"]]), replicates, 0, repeats)
        one = f["target"].to_numpy()[:, None] == 1
        return [[("score", np.where(one, 1.0, t))], [("score", np.where(one, 1.0, weight) + 0 * t)]]

    out = macro(replicate_ap(counted, repeats, weigh, 2), 2)
    return out.agg(F.avg("macro_0").alias("mean"), F.stddev_samp("macro_0").alias("spread"), F.avg("macro_1").alias("weighted"), F.count("macro_0").alias("repeats"))


def beta_effects(rules: DataFrame, draws_: int = 4000, seed: int = 5) -> DataFrame:
    """Posterior of the log-odds effect of rules (rule, positive, negative, baseline_positive, baseline_negative) under
    Jeffreys priors: mean, median, 95 % interval, spread, and the probability of either sign."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                rng = np.random.Generator(np.random.PCG64([seed, _name((r.rule,))]))
                p, q = (rng.beta(x + 0.5, y + 0.5, draws_) for x, y in ((r.positive, r.negative), (r.baseline_positive, r.baseline_negative)))
                effect = np.log(p / (1 - p)) - np.log(q / (1 - q))
                low, median, high = np.quantile(effect, [0.025, 0.5, 0.975])
                rows.append((r.rule, effect.mean(), median, low, high, effect.std(ddof=1), (effect > 0).mean(), (effect < 0).mean()))
            yield pd.DataFrame(rows, columns=["rule", "effect", "median", "low", "high", "spread", "above", "below"])

    columns = ("rule", "positive", "negative", "baseline_positive", "baseline_negative")
    return rules.select(*columns).mapInPandas(one, "rule string, effect double, median double, low double, high double, spread double, above double, below double")
