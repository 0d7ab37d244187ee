"""Risk-limited policies: threshold sweeps with Wilson bounds, best states, rule gates, vetoes, portfolios."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm, text as tx
from . import graph as gr, pairs as pr


def risk_states(df: DataFrame, score: str, error: str, side: str = "low", keys: tuple[str, ...] = ()) -> DataFrame:
    """States (keys, boundary, accepted, errors, coverage, risk, ucb) of accepting all rows up to a score from the low side,
    or down to it from the high one; equal scores are accepted together, so that comparing with the boundary is the same as
    a strict threshold at the next number beyond it. Scores are counted before any window; ``error`` is 0 or 1."""
    points = df.groupBy(*keys, F.col(score).alias("boundary")).agg(F.count(F.lit(1)).alias("n"), F.sum(error).cast("long").alias("e"))
    order = F.col("boundary").asc() if side == "low" else F.col("boundary").desc()
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    states = points.select(*keys, "boundary", F.sum("n").over(window).alias("accepted"), F.sum("e").over(window).alias("errors"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    accepted, errors = F.col("accepted"), F.col("errors")
    return states.select(*keys, "boundary", "accepted", "errors", (accepted / F.col("total")).alias("coverage"), (errors / accepted).alias("risk"), nm.wilson(errors, accepted, upper=True).alias("ucb"))


def best_states(states: DataFrame, limit: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Of each key's states the one that accepts most (then errs least) with its bound strictly below the limit; keys without
    one have the empty state, whose boundary is null."""
    good = F.when(F.col("ucb") < limit, F.struct("accepted", (-F.col("errors")).alias("less"), "boundary", "ucb"))
    best = states.groupBy(*keys).agg(F.max(good).alias("b"))
    return best.select(*keys, F.col("b.boundary").alias("boundary"), F.coalesce("b.accepted", F.lit(0)).alias("accepted"), F.coalesce(-F.col("b.less"), F.lit(0)).alias("errors"), F.coalesce("b.ucb", F.lit(1.0)).alias("ucb"))


def _longest(states: DataFrame, most: Column, name: str) -> DataFrame:
    """One state for each count of errors up to ``most``: the longest tail; and the empty tail."""
    cut = states.filter(F.col("errors") <= most).groupBy("errors").agg(F.max(F.struct("accepted", "boundary")).alias("b"))
    cut = cut.select("errors", "b.accepted", "b.boundary")
    none = states.sparkSession.range(1).select(F.lit(0).cast("long").alias("errors"), F.lit(0).cast("long").alias("accepted"), F.lit(None).cast("double").alias("boundary"))
    every = cut.unionByName(none).groupBy("errors").agg(F.max(F.struct("accepted", "boundary")).alias("b"))
    return every.select(F.col("errors").alias(f"{name}_errors"), F.col("b.accepted").alias(f"{name}_accepted"), F.col("b.boundary").alias(f"{name}_boundary"))


def best_two_tails(first: DataFrame, second: DataFrame, limit: float, total: int) -> DataFrame:
    """The pair of tails that together accept most rows (then err least, then of the fewest errors in the first) with their
    joint Wilson bound strictly below the limit: one row, of zeros where none qualifies. The bound exceeds the plain rate,
    so no tail has more than limit * total errors, and of tails with equal errors only the longest can win; both sides are
    cut to those, one row an error count, before they meet."""
    most = max(0, math.ceil(limit * total))
    a, b = _longest(first, F.lit(most), "first"), _longest(second, F.lit(most), "second")
    both = pr.small(a).join(pr.small(b), F.col("first_errors") + F.col("second_errors") <= most)
    both = both.withColumn("accepted", F.col("first_accepted") + F.col("second_accepted")).withColumn("errors", F.col("first_errors") + F.col("second_errors"))
    both = both.withColumn("ucb", nm.wilson(F.col("errors"), F.col("accepted"), upper=True))
    good = both.filter((F.col("accepted") > 0) & (F.col("accepted") <= total) & (F.col("ucb") < limit))
    rank = F.struct("accepted", (-F.col("errors")).alias("less"), (-F.col("first_errors")).alias("fewer"), "ucb", "first_boundary", "second_boundary", "first_accepted", "second_accepted")
    best = good.agg(F.max(rank).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return best.select(zero(F.col("b.accepted")).alias("accepted"), zero(-F.col("b.less")).alias("errors"), F.coalesce("b.ucb", F.lit(1.0)).alias("ucb"), "b.first_boundary", "b.second_boundary", zero(F.col("b.first_accepted")).alias("first_accepted"), zero(F.col("b.second_accepted")).alias("second_accepted"))


def cross_fit_thresholds(df: DataFrame, score: str, error: str, fold: str, limit: float, segments: tuple[str, ...] = ()) -> DataFrame:
    """For each fold (and segment) the best state of the other folds' rows: (fold, segments, boundary, accepted, errors, ucb)."""
    points = df.groupBy(fold, *segments, score, error).agg(F.count(F.lit(1)).alias("n"))
    held = pr.small(df.select(F.col(fold).alias("__held")).distinct())
    rest = points.join(held, F.col(fold) != F.col("__held"))
    counts = rest.groupBy("__held", *segments, F.col(score).alias("boundary")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col(error)).alias("e"))
    keys = ("__held", *segments)
    window = Window.partitionBy(*keys).orderBy("boundary").rowsBetween(Window.unboundedPreceding, 0)
    states = counts.select(*keys, "boundary", F.sum("n").over(window).alias("accepted"), F.sum("e").over(window).alias("errors"))
    states = states.withColumn("ucb", nm.wilson(F.col("errors"), F.col("accepted"), upper=True))
    return best_states(states, limit, keys).withColumnRenamed("__held", fold)


def cross_fit_routing(df: DataFrame, score: str, error: str, fold: str, limit: float, segments: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``routed``: whether the row's score is within the tail that the other folds allow."""
    limits = cross_fit_thresholds(df, score, error, fold, limit, segments).select(fold, *segments, F.col("boundary").alias("__limit"))
    out = df.join(pr.small(limits), [fold, *segments], "left")
    return out.withColumn("routed", F.coalesce(F.col(score) <= F.col("__limit"), F.lit(False))).drop("__limit")


def cross_fit_two_classes(df: DataFrame, score: str, error: str, positive: str, fold: str, limit: float) -> DataFrame:
    """``df`` with ``routed`` by two low tails of the error score, one of each predicted class, under one joint bound; a few
    folds, each fitted on the others."""
    out = None
    for r in df.select(fold).distinct().orderBy(fold).collect():  # the folds
        rest, own = df.filter(F.col(fold) != r[0]), df.filter(F.col(fold) == r[0])
        tails = [risk_states(rest.filter(F.col(positive) == c), score, error) for c in (0, 1)]
        best = best_two_tails(*tails, limit, rest.count()).select("first_boundary", "second_boundary")
        bound = F.when(F.col(positive) == 0, F.col("first_boundary")).otherwise(F.col("second_boundary"))
        part = own.join(F.broadcast(best)).withColumn("routed", F.coalesce(F.col(score) <= bound, F.lit(False))).drop("first_boundary", "second_boundary")  # one row
        out = part if out is None else out.unionByName(part)
    return out


def routing_summary(df: DataFrame, routed: str, error: str, limit: float) -> DataFrame:
    """Accepted rows, errors among them, coverage, the Wilson bound, and whether that is below the limit: one row."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(routed)).alias("accepted"), F.sum(F.when(F.col(routed), F.col(error)).otherwise(0)).cast("long").alias("errors"))
    bound = F.when(F.col("accepted") > 0, nm.wilson(F.col("errors"), F.col("accepted"), upper=True)).otherwise(1.0)
    out = sums.select("accepted", "errors", F.coalesce(F.try_divide("accepted", "n"), F.lit(0.0)).alias("coverage"), F.coalesce(F.try_divide("errors", "accepted"), F.lit(0.0)).alias("risk"), bound.alias("ucb"))
    return out.withColumn("passes", (F.col("accepted") > 0) & (F.col("ucb") < limit))


# Word parts that put a concept into a domain, in the order in which domains are tried.
DOMAINS = {
    "optical": ("optical", "lens", "pupillary", "diopter", "cylinder", "axis", "bridge", "temple", "frame"),
    "technology": ("chipset", "processor", "gpu", "video_memory", "ram_", "ram_capacity", "ram_type", "storage", "ssd", "hdd", "memory_capacity", "screen_resolution"),
    "quantity": ("volume", "weight", "package_quantity", "pack_count", "dosage", "dose", "concentration", "tablet_count", "capsule_count", "serving_count"),
    "dimensions": ("width", "height", "length", "diameter", "thickness", "dimensions"),
    "identifier": ("model_number", "model_name", "manufacturer_part_number", "sku", "mpn", "product_line"),
}


def domain_of(concept: Column) -> Column:
    """The domain of a concept, or null."""
    name = F.translate(F.lower(concept), "- ", "__")
    hits = [(d, reduce(lambda a, b: a | b, (name.contains(p) for p in parts))) for d, parts in DOMAINS.items()]
    hits = [(d, h & ~name.contains("package") if d == "dimensions" else h) for d, h in hits]
    return reduce(lambda c, x: c.when(x[1], x[0]), hits[1:], F.when(hits[0][1], hits[0][0]))


def anchors(title_token_set: Column) -> dict[str, Column]:
    """The anchor conditions over typed features and a token-set similarity of the titles (0 to 1)."""
    return {
        "same_brand": F.col("brand_match") > 0, "same_model": F.col("model_code_match") > 0, "same_title_code": F.col("title_code_match") > 0, "title_sim_085": title_token_set >= 0.85,
        "title_sim_095": title_token_set >= 0.95, "exact_title": F.col("title_exact") > 0, "title_code_confirms_conflict": F.col("title_code_conflict") > 0,
    }


def with_gates(features: DataFrame, title_token_set: Column, category: str = "category_of_items", fired: str = "fired_rules") -> DataFrame:
    """Add ``gates``: the names of all gates that a pair fires. Rules fire alone, in their category and under each anchor;
    compounds count different values a domain (two, three or more), and join two domains, as a whole and in the category.
    Labels play no part."""
    some = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in anchors(title_token_set).items())))
    cat = F.coalesce(F.col(category), F.lit(""))
    # Bound, not named as columns: filters on the gates are pushed below projections, which writes out every use of a column.

    def gates(fired: Column, named: Column) -> Column:
        rules = F.transform(fired, lambda r: F.regexp_replace(r, r"\|", "::"))
        concepts = F.transform(F.filter(fired, lambda r: r.endswith("|different_value")), lambda r: F.substring_index(r, "|", 1))
        return tx.let(rules, lambda rs: F.concat(
            F.transform(rs, lambda r: F.concat(F.lit("global::"), r)), F.transform(rs, lambda r: F.concat(F.lit("category::"), cat, F.lit("::"), r)),
            F.flatten(F.transform(named, lambda a: F.transform(rs, lambda r: F.concat(F.lit("anchor::"), a, F.lit("::"), r)))),
            tx.let(concepts, lambda cs: tx.let(F.array_compact(F.transform(cs, domain_of)), lambda ds: tx.let(_compounds(cs, ds), lambda ks: F.concat(
                F.transform(ks, lambda c: F.concat(F.lit("compound::global::::"), c)), F.transform(ks, lambda c: F.concat(F.lit("compound::category::"), cat, F.lit("::"), c)))))),
        ))

    return features.withColumn("gates", tx.let(F.col(fired), lambda f: tx.let(some, lambda named: gates(f, named))))


def _compounds(concepts: Column, domains: Column) -> Column:
    """Names of the compounds that hold for the concepts of a pair's different values, and their domains."""
    count = lambda d: F.size(F.filter(domains, lambda x: x == d))
    compound = [F.when(count(d) >= n, f"{d}_ge{n}") for d in DOMAINS for n in (2, 3)]
    compound.append(F.when((count("identifier") >= 1) & (count("technology") >= 1), "identifier_and_technology"))
    compound.append(F.when(F.exists(concepts, lambda c: F.lower(c).contains("pupillary")) & (count("optical") >= 2), "pupillary_and_other_optical"))
    return F.array_compact(F.array(*compound))


def vetoes(title_token_set: Column) -> dict[str, Column]:
    """Evidence that keeps a pair from being rejected: none; a strong identity without a decisive conflict; that, or only a
    weak difference in a regime that tolerates variants."""
    strong = (F.col("title_exact") > 0) | ((title_token_set >= 0.95) & ((F.col("model_code_match") > 0) | (F.col("title_code_match") > 0)))
    decisive = reduce(lambda a, b: a | b, (F.col(c) > 0 for c in ("model_code_conflict", "title_code_conflict", *(f"num_{f}_conflict" for f in ("ram_storage", "power", "optical", "voltage", "frequency", "capacity")))))
    weak = (F.col("matching_regime") == "variant_tolerant") & ((F.col("num_size_conflict") > 0) | (F.col("color_conflict") > 0) | (F.col("material_conflict") > 0))
    return {"none": F.lit(False), "strong_identity": strong & ~decisive, "identity_plus_variant_tolerance": (strong & ~decisive) | (weak & ~decisive)}


def apply_policy(df: DataFrame, threshold: float, veto: Column, gates: list[tuple[str, float]], score: str = "score", gate_col: str = "gates") -> DataFrame:
    """Add ``reason``: why a pair is rejected: its score is below the threshold, else the first of the gates (name, score cap)
    that it fires below the cap; null where it is kept, as vetoed pairs always are."""
    steps = [F.when(F.col(score) < threshold, "score_threshold")] + [F.when(F.array_contains(gate_col, name) & (F.col(score) < cap), name) for name, cap in gates]
    return df.withColumn("reason", F.when(~veto, F.coalesce(*steps)))


def select_portfolio(df: DataFrame, veto_cols: list[str], limit: float, caps: list[float], fractions: list[float], least_support: int, least_folds: int, most_gates: int, score: str = "score", target: str = "target", fold: str = "fold", gate_col: str = "gates") -> dict:
    """The union of a score threshold and gates that accepts most rows (then errs least, then has the fewest gates) on
    calibration rows with its Wilson bound below the limit, chosen greedily: at each step the gate and cap that bring the
    union furthest. Gates must fire on enough rows in enough folds.

    Rows alike in scores, target, fold, vetoes and gates are counted as one; each step is one grouped sum over what the
    union lacks, and only the best candidate's counts reach the driver."""
    every = sorted(caps)
    df = gr.cut(df.select(score, target, fold, *veto_cols, gate_col))
    patterns = df.groupBy(score, target, fold, *veto_cols, F.array_sort(gate_col).alias("__gates")).agg(F.count(F.lit(1)).alias("__n"))
    patterns = gr.cut(patterns)
    best = {"threshold": None, "veto": "none", "gates": [], "accepted": 0, "errors": 0, "ucb": 1.0}
    try:
        for veto in veto_cols:
            open_ = patterns.filter(~F.col(veto))
            fired = open_.select(score, target, fold, "__n", "__gates", F.explode("__gates").alias("gate"))
            fired = gr.cut(fired.withColumn("cap", F.explode(F.array(*map(F.lit, every)))).filter(F.col(score) < F.col("cap")))
            usable = fired.groupBy("gate", "cap").agg(F.sum("__n").alias("support"), F.count_distinct(fold).alias("folds")).filter((F.col("support") >= least_support) & (F.col("folds") >= least_folds)).select("gate", "cap")
            usable = gr.cut(usable)
            states = risk_states(df.filter(~F.col(veto)), score, target)
            for threshold in _seeds(states, limit, fractions):
                inside = F.lit(False) if threshold is None else F.col(score) <= threshold
                chosen: list[tuple[str, float]] = []
                first = open_.filter(inside).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("__n") * F.col(target)), F.lit(0)).alias("e")).first()
                rows, errors = first.n, first.e
                while len(chosen) < most_gates:
                    taken = reduce(lambda a, g: a | (F.array_contains("__gates", g[0]) & (F.col(score) < g[1])), chosen, inside)
                    more = fired.filter(~taken).groupBy("gate", "cap").agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col(target)).alias("e")).join(usable, ["gate", "cap"])
                    union = more.select("gate", "cap", (F.col("n") + rows).alias("n"), (F.col("e") + errors).alias("e")).withColumn("ucb", nm.wilson(F.col("e"), F.col("n"), upper=True))
                    top = union.filter(F.col("ucb") < limit).orderBy(F.desc("n"), "e", "cap", "gate").first()
                    if top is None:
                        break
                    chosen.append((top.gate, top.cap))
                    rows, errors = top.n, top.e
                if (rows, -errors, -len(chosen)) > (best["accepted"], -best["errors"], -len(best["gates"])):
                    best = {"threshold": threshold, "veto": veto, "gates": chosen, "accepted": int(rows), "errors": int(errors), "ucb": _wilson_upper(errors, rows)}
            gr.drop(fired, usable)
    finally:
        gr.drop(df, patterns)
    return best


def _seeds(states: DataFrame, limit: float, fractions: list[float]) -> list[float | None]:
    """Boundaries to start from: none, the longest safe tail, and the first safe tails of these shares of its rows."""
    safe = states.filter(F.col("ucb") < limit)
    most = safe.agg(F.max("accepted").alias("a")).first().a
    if most is None:
        return [None]
    wanted = [F.min(F.when(F.col("accepted") >= int(most * f), F.col("boundary"))) for f in [*fractions, 1.0]]
    return [None, *sorted(set(safe.agg(*(w.alias(f"s{i}") for i, w in enumerate(wanted))).first()))]


def _wilson_upper(errors: float, n: float) -> float:
    z, p = nm.Z95, errors / n
    return (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
