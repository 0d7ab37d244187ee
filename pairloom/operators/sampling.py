"""Splits and samples that respect components, strata and quotas; every order is a hash of the rows' keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as gr, pairs as pr, ranking as rk


def order_hash(*keys: str | Column) -> Column:
    return F.md5(F.concat_ws(":", *keys).cast("binary"))


def component_anchors(df: DataFrame, quotas: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of distinct components by quotas of strata: each component stands for its first row, and each stratum takes the
    first ``quota`` of those that it has."""
    first = rk.head(df, ["component_id"], order, 1)
    return gr.sample_by_quota(first, quotas, keys, order)


def components_to_count(sizes: DataFrame, total: int, order: Column) -> DataFrame:
    """(component_id, n) of whole components that a pass in the given order takes: each that still fits into ``total``. All
    up to the first that doesn't fit are taken at once, by running sums; what comes after it and is small enough for the
    rest is passed again, so there are no more rounds than sizes that fail to fit."""
    left, chosen, rest = total, None, sizes.select("component_id", "n", order.alias("__o"))
    rest = gr.cut(rest)
    while left > 0:
        run = rk.running_sum(rest.filter(F.col("n") <= left), "n", ["__o", "component_id"], "__s")
        fits = gr.cut(run)
        stop = fits.filter(F.col("__s") > left).agg(F.min(F.struct("__o", "component_id")).alias("k")).first().k
        here = F.struct("__o", "component_id")
        edge = F.struct(F.lit(stop["__o"]).alias("__o"), F.lit(stop.component_id).alias("component_id")) if stop else None
        taken = fits if stop is None else fits.filter(here < edge)
        part = taken.select("component_id", "n")
        chosen = part if chosen is None else chosen.unionByName(part)
        left -= taken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
        if stop is None:
            break
        rest = fits.filter(here > edge).select("component_id", "n", "__o")
    return chosen if chosen is not None else sizes.select("component_id", "n").limit(0)


def hard_anchors(df: DataFrame, total: int, order: list, error_share: float = 0.4, lexical_share: float = 0.5, keys: tuple[str, ...] = ("category", "target")) -> DataFrame:
    """``total`` rows of distinct components with their ``reason``, from three sources in turn: model errors by wrongness,
    all rows by lexical hardness, all by diagnostic hardness. The strata's quotas are in proportion to their rows and
    shared by the sources; within a source a component stands for its hardest row."""
    counts = [round(total * error_share), round(total * lexical_share)]
    counts.append(total - sum(counts))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    remaining = gr.largest_remainder(sizes, total, list(keys)).select(*keys, "quota")
    chosen = None
    sources = [("model_error", "model_wrongness", F.col("model_is_error")), ("lexical_surprise", "lexical_hardness", F.lit(True)), ("diagnostic", "diagnostic_hardness", F.lit(True))]
    for (reason, score, eligible), count in zip(sources, counts):
        rows = df.filter(eligible)
        if chosen is not None:
            rows = rows.join(chosen.select("component_id"), "component_id", "left_anti")
        hardest = [F.desc(score), *order]
        rows = gr.sample_by_quota(rk.head(rows, ["component_id"], hardest, 1), remaining, list(keys), hardest)
        taken = gr.cut(rows.orderBy(*hardest).limit(count).withColumn("reason", F.lit(reason)).select(*df.columns, "reason"))
        used = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("u"))
        remaining = gr.cut(remaining.join(used, list(keys), "left").select(*keys, (F.col("quota") - F.coalesce("u", F.lit(0))).alias("quota")))
        chosen = taken if chosen is None else chosen.unionByName(taken)
    return chosen


def quota_groups(groups: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """Groups (category, group_id, pairs, positives) for validation, by each category's quota (category, pairs, positives).
    In the order of a hash, a group is taken if that lessens the summed squares of the relative misses in pairs, positives
    and negatives; then single pairs of either label are added or dropped to meet the quota exactly, where there are enough.
    The pass is sequential within a category, over one short row a group."""

    def pick(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        want_p, want_n = int(f["want_positives"].iloc[0]), int(f["want_pairs"].iloc[0] - f["want_positives"].iloc[0])

        def miss(pairs: int, pos: int) -> float:
            parts = ((pairs, want_p + want_n), (pos, want_p), (pairs - pos, want_n))
            return sum(((have - want) / max(1, want)) ** 2 for have, want in parts)

        f = f.sort_values(["order", "group_id"])
        pairs = pos = 0
        now, taken = miss(0, 0), []
        for n, p in zip(f["pairs"], f["positives"]):
            then = miss(pairs + n, pos + p)
            taken.append(then + 1e-15 < now)
            if taken[-1]:
                pairs, pos, now = pairs + n, pos + p, then
        f = f.assign(taken=taken)
        for label, want in ((1, want_p), (0, want_n)):
            single = (f["pairs"] == 1) & (f["positives"] == label)
            have = int((f["positives"] if label else f["pairs"] - f["positives"])[f["taken"]].sum())
            spare = f.index[single & (f["taken"] if have > want else ~f["taken"])]
            if len(spare) >= abs(want - have):
                f.loc[spare[: abs(want - have)], "taken"] = have < want
        return f.loc[f["taken"], ["category", "group_id", "pairs", "positives"]]

    wanted = quotas.select("category", F.col("pairs").alias("want_pairs"), F.col("positives").alias("want_positives"))
    rows = groups.join(pr.small(wanted), "category").withColumn("order", order_hash(F.lit(seed), "category", "group_id"))
    kinds = dict(groups.dtypes)
    return rows.groupBy("category").applyInPandas(pick, f"category {kinds['category']}, group_id {kinds['group_id']}, pairs long, positives long")


def stratified_group_folds(pairs: DataFrame, folds: int) -> DataFrame:
    """(component_id, fold): whole components, dealt within the stratum (category and target) that most of their pairs are of
    (ties: the first), by descending size back and forth; every stratum starts at a fold of its own, so that the larger
    ends of many strata spread."""
    strata = pairs.groupBy("component_id", "category", "target").agg(F.count(F.lit(1)).alias("n"))
    main = strata.groupBy("component_id").agg(F.min(F.struct((-F.col("n")).alias("neg"), "category", "target")).alias("m"), F.sum("n").alias("size"))
    main = main.select("component_id", "size", F.concat_ws("||", "m.category", "m.target").alias("stratum"))
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("size"), "component_id")) - 1
    turn, place = F.floor(nth / folds), nth % folds
    start = F.conv(F.substring(order_hash("stratum"), 1, 8), 16, 10).cast("long")
    snake = F.when(turn % 2 == 0, place).otherwise(folds - 1 - place)
    return main.select("component_id", F.pmod(snake + start, F.lit(folds)).cast("int").alias("fold"))


def oversampled(df: DataFrame, eligible: Column, quantile: float, seed: str) -> DataFrame:
    """All pairs, and once more (``copy`` 1) the hard ones: eligible pairs whose error reaches the quantile of the eligible
    pairs with their label; ``shuffle_key`` orders them."""
    p = df.withColumn("hardness", F.when(F.col("target") == 1, 1.0 - F.col("score")).otherwise(F.col("score")))
    limits = p.filter(eligible).groupBy("target").agg(F.percentile("hardness", quantile).alias("limit"))
    hard = p.join(F.broadcast(limits), "target").filter(eligible & (F.col("hardness") >= F.col("limit")))  # one row a label
    both = p.select("id1", "id2", "target", F.lit(0).alias("copy")).unionByName(hard.select("id1", "id2", "target", F.lit(1).alias("copy")))
    return both.withColumn("shuffle_key", order_hash(F.lit(seed), "id1", "id2", "copy"))


def little_endian_bucket(text: Column, modulo: int) -> Column:
    """The first eight bytes of a text's SHA-256, as a little-endian number, modulo ``modulo``."""
    digest = F.sha2(text.cast("binary"), 256)
    turned = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))))
    return F.pmod(F.conv(turned, 16, 10).cast("decimal(20,0)"), F.lit(modulo).cast("decimal(20,0)")).cast("int")


def times_64(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64 over 64-bit patterns held as longs. The halves are multiplied as decimals, whose 38 digits
    hold them, so that nothing overflows."""
    wide = lambda c: c.cast("decimal(38,0)")
    low = wide(x.bitwiseAND((1 << 32) - 1))
    high = wide(F.shiftrightunsigned(x, 32))
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    upper = F.pmod(high * big(factor & ((1 << 32) - 1)) + low * big(factor >> 32), big(1 << 32)).cast("decimal(20,0)")
    lower = (low * big(factor & ((1 << 32) - 1))).cast("decimal(20,0)")
    total = F.pmod(upper * F.lit(str(1 << 32)).cast("decimal(11,0)") + lower, F.lit(str(1 << 64)).cast("decimal(21,0)"))
    return F.when(total >= F.lit(str(1 << 63)).cast("decimal(20,0)"), (total - F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("long")).otherwise(total.cast("long"))


def mixed_priority(id1: Column, id2: Column, seed: int) -> Column:
    """A number in [0, 1) for a pair: 64-bit multiplication, xor and shifts, the same on every machine."""
    # The odd factors of the mix.
    x = times_64(id1.cast("long"), 0x9E3779B185EBCA87).bitwiseXOR(times_64(id2.cast("long"), 0xC2B2AE3D27D4EB4F)).bitwiseXOR(F.lit(seed).cast("long"))
    x = times_64(x.bitwiseXOR(F.shiftrightunsigned(x, 30)), 0xBF58476D1CE4E5B9)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27))
    return F.shiftrightunsigned(x, 11).cast("double") / float(1 << 53)


def exclusion_split(items: DataFrame, pairs: DataFrame, apart: Column, excluded: DataFrame) -> dict[str, DataFrame]:
    """Four tables: items and pairs of the categories apart (``apart`` over items), and of the rest without the excluded ids
    (id); a pair goes with its items, and one that straddles, or has an excluded end, is in neither."""
    bad = excluded.select("id").distinct()
    out_items = items.filter(apart)
    rest_items = items.filter(~apart).join(bad, "id", "left_anti")
    out = {"items_apart": out_items, "items_rest": rest_items}
    for name, side in (("pairs_apart", out_items), ("pairs_rest", rest_items)):
        kept = pairs
        for i in (1, 2):
            kept = kept.join(side.select(F.col("id").alias(f"id{i}")), f"id{i}", "left_semi")
        out[name] = kept.select(*pairs.columns)
    return out


def split_checks(parts: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """(part, n_rows, uncovered): rows of each part, and ends of its pairs that its items lack (0 by construction)."""
    out = None
    for kind in ("apart", "rest"):
        ids = parts[f"items_{kind}"].select("id")
        ends = pr.endpoints(parts[f"pairs_{kind}"]).join(ids, "id", "left_anti")
        for name, df, lost in ((f"items_{kind}", parts[f"items_{kind}"], None), (f"pairs_{kind}", parts[f"pairs_{kind}"], ends)):
            one = df.agg(F.count(F.lit(1)).alias("n_rows")).join(lost.agg(F.count(F.lit(1)).alias("uncovered")) if lost is not None else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("uncovered")))
            one = one.select(F.lit(name).alias("part"), "n_rows", "uncovered")
            out = one if out is None else out.unionByName(one)
    return out


def content_components(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(id, component_id) where components of pairs that hold items of one content signature (id, signature) are one too: a
    star around the least id of each signature joins them."""
    known = pr.endpoints(pairs).distinct()
    return gr.components(gr.with_groups(pairs, signatures.join(known, "id"), "signature"))


def scenarios(pairs: DataFrame, items: DataFrame, seeds: list[str], share: float, signatures: dict[str, Column], least_filled: int = 1000) -> DataFrame:
    """(scenario, id1, id2, split): whole components by each seed, and components merged by each signature of items (an empty
    or null one merges nothing); a signature marked by a trailing '?' is only used if that many items have one."""
    plain = pairs.select("id1", "id2")
    labelled = gr.pair_components(plain)
    parts = [gr.hash_split(labelled, F.col("component_id"), seed, share).withColumn("scenario", F.lit(f"component_{seed}")) for seed in seeds]
    for name, column in signatures.items():
        signed = items.select("id", F.nullif(column, F.lit("")).alias("signature"))
        if name.endswith("?") and signed.filter("signature is not null").count() < least_filled:
            continue
        labels = content_components(plain, signed)
        rows = plain.join(labels.withColumnRenamed("id", "id1"), "id1")
        parts.append(gr.hash_split(rows, F.col("component_id"), seeds[0], share).withColumn("scenario", F.lit(name.rstrip("?"))))
    return reduce(DataFrame.unionByName, (p.select("scenario", "id1", "id2", "split") for p in parts))


def split_overlap(assigned: DataFrame, items: DataFrame, signatures: dict[str, Column]) -> DataFrame:
    """(scenario, train_pairs, valid_pairs, positive_gap, shared_ids, shared_<signature>...) of split assignments (scenario,
    id1, id2, split, target): what the two sides have in common."""
    ends = assigned.select("scenario", "split", F.explode(F.array("id1", "id2")).alias("id")).distinct()
    named = ends.join(items.select("id", *(c.alias(n) for n, c in signatures.items())), "id")
    valid = F.col("split") == "valid"
    sizes = assigned.groupBy("scenario").agg(F.count_if(~valid).alias("train_pairs"), F.count_if(valid).alias("valid_pairs"), F.abs(F.avg(F.when(valid, F.col("target"))) - F.avg(F.when(~valid, F.col("target")))).alias("positive_gap"))
    for name in ("id", *signatures):
        sides = named.filter(F.col(name).isNotNull()).groupBy("scenario", name).agg(F.count_distinct("split").alias("k"))
        sizes = sizes.join(sides.groupBy("scenario").agg(F.count_if(F.col("k") == 2).alias("shared_ids" if name == "id" else f"shared_{name}")), "scenario", "left")
    return sizes


def representation_overlap(train: DataFrame, valid: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(representation, train_unique, validation_unique, shared_unique, validation_seen_share) for items of both sides; a
    representation is an array of values of an item."""
    rows = None
    for side, df in (("train", train), ("valid", valid)):
        values = F.explode(F.array(*(F.struct(F.lit(n).alias("representation"), F.filter(c, lambda x: x.isNotNull() & (x != "")).alias("vs")) for n, c in columns.items())))
        part = df.select(values.alias("r")).select("r.representation", F.explode("r.vs").alias("value")).distinct().withColumn("side", F.lit(side))
        rows = part if rows is None else rows.unionByName(part)
    sides = rows.groupBy("representation", "value").agg(F.bool_or(F.col("side") == "train").alias("t"), F.bool_or(F.col("side") == "valid").alias("v"))
    out = sides.groupBy("representation").agg(F.count_if("t").alias("train_unique"), F.count_if("v").alias("validation_unique"), F.count_if(F.col("t") & F.col("v")).alias("shared_unique"))
    return out.withColumn("validation_seen_share", F.col("shared_unique") / F.greatest(F.lit(1), F.col("validation_unique")))
