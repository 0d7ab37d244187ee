"""Data analyses: duplicates, splits, completeness, signatures, n-gram errors, value support, normalisation impact."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import attributes as at, pairs as pr


def _n() -> Column:
    return F.count(F.lit(1))


def degree_quantiles(pairs: DataFrame, shares: list[float]) -> DataFrame:
    """(quantile, degree) of the items' numbers of pairs, and their mean."""
    degrees = pr.endpoints(pairs).groupBy("id").agg(_n().alias("degree"))
    one = degrees.agg(F.percentile("degree", shares).alias("p"), F.avg("degree").alias("mean"))
    cells = [F.struct(F.lit(f"p{int(q * 100):02d}").alias("quantile"), F.col("p")[i].alias("degree")) for i, q in enumerate(shares)]
    return one.select(F.explode(F.array(*cells, F.struct(F.lit("mean").alias("quantile"), F.col("mean").alias("degree")))).alias("x")).select("x.*")


def top_endpoints(pairs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The n items in most pairs (ties by id), with their positives, name and category."""
    degrees = pr.endpoints(pairs, "target").groupBy("id").agg(_n().alias("degree"), F.sum("target").alias("positives"))
    return degrees.orderBy(F.desc("degree"), "id").limit(n).join(items.select("id", "name", "category"), "id", "left")


def duplicate_summary(pairs: DataFrame) -> DataFrame:
    """Repeated pairs, as written and in either order, reversed ones, those with conflicting labels, self pairs: one row."""
    exact = pairs.groupBy("id1", "id2").agg(_n().alias("n")).agg(F.count_if(F.col("n") > 1).alias("exact_groups"), F.sum(F.col("n") - 1).alias("exact_extra_rows"))
    both = pr.canonical(pairs).groupBy("lo", "hi").agg(_n().alias("n"), F.count_distinct("target").alias("labels"), F.count_distinct(F.col("id1") == F.col("lo")).alias("orientations"))
    both = both.agg(F.count_if(F.col("n") > 1).alias("unordered_groups"), F.sum(F.col("n") - 1).alias("unordered_extra_rows"), F.count_if(F.col("orientations") > 1).alias("reversed_groups"), F.count_if(F.col("labels") > 1).alias("conflicting_groups"))
    selfs = pairs.agg(F.count_if(F.col("id1") == F.col("id2")).alias("self_pairs"))
    return exact.join(both).join(selfs)  # one row each


def split_summary(assigned: DataFrame, train: str = "train") -> DataFrame:
    """For each split of (id1, id2, category, target, split): pairs, products, labels, categories, products that the train
    split has too, and categories that it lacks."""
    ends = assigned.select("split", F.explode(F.array("id1", "id2")).alias("id")).distinct()
    known = ends.filter(F.col("split") == train).select("id", F.lit(1).alias("known"))
    products = ends.join(known, "id", "left").groupBy("split").agg(_n().alias("unique_products"), F.count("known").alias("overlap_with_train"))
    have = assigned.filter(F.col("split") == train).select("category").distinct().withColumn("had", F.lit(1))
    lacks = assigned.select("split", "category").distinct().join(pr.small(have), "category", "left")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    lacks = lacks.groupBy("split").agg(names("category").alias("categories"), names(F.when(F.col("had").isNull(), F.col("category"))).alias("absent_from_train"), _n().alias("category_count"))
    sums = assigned.groupBy("split").agg(_n().alias("pairs"), F.sum("target").alias("positives"), F.avg("target").alias("prevalence"))
    return sums.join(products, "split").join(lacks, "split")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks, and the other way round, with their multiplicities: one row. Counts by row are
    compared in one aggregation."""
    rows = left.withColumn("__s", F.lit(1)).unionByName(right.withColumn("__s", F.lit(-1)))
    counts = rows.groupBy(*left.columns).agg(F.sum("__s").alias("d"))
    return counts.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("added"))


def completeness(items: DataFrame) -> DataFrame:
    """Items with measures of how full they are and how title and attribute values repeat one another."""
    title, bag = tx.alnum_only(F.col("name")), at.folded_bag(F.col("attributes"))
    base = items.select("id", "category", F.length("name").alias("title_chars"), F.length("attributes").alias("attributes_chars"), title.alias("title"), bag.alias("bag"))
    values = F.transform(F.map_values("bag"), tx.alnum_only)
    base = base.withColumn("tokens", tx.tokens(F.col("title"))).withColumn("values", values).withColumn("value_tokens", tx.tokens(F.array_join("values", " ")))
    alone = F.size(F.array_except("tokens", "value_tokens"))
    ident = lambda c: F.filter(c, lambda t: (F.length(t) >= 3) & t.rlike("[0-9]"))
    again = F.size(F.filter("values", lambda x: (x != "") & F.concat(F.lit(" "), F.col("title"), F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" ")))))
    return base.select(
        "id", "category", F.size("bag").alias("attribute_count"), "title_chars", "attributes_chars", F.length(F.array_join("values", "")).alias("value_chars"), F.size("tokens").alias("title_tokens"), alone.alias("title_only_tokens"),
        F.when(F.size("tokens") > 0, alone / F.size("tokens")).otherwise(0.0).alias("title_only_share"), F.size(ident("tokens")).alias("title_identifiers"),
        F.size(F.array_except(ident("tokens"), "value_tokens")).alias("title_only_identifiers"), again.alias("values_in_title"),
    )


def quantile_table(df: DataFrame, metrics: list[str], shares: list[float]) -> DataFrame:
    """(metric, quantile, value) by linear interpolation, and each metric's mean: one pass, unpivoted at the end."""
    one = df.agg(*(x for m in metrics for x in (F.percentile(m, shares).alias(f"p_{m}"), F.avg(m).alias(f"m_{m}"))))
    cell = lambda m, q, x: F.struct(F.lit(m).alias("metric"), F.lit(q).alias("quantile"), x.cast("double").alias("value"))
    cells = [cell(m, f"p{int(q * 100):02d}", F.col(f"p_{m}")[i]) for m in metrics for i, q in enumerate(shares)] + [cell(m, "mean", F.col(f"m_{m}")) for m in metrics]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def signature_overlap(assigned: DataFrame, signatures: DataFrame, train: str = "train") -> DataFrame:
    """For each split: content signatures (id, signature) of its items, repeated ones, those known from the train split, and
    its pairs whose two signatures make a pair there, with the same, the other, or mixed labels."""
    ends = assigned.select("split", F.explode(F.array("id1", "id2")).alias("id")).distinct().join(signatures, "id")
    counts = ends.groupBy("split", "signature").agg(_n().alias("n"))
    known = counts.filter(F.col("split") == train).select("signature", F.lit(1).alias("known"))
    items = counts.join(known, "signature", "left").groupBy("split").agg(
        _n().alias("signatures"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("items_in_repeated"),
        F.count("known").alias("seen_in_train"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("items_seen_in_train"),
    )
    p = pr.hydrate(assigned.select("split", "id1", "id2", "target"), signatures, ("signature",))
    p = p.select("split", "target", F.least("signature_1", "signature_2").alias("a"), F.greatest("signature_1", "signature_2").alias("b"))
    labels = p.filter(F.col("split") == train).groupBy("a", "b").agg(F.min("target").alias("low"), F.max("target").alias("high"))
    met = p.filter(F.col("split") != train).join(labels, ["a", "b"])
    kind = F.when(F.col("low") != F.col("high"), "mixed").when(F.col("target") == F.col("low"), "same").otherwise("conflicting")
    kinds = met.withColumn("kind", kind).groupBy("split").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_label") for k in ("same", "conflicting", "mixed")))
    return items.join(kinds, "split", "left").fillna(0)


def first_examples(df: DataFrame, keys: list[str], value: str, order: list, n: int = 3) -> DataFrame:
    """(keys, examples): the first n values of each group, joined; groups are cut down before anything is gathered."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= n)
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", F.col(value).cast("string").alias("v")))).alias("l"))
    return listed.select(*keys, F.array_join("l.v", ",").alias("examples"))


def variant_keys(pairs: DataFrame, bag_1: str = "bag_1", bag_2: str = "bag_2", shrink: float = 5.0, least: int = 3, rate: float = 0.6) -> DataFrame:
    """(category, key): for keys that both items hold, equal and conflicting values by label, the rate of negatives among
    conflicts, shrunk to the category's rate by pseudo-observations, its lift, and whether the key is a candidate."""
    keys = F.array_intersect(F.map_keys(bag_1), F.map_keys(bag_2))
    rows = pairs.select("category", "target", bag_1, bag_2, F.explode(keys).alias("key"))
    equal, yes = F.element_at(bag_1, F.col("key")) == F.element_at(bag_2, F.col("key")), F.col("target") == 1
    counts = rows.groupBy("category", "key").agg(F.count_if(~equal & ~yes).alias("conflict_0"), F.count_if(~equal & yes).alias("conflict_1"), F.count_if(equal & ~yes).alias("equal_0"), F.count_if(equal & yes).alias("equal_1"))
    base = pairs.groupBy("category").agg((1 - F.avg("target")).alias("category_rate"))
    out = counts.join(pr.small(base), "category").withColumn("conflicts", F.col("conflict_0") + F.col("conflict_1")).filter("conflicts > 0")
    out = out.withColumn("negative_rate", F.col("conflict_0") / F.col("conflicts")).withColumn("smoothed", (F.col("conflict_0") + shrink * F.col("category_rate")) / (F.col("conflicts") + shrink))
    return out.withColumn("lift", F.col("smoothed") - F.col("category_rate")).withColumn("candidate", (F.col("conflicts") >= least) & (F.col("negative_rate") >= rate))


def common_gram_errors(pairs: DataFrame, grams_1: Column, grams_2: Column, least: int, threshold: float = 0.5) -> DataFrame:
    """(pattern, support, ..., fpr, fnr): decision errors of pairs whose two names share an n-gram; all n-grams that a pair
    shares count, each once."""
    rows = pairs.select("target", (F.col("score") >= threshold).alias("hit"), F.explode(F.array_intersect(grams_1, grams_2)).alias("pattern"))
    no, yes = F.col("target") == 0, F.col("target") == 1
    out = rows.groupBy("pattern").agg(_n().alias("support"), F.count_if(no).alias("negatives"), F.count_if(no & F.col("hit")).alias("false_positives"), F.count_if(yes).alias("positives"), F.count_if(yes & ~F.col("hit")).alias("false_negatives"))
    out = out.filter(F.col("support") >= least)
    return out.withColumn("fpr", F.try_divide("false_positives", "negatives")).withColumn("fnr", F.try_divide("false_negatives", "positives"))


def gram_error_lift(pairs: DataFrame, grams: Column, least: int, threshold: float = 0.5) -> DataFrame:
    """(error_type, gram, support, errors, error_rate, error_lift): false positives among negatives and false negatives
    among positives whose texts hold an n-gram, against the rate of the whole; the n-gram must occur in ``least`` pairs of
    that label."""
    p = pairs.withColumn("wrong", (F.col("score") >= threshold).cast("int") != F.col("target")).withColumn("error_type", F.when(F.col("target") == 1, "fn").otherwise("fp"))
    base = p.groupBy("error_type").agg(F.avg(F.col("wrong").cast("int")).alias("base"))
    rows = p.select("error_type", "wrong", F.explode(F.array_distinct(grams)).alias("gram"))
    out = rows.groupBy("error_type", "gram").agg(_n().alias("support"), F.count_if("wrong").alias("errors")).filter(F.col("support") >= least)
    out = out.join(F.broadcast(base), "error_type").withColumn("error_rate", F.col("errors") / F.col("support"))  # two rows
    return out.withColumn("error_lift", F.col("error_rate") / F.greatest(F.col("base"), F.lit(1e-12)))


def rule_curriculum(occurrences: DataFrame, typed_errors: DataFrame) -> DataFrame:
    """(rule, pairs, and pairs of each error type) of rules over pairs with an error type (id1, id2, error_type)."""
    joined = occurrences.select("id1", "id2", "rule").distinct().join(typed_errors, ["id1", "id2"])
    kinds = ("FALSE_POSITIVE", "FALSE_NEGATIVE", "CORRECT_BUT_HARD")
    return joined.groupBy("rule").agg(_n().alias("targeted_pairs"), *(F.count_if(F.col("error_type") == k).alias(k.lower()) for k in kinds))


def usage(df: DataFrame, column: str) -> DataFrame:
    """How evenly a column's values are used: distinct values, uses, least, most, mean, ratio, coefficient of variation."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(_n().alias("n"))
    out = counts.agg(_n().alias("unique_ids"), F.sum("n").alias("uses"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    return out.select("unique_ids", "uses", "least", "most", "mean", F.try_divide("most", "least").alias("ratio"), F.try_divide("sd", "mean").alias("variation"))


def normalisation_impact(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facts (pair_id, concept, relation) under an alias map (source, target): concepts before and after, facts affected,
    rules of pairs before and after (distinct concept and relation of a pair): one row."""
    named = facts.join(pr.small(aliases), facts["concept"] == aliases["source"], "left").select("pair_id", "concept", "relation", F.coalesce("target", "concept").alias("to"))
    sums = named.agg(F.count_distinct("concept").alias("concepts_before"), F.count_distinct("to").alias("concepts_after"), F.count_if(F.col("concept") != F.col("to")).alias("facts_affected"))
    rules = [named.select("pair_id", c, "relation").distinct().agg(_n().alias(n)) for c, n in (("concept", "pair_rules_before"), ("to", "pair_rules_after"))]
    return sums.join(rules[0]).join(rules[1]).withColumn("collapsed", F.col("pair_rules_before") - F.col("pair_rules_after"))  # one row each


def value_support(rows: DataFrame, scopes: list[list[str]]) -> list[DataFrame]:
    """For each scope of columns: how often each value (key, value) occurs in it."""
    return [rows.groupBy(*scope, "key", "value").agg(_n().alias("support")) for scope in scopes]


def transition_support(candidates: DataFrame, rows: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """``candidates`` (scope columns, key, old, new) with the support of both ends in each named scope (0 if unseen)."""
    out = candidates
    for name, scope in scopes.items():
        counts = value_support(rows, [scope])[0]
        for end in ("old", "new"):
            one = counts.withColumnRenamed("value", end).withColumnRenamed("support", f"{name}_{end}")
            out = out.join(one, [*scope, "key", end], "left")
    return out.fillna(0, [f"{n}_{e}" for n in scopes for e in ("old", "new")])


def structure_similarity(pairs: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """exp(-mean of |difference| / population spread) over the items' measures (id, columns); a spread of 0 counts as 1."""
    spread = items.agg(*(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"__{c}") for c in columns))
    p = pr.hydrate(pairs, items, tuple(columns)).join(F.broadcast(spread))  # one row
    gaps = [F.abs(F.col(f"{c}_1") - F.col(f"{c}_2")) / F.col(f"__{c}") for c in columns]
    return p.select(*pairs.columns, F.exp(-sum(gaps[1:], gaps[0]) / len(gaps)).alias("similarity"))


def quality_score(c: dict[str, Column], centre: float = 0.05, scale: float = 2.0) -> Column:
    """Quality of a candidate pair: evidence of its rule, grounding, realism of its names, hardness around a score on a log
    scale, brand context; every part within 0 and 1."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    evidence = 0.40 * unit((c["probability"] - 0.70) / 0.30) + 0.25 * unit(F.log1p(F.greatest(c["support"], F.lit(0.0))) / F.log1p(F.lit(20.0))) + 0.20 * unit(c["singletons"] / F.greatest(c["support"], F.lit(1.0))) + 0.15 * F.when(c["cross_split"].isNull(), 0.35).otherwise(c["cross_split"].cast("double"))
    # How well each kind of evidence is grounded.
    kinds = {"source_exact_transition": 1.00, "source_endpoint_values": 0.90, "human_scope_attribute_values": 0.82, "human_category_attribute_values": 0.62}
    grounding = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), c["evidence"]), F.lit(0.0))
    realism = 0.60 * unit((c["title_tokens"] - 3.0) / 5.0) + 0.40 * unit(1.0 - F.abs(c["name_similarity"] - 0.80) / 0.25)
    hardness = F.exp(-F.abs(F.log(F.greatest(c["baseline"], F.lit(1e-8))) - F.log(F.lit(centre))) / scale)
    return unit(0.34 * evidence + 0.27 * grounding + 0.16 * realism + 0.18 * hardness + 0.05 * F.when(c["brand_context"], 1.0).otherwise(0.55))


def canonical_value(concept: Column, product: Column, value: Column) -> Column:
    """A domain value in one spelling, null where the concept's form doesn't match: gold colours, storage of phones in GB,
    pieces, lengths in millimetres (exact decimals), bow sizes; other concepts keep the folded value."""
    text = tx.fold(value)
    has = lambda pattern: text.rlike(rf"(?U)(?<!\w)(?:{pattern})(?!\w)")
    # The words of each colour, and the units with their factors.
    white, yellow, red = has(r"бел\w*|white"), has(r"желт\w*|yellow"), has(r"красн\w*|розов\w*|red|rose")
    mixed = has(r"комбинирован\w*|двухцветн\w*|многоцветн\w*|mixed|combined") | (white.cast("int") + yellow.cast("int") + red.cast("int") > 1)
    color = F.when(mixed, "комбинированное").when(white, "белое").when(yellow, "желтое").when(red, "красное").otherwise(text)
    compact = F.regexp_replace(text, r"\s", "")
    amount = F.regexp_extract(compact, r"^(\d+)", 1).cast("long")
    storage = F.when(compact.rlike(r"^\d+(?:тб|tb|терабайт(?:а|ов)?)$"), F.concat((amount * 1024).cast("string"), F.lit(" ГБ"))).when(compact.rlike(r"^\d+(?:гб|gb|гигабайт(?:а|ов)?)$"), F.concat(amount.cast("string"), F.lit(" ГБ"))).otherwise(text)
    pieces = F.when(text.rlike(r"^\d+\s*(?:шт\.?|штук[аи]?|pcs|pieces?)?$"), F.concat(F.regexp_extract(text, r"^(\d+)", 1).cast("long").cast("string"), F.lit(" шт")))
    length = r'^[+]?((?:\d+(?:[.,]\d+)?|[.,]\d+))\s*(мм|миллиметр(?:а|ов)?|см|сантиметр(?:а|ов)?|м|метр(?:а|ов)?|дюйм(?:а|ов)?|inch(?:es)?|in|")$'
    unit = F.regexp_extract(text, length, 2)
    factor = F.when(unit.rlike("^(см|сантиметр)"), "10").when(unit.rlike("^(мм|миллиметр)"), "1").when(unit.rlike("^(м|метр)"), "1000").otherwise("25.4").cast("decimal(8,2)")
    number = F.translate(F.regexp_extract(text, length, 1), ",", ".")
    number = F.when(number.startswith("."), F.concat(F.lit("0"), number)).otherwise(number)
    rendered = F.regexp_replace(F.regexp_replace((F.when(number != "", number).cast("decimal(20,6)") * factor).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    millimetres = F.when(text.rlike(length), F.concat(rendered, F.lit(" мм")))
    bow = text
    for glyph, fraction in (("⁄", "/"), ("⅛", "1/8"), ("¼", "1/4"), ("½", "1/2"), ("¾", "3/4")):
        bow = F.replace(bow, F.lit(glyph), F.lit(fraction))
    bow = F.trim(F.regexp_replace(F.regexp_replace(bow, r"(?U)(?<!\w)(?:размер|size)\s*[:=-]?\s*", ""), r"\s*/\s*", "/"))
    out = F.when(concept == "gold_color", color).when((concept == "storage_capacity") & (product == "смартфон"), storage).when(concept == "package_quantity", pieces)
    out = out.when(concept.isin("diameter", "length", "length_mm", "wheel_diameter", "width"), millimetres).when((concept == "size") & (product == "смычок"), bow)
    return F.when(text != "", out.otherwise(text))


def phrase_count(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a text as whole words, in any case; spaces in it match any white space."""
    pattern = r"\s+".join(re.escape(w) for w in phrase.lower().split())
    return F.size(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?U)(?<!\w){pattern}(?!\w)"), 0))


# nested JSON

#: Texts that say that a value is absent.
ABSENT = ("нет", "нет данных", "не указано", "не указан", "отсутствует", "none", "null", "n a", "na", "unknown", "неизвестно")


def nested_keys(text: Column) -> Column:
    """All keys of nested JSON in order of appearance, however deep, repeats included (Arrow batches: Catalyst has no
    recursion). Invalid JSON has none."""

    def walk(value) -> Iterator[str]:
        if isinstance(value, dict):
            for key, inner in value.items():
                yield key
                yield from walk(inner)
        elif isinstance(value, list):
            for inner in value:
                yield from walk(inner)

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(list(walk(json.loads(t))) if t else [])
            except ValueError:
                out.append([])
        return pd.Series(out)

    return keys(text)


def absent(value: Column) -> Column:
    """Whether a text only says that there is no value."""
    words = tx.alnum_only(value)
    return words.isin(*ABSENT) | (words.startswith("уточн") & words.contains("продав"))


def evidence_rows(facts: DataFrame, column: str) -> DataFrame:
    """(id, concept, side, source, name): the evidence lists of both sides of facts kept as JSON, exploded."""
    side = "struct<evidence:array<struct<source:string,raw_attribute_name:string>>>"
    parsed = facts.select("id", "concept", F.from_json(column, f"struct<a:{side},b:{side}>").alias("f"))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"f.{s}.evidence").alias("evidence")) for s in ("a", "b")))
    rows = parsed.select("id", "concept", F.explode(sides).alias("s")).select("id", "concept", "s.side", F.explode("s.evidence").alias("e"))
    return rows.select("id", "concept", "side", F.col("e.source").alias("source"), F.col("e.raw_attribute_name").alias("name"))


def unique_on(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, failing the job when two rows with the same keys are met."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    checked = df.withColumn("__twice", twice)
    first = F.when(F.col("__twice"), F.raise_error(F.lit(f"{what}: rows are repeated")).cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))
    return checked.withColumn(keys[0], first).drop("__twice")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if either side repeats a key; the windows deal both sides by the key that the join needs."""
    return unique_on(left, keys, "left").join(unique_on(right, keys, "right"), keys, "left")
