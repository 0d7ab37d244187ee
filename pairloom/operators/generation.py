"""Generated items and pairs: exemplar banks, tasks, schedules, transforms, checks with reasons, audits, capped selections."""

from __future__ import annotations

import hashlib
import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm, text as tx
from . import greedy as gd, pairs as pr, ranking as rk


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """The names of the conditions that hold, in their order; a condition that is null doesn't hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))


# banks, profiles, tasks


def exemplar_bank(items: DataFrame, bag: Column, n: int, seed: str, low: int = 3, high: int = 40) -> DataFrame:
    """Up to ``n`` items a category with between ``low`` and ``high`` attributes, of least hash, with their turn from 0."""
    rows = items.withColumn("attributes_n", F.size(bag)).filter((F.col("attributes_n") >= low) & (F.col("attributes_n") <= high))
    order = F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary"))
    turn = F.row_number().over(Window.partitionBy("category").orderBy(order, "id")) - 1
    return rows.withColumn("turn", turn).filter(F.col("turn") < n)


def category_profiles(items: DataFrame, bag: Column, top: int) -> DataFrame:
    """For each category: items, 10, 50 and 90 % of attribute counts and name lengths, and its most frequent keys."""
    rows = items.select("id", "category", F.length("name").alias("chars"), bag.alias("bag")).withColumn("n", F.size("bag"))
    shares = [0.1, 0.5, 0.9]
    sums = rows.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.percentile("n", shares).alias("a"), F.percentile("chars", shares).alias("c"))
    keys = rows.select("category", F.explode(F.map_keys("bag")).alias("key")).groupBy("category", "key").agg(F.count(F.lit(1)).alias("k"))
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("k"), "key"))).filter(F.col("r") <= top)
    named = ranked.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("r", "key"))).alias("l")).select("category", F.array_join("l.key", ",").alias("top_keys"))
    cells = [F.col(c)[i].alias(f"{name}_p{int(q * 100)}") for c, name in (("a", "attributes"), ("c", "chars")) for i, q in enumerate(shares)]
    return sums.join(named, "category", "left").select("category", "items", *cells, "top_keys")


def round_robin_tasks(bank: DataFrame, count: int, seed: str, id_start: int = -1) -> DataFrame:
    """(task, synthetic_id, category, id): tasks go round the categories by name; a category's anchors come in an order that
    is shuffled anew after each pass. Places are computed, nothing is dealt one by one."""
    sizes = bank.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("c", F.row_number().over(Window.orderBy("category")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))  # one row a category
    turns = F.greatest(F.lit(0), F.floor((F.lit(count) - 1 - F.col("c")) / F.col("k")) + 1)
    plan = sizes.withColumn("turns", turns).filter("turns > 0").withColumn("passes", F.ceil(F.col("turns") / F.col("n")))
    rounds = bank.select("category", "id").join(pr.small(plan), "category").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(seed), "pass", "id").cast("binary"))
    slot = F.row_number().over(Window.partitionBy("category", "pass").orderBy(order, "id")) - 1
    turn = F.col("pass") * F.col("n") + slot
    placed = rounds.withColumn("turn", turn).filter(F.col("turn") < F.col("turns"))
    task = (F.col("turn") * F.col("k") + F.col("c")).cast("long")
    return placed.select(task.alias("task"), (F.lit(id_start) - task).alias("synthetic_id"), "category", "id")


def rule_schedule(rules: list[dict], profiles: dict[int, int], quotas: dict[str, int], cap: int) -> list[dict]:
    """Tasks (task, category, rules, label) with bundles of one to three rules: as many of each size as ``profiles`` say, and
    of each category as ``quotas`` do; a bundle's rules are allowed in its category, of one label and different concepts,
    and each rule is used at most ``cap`` times, the least used first (ties by a hash of task and rule). Sizes that can't be
    met are lowered. A planner for the driver: its input is a list of rules and its output a list of tasks."""
    used = {r["rule_id"]: 0 for r in rules}
    sizes = [n for n, k in sorted(profiles.items(), reverse=True) for _ in range(k)]
    total = {c: q for c, q in quotas.items() if q > 0}
    line = [(0.0, c, 0) for c in sorted(total)]
    heapq.heapify(line)
    tasks: list[dict] = []
    balance = {0: 0, 1: 0}
    for size in sizes:
        if not line:
            break
        _, category, i = heapq.heappop(line)
        if i + 1 < total[category]:
            heapq.heappush(line, ((i + 1) / total[category], category, i + 1))
        number = len(tasks)
        found: list[dict] = []
        for label in sorted(balance, key=lambda x: (balance[x], x)):
            free = [r for r in rules if category in r["categories"] and r["label"] == label and used[r["rule_id"]] < cap]
            free.sort(key=lambda r: (used[r["rule_id"]], hashlib.md5(f"{number}:{r['rule_id']}".encode()).hexdigest()))  # noqa: B023
            picked: list[dict] = []
            for r in free:
                if len(picked) < size and r["concept"] not in {p["concept"] for p in picked}:
                    picked.append(r)
            if len(picked) > len(found):
                found = picked
            if len(found) == size:
                break
        if not found:
            continue
        balance[found[0]["label"]] += 1
        for r in found:
            used[r["rule_id"]] += 1
        tasks.append({"task": number, "category": category, "rules": [r["rule_id"] for r in found], "label": found[0]["label"]})
    return tasks


# transforms and checks


def surface_transforms() -> dict[str, object]:
    """Rewritings of a name that leave what it names as it is, by name: functions of a column."""
    unit = {"mm": "millimetres", "cm": "centimetres", "kg": "kilograms", "ml": "millilitres", "gb": "GB"}

    def spelled(c: Column) -> Column:
        return reduce(lambda t, kv: F.regexp_replace(t, rf"(?i)(\d) ?{kv[0]}\b", f"$1 {kv[1]}"), unit.items(), c)

    return {
        "upper_case": F.upper, "unit_words": spelled, "no_unit_space": lambda c: F.regexp_replace(c, r"(?i)(\d) (mm|cm|kg|ml|gb|g|w|v)\b", "$1$2"), "decimal_comma": lambda c: F.regexp_replace(c, r"(\d)\.(\d)", "$1,$2"),
        "no_hash": lambda c: F.replace(c, F.lit("#"), F.lit("# ")), "hyphen_space": lambda c: F.regexp_replace(c, r"(\w)-(\w)", "$1 $2"),
    }


def surface_positives(items: DataFrame, seed: str, per_item: int = 1) -> DataFrame:
    """(id, transform, original, changed): for each item up to ``per_item`` transforms that change its name, by hash order.
    Every transform only touches letters' case, spaces, unit words and signs."""
    cells = [F.struct(F.lit(n).alias("transform"), fn(F.col("name")).alias("changed"), F.md5(F.concat_ws(":", F.lit(seed), "id", F.lit(n)).cast("binary")).alias("h")) for n, fn in surface_transforms().items()]
    rows = items.select("id", F.col("name").alias("original"), F.explode(F.array(*cells)).alias("t")).select("id", "original", "t.*").filter(F.col("changed") != F.col("original"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("h", "transform"))
    return rows.withColumn("r", rank).filter(F.col("r") <= per_item).select("id", "transform", "original", "changed")


def candidate_reasons(attributes: str = "bag", anchor: str = "anchor_bag", least_changed: float = 0.35, most_similar: float = 0.97, name_chars: tuple[int, int] = (5, 240), identity: str = r"brand|бренд|model|модель|артикул|sku") -> Column:
    """Why a generated item isn't taken, over columns category, anchor_category, name, known_name (whether the catalogue has
    the name), similarity (the greatest to the anchor and the examples), subtype, anchor_subtype and both bags."""
    a, b = F.col(attributes), F.col(anchor)
    keys = F.map_keys(b)
    changed = F.filter(keys, lambda k: ~tx.fold(F.coalesce(F.try_element_at(a, k), F.lit(""))).eqNullSafe(tx.fold(F.element_at(b, k))))
    same_keys = F.array_sort(F.map_keys(a)).eqNullSafe(F.array_sort(keys))
    own = F.filter(keys, lambda k: tx.fold(k).rlike(identity))
    titled = F.col("anchor_subtype").isNotNull() & (F.col("anchor_subtype") != "") & ~F.col("anchor_subtype").startswith("__title__:")
    return reasons([
        (~F.col("category").eqNullSafe(F.col("anchor_category")), "category_mismatch"), (~same_keys, "attribute_schema_mismatch"), (F.exists(keys, lambda k: F.trim(F.coalesce(F.try_element_at(a, k), F.lit(""))) == ""), "empty_attribute_value"),
        (titled & ~F.col("subtype").eqNullSafe(F.col("anchor_subtype")), "subtype_changed"), (~F.length("name").between(*name_chars), "name_length_out_of_bounds"),
        (F.size(changed) / F.greatest(F.lit(1), F.size(keys)) < least_changed, "too_few_values_changed"), ((F.size(own) > 0) & ~F.arrays_overlap(own, changed), "identity_fields_unchanged"),
        (F.col("known_name"), "exact_name_copy"), (F.col("similarity") >= most_similar, "name_too_similar_to_example"),
    ])


def dataset_checks(items: DataFrame, reference: DataFrame, bag: Column) -> DataFrame:
    """A generated catalogue as a whole: one row of counts (invalid rows by reason, repeated ids, names and cards, names of the
    reference, new keys) and whether it is valid."""
    rows = items.select("id", "category", "name", tx.fold(F.col("name")).alias("folded"), bag.alias("bag"))
    card = F.concat_ws("\x1f", "category", "folded", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("bag", F.create_map().cast("map<string,string>")))))))
    bad = reasons([(F.col("bag").isNull(), "invalid_attributes"), (F.trim("name") == "", "empty_name"), (F.trim("category") == "", "empty_category"), (F.col("bag").isNotNull() & (F.size("bag") == 0), "empty_attributes")])
    rows = rows.withColumn("card", card).withColumn("bad", bad)
    kinds = ("invalid_attributes", "empty_name", "empty_category", "empty_attributes")
    sums = rows.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.array_contains("bad", k)).alias(k) for k in kinds))

    def repeated(c: str, name: str) -> DataFrame:
        return rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))

    known = rows.join(reference.select(tx.fold(F.col("name")).alias("folded")).distinct(), "folded", "left_semi").agg(F.count(F.lit(1)).alias("reference_names"))
    keys = rows.select(F.explode(F.map_keys("bag")).alias("key")).distinct()
    new = keys.join(reference.select(F.explode(F.map_keys("bag")).alias("key")).distinct(), "key", "left_anti").agg(F.count(F.lit(1)).alias("new_keys"))
    out = reduce(lambda a, b: a.join(b), (sums, repeated("id", "repeated_ids"), repeated("folded", "repeated_names"), repeated("card", "repeated_cards"), known, new))  # one row each
    faults = reduce(lambda a, b: a + b, (F.col(k) for k in (*kinds, "repeated_ids", "repeated_cards", "reference_names")))
    return out.withColumn("valid", faults == 0)


def anchor_reasons(type_key: str, forbidden: str, low: int = 3, high: int = 12) -> Column:
    """Why an item can't anchor a mutation, over bag, category, task_category, product_type and name."""
    bag, kind = F.col("bag"), F.try_element_at("bag", F.lit(type_key))
    return reasons([
        (~F.col("category").eqNullSafe(F.col("task_category")), "anchor_category_mismatch"), (F.col("bag").isNull() | ~F.size("bag").between(low, high), "anchor_attribute_count_out_of_bounds"),
        (F.exists(F.map_entries(bag), lambda e: (F.trim(e["key"]) == "") | (F.trim(e["value"]) == "")), "anchor_empty_attribute"), (F.exists(F.map_keys(bag), lambda k: tx.fold(k).rlike(forbidden)), "anchor_forbidden_identifier"),
        (kind.isNull(), "anchor_missing_product_type"), (kind.isNotNull() & (tx.fold(kind) != tx.fold(F.col("product_type"))), "anchor_product_type_mismatch"),
        (kind.isNotNull() & (tx.fold(kind) == tx.fold(F.col("product_type"))) & ~tx.fold(F.col("name")).startswith(tx.fold(F.col("product_type"))), "anchor_name_does_not_start_with_product_type"),
    ])


def mutation_reasons() -> Column:
    """Why a mutation isn't taken, over anchor_bag, bag, category, anchor_category, key (the rule's), declared_key, old, new,
    allowed (transitions 'old>new', empty: any), name, anchor_name and similarity."""
    a, b = F.col("anchor_bag"), F.col("bag")
    keys = F.map_keys(a)
    changed = F.filter(keys, lambda k: ~tx.fold(F.coalesce(F.try_element_at(b, k), F.lit(""))).eqNullSafe(tx.fold(F.element_at(a, k))))
    move = F.concat_ws(">", tx.fold(F.col("old")), tx.fold(F.col("new")))
    return reasons([
        (~F.col("category").eqNullSafe(F.col("anchor_category")), "category_mismatch"), (~F.array_sort(F.map_keys(b)).eqNullSafe(F.array_sort(keys)), "attribute_schema_mismatch"),
        (F.col("declared_key") != F.col("key"), "wrong_rule_attribute_key"), ((F.trim("old") == "") | (F.trim("new") == ""), "empty_value"), (tx.fold(F.col("old")) == tx.fold(F.col("new")), "value_not_changed"),
        (~tx.fold(F.try_element_at(a, F.col("key"))).eqNullSafe(tx.fold(F.col("old"))), "original_differs_from_anchor"), (~tx.fold(F.try_element_at(b, F.col("key"))).eqNullSafe(tx.fold(F.col("new"))), "declared_value_not_applied"),
        ((F.size("allowed") > 0) & ~F.array_contains("allowed", move), "disallowed_value_transition"), (F.size(F.array_except(changed, F.array("key"))) > 0, "undeclared_change"),
        (tx.fold(F.col("anchor_name")).contains(tx.fold(F.col("old"))) & ~tx.fold(F.col("name")).contains(tx.fold(F.col("new"))), "title_not_updated"), (F.col("similarity") < 0.35, "name_too_different"),
    ])


def pair_checks(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(id1, id2, reasons) of generated pairs: structure (unknown items, self pairs, repeats in either order, conflicting
    labels) and meaning (categories apart, equal cards with label 0, nothing shared with label 1)."""
    p = pr.hydrate(pairs, items.select("id", "category", "name", "bag"), ("category", "name", "bag"))
    p = pr.canonical(p)
    both = pr.canonical(pairs).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("target").alias("labels"))
    p = p.join(both, ["lo", "hi"], "left")
    known = F.col("name_1").isNotNull() & F.col("name_2").isNotNull()
    entries = [F.map_entries(F.coalesce(f"bag_{i}", F.create_map().cast("map<string,string>"))) for i in (1, 2)]
    same = (F.size(F.array_except(*entries)) == 0) & (F.size(F.array_except(*entries[::-1])) == 0) & (tx.fold(F.col("name_1")) == tx.fold(F.col("name_2")))
    told = reasons([
        (~known, "unknown_item"), (F.col("id1") == F.col("id2"), "self_pair"), (F.col("times") > 1, "repeated_pair"), (F.col("labels") > 1, "conflicting_labels"), (known & ~F.col("category_1").eqNullSafe(F.col("category_2")), "category_mismatch"),
        (known & same & (F.col("target") == 0), "equal_cards_labelled_different"), (known & ~F.arrays_overlap(*entries) & ~F.arrays_overlap(tx.tokens(F.col("name_1")), tx.tokens(F.col("name_2"))) & (F.col("target") == 1), "nothing_shared_labelled_same"),
    ])
    return p.select("id1", "id2", told.alias("reasons"))


def capped_selection(df: DataFrame, caps: dict[str, int], once: list[str], order: list) -> DataFrame:
    """Rows that a greedy pass in the given order takes: at most so many for each value of each capped column, and each value
    of the ``once`` columns (which share their values) at most once."""
    placed = rk.running_sum(df, None, order, "__place")
    groups = [F.struct(F.concat_ws("\x1f", F.lit(c), F.col(c).cast("string")).alias("grp"), F.lit(n).alias("cap")) for c, n in caps.items()]
    groups += [F.struct(F.concat_ws("\x1f", F.lit("once"), F.col(c).cast("string")).alias("grp"), F.lit(1).alias("cap")) for c in once]
    members = placed.select(F.col("__place").alias("row"), F.col("__place").alias("place"), F.explode(F.array_distinct(F.array(*groups))).alias("g")).select("row", "place", "g.*")
    return placed.join(gd.capped(members).withColumnRenamed("row", "__place"), "__place", "left_semi").drop("__place")


def mark_overlap(candidates: DataFrame, facts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether any of a candidate's fact keys is among ``facts`` (fact)."""
    known = facts.select("fact").distinct()
    out = candidates
    for i, key in enumerate(keys):
        out = out.join(known.select(F.col("fact").alias(key), F.lit(True).alias(f"__k{i}")), key, "left")
    hit = reduce(lambda a, b: a | b, (F.coalesce(f"__k{i}", F.lit(False)) for i in range(len(keys))))
    return out.withColumn(name, hit).drop(*(f"__k{i}" for i in range(len(keys))))


def pair_audit(pairs: DataFrame, assignments: DataFrame, items: DataFrame) -> DataFrame:
    """(measure, value) of generated pairs (pair_id, id1, id2, target, category) and their rules (pair_id, rule_id): sizes,
    rules a pair, evenness of rules, repeated rule signatures, items missing or used twice, repeated pairs."""
    use = assignments.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    signature = assignments.groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), "+").alias("s"), F.count(F.lit(1)).alias("k"))
    signs = signature.join(pairs.select("pair_id", "category"), "pair_id").groupBy("category", "s").agg(F.count(F.lit(1)).alias("n"))
    ends = pr.endpoints(pairs)
    parts = [
        pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("target").alias("positives"), F.count_if(F.col("id1") == F.col("id2")).alias("self_pairs")),
        signature.agg(F.max("k").alias("most_rules"), F.avg("k").alias("mean_rules")), use.agg(F.count(F.lit(1)).alias("rules"), F.min("n").alias("least_use"), F.max("n").alias("most_use")),
        signs.agg(F.count(F.lit(1)).alias("signatures"), F.count_if(F.col("n") > 1).alias("repeated_signatures")),
        ends.join(items.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("missing_items")), ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("reused_items")),
        pr.canonical(pairs).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_pairs")),
        pairs.join(assignments.select("pair_id").distinct(), "pair_id", "left_anti").agg(F.count(F.lit(1)).alias("pairs_without_rules")),
    ]
    one = reduce(lambda a, b: a.join(b), parts)  # one row each
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in one.columns))).alias("x")).select("x.*")


def sanitised_facts(facts: DataFrame, allowed: list[str], relations: list[str]) -> DataFrame:
    """Facts (pair_id, concept, relation, value_a, value_b, source, confidence, drop_reason): why a fact is dropped, null for
    those kept. Of good facts of one pair and concept the best counts: by source (attribute before title), confidence, and
    values; the others are duplicates."""
    bad = F.coalesce(
        F.when(F.trim(F.coalesce("concept", F.lit(""))) == "", "empty_concept"), F.when(~F.col("concept").isin(*allowed), "unknown_concept"), F.when(~F.col("relation").isin(*relations), "unknown_relation"),
        F.when((F.col("relation") == "different_value") & (F.trim(F.coalesce("value_a", F.lit(""))) == F.trim(F.coalesce("value_b", F.lit("")))), "values_do_not_differ"), F.when((F.col("relation") == "same") & (tx.fold(F.col("value_a")) != tx.fold(F.col("value_b"))), "values_differ"),
        F.when(~F.col("confidence").between(0.0, 1.0), "confidence_out_of_range"),
    )
    rows = facts.withColumn("drop_reason", bad)
    source = F.when(F.col("source") == "attribute", 0).when(F.col("source") == "title", 1).otherwise(2)
    nth = F.row_number().over(Window.partitionBy("pair_id", "concept", F.col("drop_reason").isNull()).orderBy(source, F.desc("confidence"), "value_a", "value_b"))
    return rows.withColumn("__n", nth).withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("__n") > 1, "duplicate_concept"))).drop("__n")


def prototypes(facts: DataFrame) -> DataFrame:
    """Prototypes of differing facts (pair_id, category, label, split, singleton, concept, relation, value_a, value_b): those of
    one category, relation, concept and family of values. A pair has one vote in each; votes by label, by split, and of pairs
    with one fact only."""
    digit, letter = F.col("value_a").rlike("[0-9]") | F.col("value_b").rlike("[0-9]"), F.col("value_a").rlike(r"\p{L}") | F.col("value_b").rlike(r"\p{L}")
    family = F.when(digit & letter, "code").when(digit, "number").otherwise("text")
    rows = facts.filter("relation = 'different_value'").withColumn("value_family", family)
    votes = rows.groupBy("category", "concept", "relation", "value_family", "pair_id").agg(F.max("label").alias("label"), F.max("split").alias("split"), F.bool_or("singleton").alias("singleton"))
    count = lambda c, name: F.count_if(c).alias(name)
    parts = [F.count(F.lit(1)).alias("pair_support")]
    for label in (0, 1):
        is_label = F.col("label") == label
        parts += [count(is_label, f"label{label}"), count(is_label & F.col("singleton"), f"singleton_label{label}")]
        parts += [count(is_label & (F.col("split") == s), f"{s}_label{label}") for s in ("discovery", "validation")]
    out = votes.groupBy("category", "concept", "relation", "value_family").agg(*parts)
    key = F.md5(F.concat_ws("|", "category", "relation", "concept", "value_family").cast("binary"))
    return out.withColumn("prototype_key", key).withColumn("block_key", F.md5(F.concat_ws("|", "category", "relation", "value_family").cast("binary")))


def anchor_statistics(rows: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Pairs with each anchor (id1, id2, target, category, anchor): support, positives, Wilson bounds, categories. With rules
    (id1, id2, rule) also each rule under each anchor and how its rate differs from the anchor's own."""
    base = rows.select("id1", "id2", "target", "category", "anchor").distinct()
    sums = base.groupBy("anchor").agg(F.count(F.lit(1)).alias("support"), F.sum("target").alias("positives"), F.count_distinct("category").alias("categories"))
    sums = sums.withColumn("rate", F.col("positives") / F.col("support")).withColumn("low", nm.wilson(F.col("positives"), F.col("support"))).withColumn("high", nm.wilson(F.col("positives"), F.col("support"), upper=True))
    if rules is None:
        return sums
    joined = base.join(rules.select("id1", "id2", "rule").distinct(), ["id1", "id2"]).groupBy("anchor", "rule").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("with_rule"))
    return joined.join(pr.small(sums.select("anchor", "rate")), "anchor").withColumn("difference", F.col("with_rule") - F.col("rate"))
