"""Attribute bags: JSON text to maps, key statistics, comparisons of two bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def parse(text: Column, keep_empty: bool = False) -> Column:
    """Trimmed map of a JSON object's members; null for invalid JSON and for other kinds of values."""
    bag = F.from_json(text, "map<string,string>")
    bag = F.transform_values(bag, lambda k, x: F.trim(x))
    return bag if keep_empty else F.map_filter(bag, lambda k, x: x.isNotNull() & (x != ""))


def parse_folded(text: Column) -> Column:
    """As ``parse``, with folded values and invalid JSON as an empty bag."""
    bag = F.coalesce(parse(text), F.create_map().cast("map<string,string>"))
    return F.transform_values(bag, lambda k, x: tx.fold(x))


def _last_of_each(entries: Column) -> Column:
    """Entries without those whose key comes again later."""
    return tx.let(entries, lambda every: F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.greatest(F.size(every), F.lit(1))), lambda x: x["key"] == e["key"])))


def folded_bag(text: Column) -> Column:
    """As ``parse_folded``, with folded keys too; of members with one folded key the last counts."""
    pairs = F.transform(F.map_entries(parse_folded(text)), lambda e: F.struct(tx.fold(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(_last_of_each(F.filter(pairs, lambda e: e["key"] != "")))


def values_where(bag: Column | str, pattern: str) -> Column:
    """Distinct values of the keys that match a pattern."""
    return F.array_distinct(F.map_values(F.map_filter(bag, lambda k, _: k.rlike(pattern))))


def flat_values(text: Column, depth: int = 3) -> Column:
    """The values in one member of a JSON object, as an array: lists are flattened (to ``depth`` levels), anything else is one
    value; null and blank values are none."""
    one = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))
    if depth:
        listed = F.from_json(text, "array<string>")
        one = F.when(text.startswith("[") & listed.isNotNull(), F.flatten(F.transform(listed, lambda x: flat_values(x, depth - 1)))).otherwise(one)
    return F.filter(one, lambda x: F.trim(x) != "")


def multi_entries(text: Column) -> Column:
    """(key, values) of a JSON object's members, or of a list of {key or name, value} records; folded, values distinct and
    sorted, empty keys and values left out. Invalid JSON and other kinds have none."""
    bag = F.map_entries(F.from_json(text, "map<string,string>"))
    records = F.from_json(text, "array<struct<key:string,name:string,value:string>>")
    listed = F.transform(F.filter(records, lambda r: r["value"].isNotNull()), lambda r: F.struct(F.coalesce(r["key"], r["name"]).alias("key"), r["value"].alias("value")))
    either = F.when(F.ltrim(text).startswith("["), listed).otherwise(bag)
    folded = F.transform(either, lambda e: F.struct(tx.fold(e["key"]).alias("key"), F.array_sort(F.array_distinct(F.transform(flat_values(e["value"]), tx.fold))).alias("values")))
    kept = F.filter(folded, lambda e: (e["key"] != "") & (F.size(e["values"]) > 0))
    return F.coalesce(kept, F.array().cast("array<struct<key:string,values:array<string>>>"))


def multi_bag(text: Column) -> Column:
    """Folded key -> sorted distinct values; of members with one folded key the last counts."""
    return F.map_from_entries(_last_of_each(multi_entries(text)))


def set_relation(a: Column, b: Column) -> Column:
    """How two sets of values differ: missing_one_side, specificity_difference (a common value, or one's text inside the
    other's), different_value; null where they don't."""
    x, y = F.array_join(F.array_sort(a), " "), F.array_join(F.array_sort(b), " ")
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return (
        F.when(empty_a & empty_b, None)
        .when(empty_a | empty_b, "missing_one_side")
        .when(x == y, None)
        .when(F.arrays_overlap(a, b) | x.contains(y) | y.contains(x), "specificity_difference")
        .otherwise("different_value")
    )


def entries(items: DataFrame, *columns: str) -> DataFrame:
    """One row for each attribute of each item: key, value."""
    return items.select(*columns, F.explode(parse(F.col("attributes"))).alias("key", "value"))


def key_frequency(items: DataFrame) -> DataFrame:
    """Items that hold each key, and their share of all items."""
    total = items.agg(F.count(F.lit(1)).alias("total"))
    return entries(items, "id").groupBy("key").agg(F.count_distinct("id").alias("items"), F.count(F.lit(1)).alias("occurrences")).join(F.broadcast(total)).withColumn("coverage", F.col("items") / F.col("total")).drop("total")


def coverage_by_category(items: DataFrame, keys: list[str]) -> DataFrame:
    sizes = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    found = entries(items, "category").groupBy("category").pivot("key", keys).agg(F.count(F.lit(1)))
    out = sizes.join(found, "category", "left")
    return out.select("category", *(F.round(F.coalesce(F.col(k), F.lit(0)) / F.col("n"), 6).alias(k) for k in keys))


def frequent_keys(items: DataFrame, coverage: float, support: int, most: int) -> DataFrame:
    """The most frequent keys until their share of all occurrences reaches ``coverage``, of at least that support."""
    counts = key_frequency(items)
    down = Window.orderBy(F.desc("occurrences"), F.desc("items"), "key")
    share = F.sum("occurrences").over(down.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("occurrences").over(Window.partitionBy())
    ranked = counts.select("key", "items", "occurrences", F.row_number().over(down).alias("rank"), F.coalesce(share, F.lit(0.0)).alias("before"))
    return ranked.filter((F.col("before") < coverage) & (F.col("items") >= support) & (F.col("rank") <= most)).select("key", "items", "occurrences", "rank")


def shared_key_comparison(pairs: DataFrame, bag_1: str = "bag_1", bag_2: str = "bag_2") -> DataFrame:
    """Of the keys that both bags of a pair hold: how many match, how many conflict, the share of matches."""
    keys = F.array_intersect(F.map_keys(bag_1), F.map_keys(bag_2))
    same = F.size(F.filter(keys, lambda k: F.element_at(bag_1, k) == F.element_at(bag_2, k)))
    out = pairs.withColumn("shared_keys", F.size(keys)).withColumn("matches", same)
    return out.withColumn("conflicts", F.col("shared_keys") - F.col("matches")).withColumn("match_ratio", F.when(F.col("shared_keys") > 0, F.col("matches") / F.col("shared_keys")).otherwise(0.0))


def discriminative_keys(pairs: DataFrame, most: int, bag_1: str = "bag_1", bag_2: str = "bag_2", smooth: float = 1.0) -> DataFrame:
    """Keys of each category whose equality tells most about the label: |P(1|equal) - P(1|conflict)| * log(1 + n)."""
    keys = F.array_intersect(F.map_keys(bag_1), F.map_keys(bag_2))
    rows = pairs.select("category", "target", bag_1, bag_2, F.explode(keys).alias("key"))
    rows = rows.select("category", "target", "key", (F.element_at(bag_1, F.col("key")) == F.element_at(bag_2, F.col("key"))).alias("equal"))
    n = rows.groupBy("category", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("equal").alias("n_equal"), F.sum(F.when(F.col("equal"), F.col("target")).otherwise(0)).alias("pos_equal"), F.sum("target").alias("pos"))
    rate_equal = (F.col("pos_equal") + smooth) / (F.col("n_equal") + 2 * smooth)
    rate_conflict = (F.col("pos") - F.col("pos_equal") + smooth) / (F.col("n") - F.col("n_equal") + 2 * smooth)
    scored = n.withColumn("strength", F.round(F.abs(rate_equal - rate_conflict) * F.log1p(F.col("n")), 9))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("strength"), "key"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most).select("category", "key", "n", "n_equal", "strength", "rank")


def changed_keys(a: Column, b: Column) -> Column:
    """Sorted keys whose values differ, or that one bag lacks."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k)))
