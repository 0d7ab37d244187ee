"""Similarity of pairs: serialisation, fuzzy ratios, weighted n-grams, feature builders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as nm, text as tx
from . import pairs as pr


def serialize(bag: Column, priority: list[str], separator: str = ". ") -> Column:
    """'key: value' of every entry, keys of the priority list first, in its order, the others by name."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(priority) for x in (k, i)))
    rows = F.transform(F.map_entries(bag), lambda e: F.struct(F.coalesce(F.element_at(rank, e["key"]), F.lit(len(priority))).alias("rank"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(rows), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), separator)


def balanced_budget(a: Column, b: Column, budget: int) -> tuple[Column, Column]:
    """Prefix lengths of two sequences that fit the budget together: a short one stays whole, two long ones halve it."""
    half = budget // 2
    first = F.when(a + b <= budget, a).otherwise(F.when(a <= half, a).when(b <= budget - half, budget - b).otherwise(half))
    return first, F.when(a + b <= budget, b).otherwise(budget - first)


def value_relation(a: Column, b: Column) -> Column:
    """How two values differ: missing on one side, one inside the other, different; null where they don't."""
    return (
        F.when(a.isNull() & b.isNull(), None)
        .when(a.isNull() | b.isNull(), "missing_one_side")
        .when(a == b, None)
        .when(a.contains(b) | b.contains(a), "specificity_difference")
        .otherwise("different_value")
    )


def lexical_fallback(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Token Jaccard, a quarter of it where the names' numbers are disjoint."""
    parsed = items.select("id", tx.tokens(F.col("name")).alias("tokens"), tx.numbers(F.col("name")).alias("numbers"))
    p = pr.hydrate(pairs, parsed, ("tokens", "numbers"))
    score = nm.jaccard(F.col("tokens_1"), F.col("tokens_2")) * F.when(nm.conflict(F.col("numbers_1"), F.col("numbers_2")), 0.25).otherwise(1.0)
    return p.withColumn("score", score)


def char_tfidf_cosine(pairs: DataFrame, items: DataFrame, low: int, high: int) -> DataFrame:
    """Cosine of binary n-gram vectors weighted by smoothed inverse document frequency. Grams are counted once over the
    catalogue; weighted vectors are maps made once an item, so a pair needs no join beyond its two items."""
    grams = pr.spread(items.select("id", "name")).select("id", F.explode(F.array_distinct(tx.padded_char_ngrams(tx.alnum_only(F.col("name")), low, high))).alias("g"))
    total = items.agg(F.count(F.lit(1)).alias("total"))
    idf = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("g", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("w"))
    bags = grams.join(idf.hint("merge"), "g").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("bag"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    p = pr.hydrate(pairs, bags, ("bag", "length"))
    shared = F.array_intersect(F.map_keys("bag_1"), F.map_keys("bag_2"))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, g: s + F.pow(F.element_at("bag_1", g), F.lit(2.0)))
    return p.withColumn("cosine", F.coalesce(dot / (F.col("length_1") * F.col("length_2")), F.lit(0.0)))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine word per row of the table, of as many bits as ``a`` has."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / summed length; 100 for two empty texts."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with each side's rest; 100 where one side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    ratios = [indel_ratio(one, two)]
    if both:
        ratios += [indel_ratio(both, one), indel_ratio(both, two)]
    return max(ratios)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any run of the longer one of at most its length, ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    if not n:
        return 100.0 if not m else 0.0
    if short in long:
        return 100.0
    best, letters = 0.0, set(short)
    for start in range(1 - n, m):
        lo, hi = max(0, start), min(m, start + n)
        edge = long[lo] if start < 0 and hi < m else long[hi - 1]
        if long[hi - 1] not in letters and edge not in letters:
            continue
        best = max(best, indel_ratio(short, long[lo:hi]))
    return best


def partial_token(a: str, b: str) -> float:
    """The better partial ratio of the sorted words and of the words that only one side has; 100 where words are shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain ratio, 0.95 of the token ratios and, where one text is 1.5 times as long or more, 0.9 (0.6 from 8
    times on) of the partial ratio and 0.95 of that for partial token ratios."""
    if not a or not b:
        return 0.0
    length = max(len(a), len(b)) / min(len(a), len(b))
    whole = indel_ratio(a, b)
    if length < 1.5:
        return max(whole, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if length < 8.0 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token(a, b))


def indel_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``indel_ratio`` of many pairs at once: one 64-bit word a pair holds a row of the table, for texts that fit it."""
    out = np.empty(len(pairs))
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    fits = [i for i, (a, b) in enumerate(short) if a and len(a) <= 64 and len(b) <= 512]
    done = set(fits)
    for i, (a, b) in enumerate(short):
        if i not in done:
            out[i] = indel_ratio(a, b)
    fits.sort(key=lambda i: len(short[i][1]))
    for lo in range(0, len(fits), 4096):
        part = fits[lo : lo + 4096]
        n = np.array([len(short[i][0]) for i in part])
        m = np.array([len(short[i][1]) for i in part])
        wide = int(n.max())
        a = np.array([short[i][0].ljust(wide, "\0") for i in part], f"<U{wide}").view(np.uint32).reshape(len(part), wide)
        b = np.array([short[i][1].ljust(int(m.max()), "\1") for i in part], f"<U{int(m.max())}").view(np.uint32).reshape(len(part), -1)
        bits = np.uint64(1) << np.arange(wide, dtype=np.uint64)
        full = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
        row = full.copy()
        for j in range(b.shape[1]):
            where = ((a == b[:, j, None]) * bits).sum(1, dtype=np.uint64) & full
            hit = row & where
            row = ((row + hit) | (row - hit)) & full
        common = n - np.bitwise_count(row).astype(np.int64)
        out[part] = 200.0 * common / (n + m)
    return out


def _token_sorts(pairs: list[tuple[str, str]]) -> np.ndarray:
    return indel_ratios([(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs])


def _token_sets(pairs: list[tuple[str, str]]) -> np.ndarray:
    out, asked, owner = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if both and (not left or not right):
            out[i] = 100.0
            continue
        one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
        for pair in [(one, two), (both, one), (both, two)] if both else [(one, two)]:
            asked.append(pair)
            owner.append(i)
    if asked:
        np.maximum.at(out, owner, indel_ratios(asked))
    return out


RATIOS = {"ratio": indel_ratios, "token_sort": _token_sorts, "token_set": _token_sets, "wratio": lambda pairs: np.array([weighted_ratio(a, b) for a, b in pairs])}


def with_ratios(df: DataFrame, left: str, right: str, named: dict[str, str], scale: float = 1.0) -> DataFrame:
    """Add fuzzy ratios (column -> one of ``RATIOS``) of two text columns, from Arrow batches: the one place where Catalyst
    lacks the measure. Only the two texts and a row's other columns as they are go through; equal pairs of a batch are
    measured once. Null texts are empty ones."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in named)])
    at = [df.columns.index(c) for c in (left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(zip(*([x or "" for x in batch.column(i).to_pylist()] for i in at)))
            number: dict[tuple[str, str], int] = {}
            which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
            distinct = list(number)
            made = [pa.array((RATIOS[kind](distinct) * scale)[which] if distinct else np.zeros(0)) for kind in named.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def fuzzy_ratios(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add ratio, token_sort_ratio and token_set_ratio."""
    return with_ratios(pairs, left, right, {"ratio": "ratio", "token_sort_ratio": "token_sort", "token_set_ratio": "token_set"})


def _dealt(items: DataFrame) -> DataFrame:
    """Items with a hash of their id (``__h``), dealt out by it to all tasks if they are beyond the bound of broadcasts."""
    keyed = items.withColumn("__h", F.xxhash64("id"))
    if pr.estimated_bytes(items) < pr.BROADCAST_BYTES:
        return keyed
    return keyed.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__h")


def ngram_count_cosine(pairs: DataFrame, items: DataFrame, text: Column, kind: str, low: int, high: int, sublinear: bool = False, idf: bool = False) -> DataFrame:
    """(id1, id2, cosine) of vectors of n-gram counts (``char``, within words, or ``word``), with 1 + log(count) if
    ``sublinear`` and smoothed inverse document frequencies over ``items`` if ``idf``."""
    # Dealt out by a hash of the id that stays a column: counts and bags of an item need no shuffle of its grams.
    dealt = _dealt(items.select("id", tx.alnum_only(text).alias("text")))
    folded = F.col("text")
    grams = tx.padded_char_ngrams(folded, low, high) if kind == "char" else tx.word_ngrams(F.filter(F.split(folded, " "), lambda w: w != ""), low, high)
    counts = dealt.select("__h", "id", F.explode(grams).alias("g")).groupBy("__h", "id", "g").agg(F.count(F.lit(1)).alias("tf"))
    weight = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    if idf:
        total = items.agg(F.count(F.lit(1)).alias("total"))
        known = counts.groupBy("g").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("g", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
        counts, weight = counts.join(known.hint("merge"), "g"), weight * F.col("idf")  # as many rows as there are grams, whatever the planner makes of it
    rows = counts.select("__h", "id", "g", weight.alias("w"))
    bags = rows.groupBy(*(["id"] if idf else ["__h", "id"])).agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("bag"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    p = pr.hydrate(pairs, bags, ("bag", "length"))
    shared = F.array_intersect(F.map_keys("bag_1"), F.map_keys("bag_2"))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, g: s + F.element_at("bag_1", g) * F.element_at("bag_2", g))
    return p.select(*pairs.columns, F.coalesce(dot / (F.col("length_1") * F.col("length_2")), F.lit(0.0)).alias("cosine"))
