"""Lexical retrieval, rank fusion, neighbours and quotas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import greedy as gd, pairs as pr, ranking as rk


def _words(text: str):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([0-9a-zа-я]+)"), 1)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of every document that shares a word with a query, or with their rank of the ``k`` best of each
    query (ties by id). Term counts are kept only for words that
    some query has, so the shuffle is of matches rather than of the corpus; frequencies and lengths cover all of it."""
    asked = queries.select("query_id", F.explode(F.array_distinct(_words("text"))).alias("t"))
    words = docs.select("id", _words("text").alias("w"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg(F.size("w")), F.lit(1.0)).alias("avgdl"))
    terms = words.select("id", F.size("w").alias("dl"), F.explode("w").alias("t")).join(asked.select("t").distinct(), "t", "left_semi")
    tf = terms.groupBy("t", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(stats)).select("t", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = asked.join(idf, "t").join(tf, "t")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    if k is None:
        return scores
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], constant: int, k: int) -> DataFrame:
    """Reciprocal rank fusion of scored lists (query_id, id, score), ties by id; the k best of each query."""
    rows = None
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    for scored, weight in lists:
        part = scored.select("query_id", "id", (F.lit(weight) / (constant + F.row_number().over(order))).alias("part"))
        rows = part if rows is None else rows.union(part)
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("score"))
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def water_fill(sizes: DataFrame, total: int) -> DataFrame:
    """Quotas that fill in proportion to weights, none over its capacity: each unit of a category is due at i / weight,
    and the first ``total`` are granted."""
    units = sizes.select("category", "weight", F.explode(F.sequence(F.lit(1), F.least("capacity", F.lit(total)))).alias("i"))
    due = units.withColumn("due", F.col("i") / F.col("weight")).orderBy("due", "category", "i").limit(total)
    return due.groupBy("category").agg(F.count(F.lit(1)).alias("quota"))


def greedy_matching(scored: DataFrame) -> DataFrame:
    """Pairs by descending score whose items weren't taken before."""
    placed = rk.running_sum(scored, None, [F.desc("score"), "id1", "id2"], "__place")
    ends = F.explode(F.array_distinct(F.array("id1", "id2")))
    members = placed.select(F.col("__place").alias("row"), F.col("__place").alias("place"), ends.alias("grp"), F.lit(1).alias("cap"))
    return placed.join(gd.capped(members).withColumnRenamed("row", "__place"), "__place", "left_semi").select("category", "id1", "id2", "score")


def nearest(vectors: DataFrame, k: int, part: int = 2048) -> DataFrame:
    """(a, b, cosine, rank): the k nearest other vectors of each vector (vec_id, block, e) in its block, ties by id. A block is
    cut into parts and every two parts meet in a task of their own, so that no block, however large, is one task; each
    hands on the k best of each vector."""
    sized = vectors.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    rows = vectors.join(pr.small(sized), "block").withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = rows.select("block", F.col("mine").alias("i"), every.alias("j"), "vec_id", "e")
    right = rows.select(F.col("block").alias("block_2"), every.alias("i_2"), F.col("mine").alias("j_2"), F.col("vec_id").alias("other"), F.col("e").alias("e_2"))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        x, y = np.array(a["e"].tolist(), np.float64), np.array(b["e_2"].tolist(), np.float64)
        x, y = (m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300) for m in (x, y))
        ids, others, out = a["vec_id"].to_numpy(), b["other"].to_numpy(), []
        for lo in range(0, len(x), 512):
            sims = np.round(x[lo : lo + 512] @ y.T, 9)
            sims[ids[lo : lo + 512, None] == others[None, :]] = -np.inf
            for i, row in enumerate(sims):
                top = np.lexsort((others, -row))[:k]
                top = top[np.isfinite(row[top])]
                out.append(pd.DataFrame({"a": ids[lo + i], "b": others[top], "cosine": row[top]}))
        return pd.concat(out)

    found = left.groupBy("block", "i", "j").cogroup(right.groupBy("block_2", "i_2", "j_2")).applyInPandas(tile, "a long, b long, cosine double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float, part: int = 1024) -> DataFrame:
    """(a, b, s): all pairs a < b of vectors (vec_id, block, e) of one block and one length whose cosine isn't below the
    threshold. Null vectors, blocks and components make no pair; a zero vector's cosine is NaN, which counts as the greatest
    number. Blocks are cut into parts, and every two parts meet in a task of their own as one matrix product."""
    sound = vectors.filter(F.col("vec_id").isNotNull() & F.col("block").isNotNull() & F.col("e").isNotNull()).filter(~F.exists("e", lambda x: x.isNull()))
    sound = sound.withColumn("n", F.size("e"))
    sized = sound.groupBy("block", "n").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    rows = sound.join(pr.small(sized), ["block", "n"]).withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    later, earlier = F.explode(F.sequence(F.col("mine"), F.col("parts") - 1)), F.explode(F.sequence(F.lit(0), F.col("mine")))
    left = rows.select("block", "n", F.col("mine").alias("i"), later.alias("j"), "vec_id", "e")
    right = rows.select(F.col("block").alias("block_2"), F.col("n").alias("n_2"), earlier.alias("i_2"), F.col("mine").alias("j_2"), F.col("vec_id").alias("other"), F.col("e").alias("e_2"))

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64")})
        same = a["i"].iloc[0] == a["j"].iloc[0]
        x, y = (np.array(rows.tolist(), np.float64).reshape(len(rows), -1) for rows in (a["e"], b["e_2"]))
        ids, others = a["vec_id"].to_numpy(), b["other"].to_numpy()
        with np.errstate(all="ignore"):
            sims = x @ y.T / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1)))
        kept = ~(sims < threshold) & ((ids[:, None] < others) if same else (ids[:, None] != others))
        r, c = np.nonzero(kept)
        return pd.DataFrame({"a": np.minimum(ids[r], others[c]), "b": np.maximum(ids[r], others[c]), "s": sims[r, c]})

    return left.groupBy("block", "n", "i", "j").cogroup(right.groupBy("block_2", "n_2", "i_2", "j_2")).applyInPandas(tile, "a long, b long, s double")


def mutual(neighbours: DataFrame, threshold: float) -> DataFrame:
    """Pairs of neighbours, in both directions, each among the other's nearest, of at least that cosine."""
    good = neighbours.filter(F.col("cosine") + 1e-7 >= threshold).select("a", "b", "cosine")
    return good.join(good.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])


def pooled_evidence(nodes: DataFrame, links: DataFrame, forbidden: DataFrame, columns: list[str]) -> DataFrame:
    """(node, neighbours, and each column summed over a node and its linked neighbours, weighted by similarity). Links whose
    concepts may not be joined (``forbidden``: concept_a, concept_b, either way) don't count. ``nodes`` has node and concept."""
    named = links.join(nodes.select(F.col("node").alias("a"), F.col("concept").alias("ca")), "a").join(nodes.select(F.col("node").alias("b"), F.col("concept").alias("cb")), "b")
    bad = forbidden.select(F.least("concept_a", "concept_b").alias("lo"), F.greatest("concept_a", "concept_b").alias("hi")).distinct()
    named = named.withColumn("lo", F.least("ca", "cb")).withColumn("hi", F.greatest("ca", "cb")).join(bad, ["lo", "hi"], "left_anti")
    own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("cosine"))
    every = named.select("a", "b", "cosine").unionByName(own)
    values = nodes.select(F.col("node").alias("b"), *columns)
    return every.join(values, "b").groupBy(F.col("a").alias("node")).agg((F.count(F.lit(1)) - 1).alias("neighbours"), *(F.sum(F.col(c) * F.col("cosine")).alias(c) for c in columns))


def hybrid(bank: DataFrame, asked: Column, k: int, least_pool: int = 8, dense: float = 0.55, lexical: float = 0.45, constant: int = 20, part: int = 512) -> DataFrame:
    """(query_id, id, rank, score): for each item of the bank (id, category, subtype, name, text, e) where ``asked`` holds, the k
    best others of its pool by reciprocal rank fusion of vector products and BM25 within the pool. The pool is the item's
    category and subtype, or the whole category where that has fewer than max(least_pool, k + 1) items; items with the
    query's folded name don't count. Ties go to smaller ids.

    A pool's queries are cut into parts of about ``part``; each part meets the pool's documents in a task of its own, as arrays,
    so that no pair of a query and a document becomes a row (``_Pool``)."""
    keys = ["category", "whole", "sub"]
    rows = bank.withColumn("folded", tx.fold(F.col("name"))).withColumn("w", F.array_join(_words("text"), " ")).withColumn("e", F.when(~F.exists("e", lambda x: x.isNull()), F.col("e").cast("array<double>")))
    sizes = rows.groupBy("category", "subtype").agg(F.count(F.lit(1)).alias("pool"))
    whole = F.col("pool") < max(least_pool, k + 1)
    queries = rows.filter(asked).join(pr.small(sizes), ["category", "subtype"]).select("category", whole.alias("whole"), F.when(whole, "").otherwise(F.col("subtype")).alias("sub"), "id", "folded", "w", "e")
    parts = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    left = queries.join(pr.small(parts), keys).select(*keys, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("i"), "id", "folded", "w", "e")
    pools = F.explode(F.array(F.struct(F.lit(False).alias("whole"), F.col("subtype").alias("sub")), F.struct(F.lit(True).alias("whole"), F.lit("").alias("sub"))))
    docs = rows.select("category", "id", "folded", "w", "e", pools.alias("p")).select("category", "p.whole", "p.sub", "id", "folded", "w", "e").join(pr.small(parts), keys)
    right = docs.select(*(F.col(c).alias(f"{c}_2") for c in (*keys, "id", "folded", "w", "e")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i_2"))

    def best(asking: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": asking["id"].iloc[:0], "id": asking["id"].iloc[:0], "rank": np.zeros(0, np.int32), "score": np.zeros(0)})]
        if len(asking):
            pool = _Pool(docs)
            for query, own, words, e in zip(asking["id"], asking["folded"], asking["w"], asking["e"]):
                ids, scores = pool.fused(query, own, words, e, k, dense, lexical, constant)
                out.append(pd.DataFrame({"query_id": query, "id": ids, "rank": np.arange(1, len(ids) + 1, dtype=np.int32), "score": scores}))
        return pd.concat(out, ignore_index=True)

    kind = dict(bank.dtypes)["id"]
    return left.groupBy(*keys, "i").cogroup(right.groupBy(*(f"{c}_2" for c in keys), "i_2")).applyInPandas(best, f"query_id {kind}, id {kind}, rank int, score double")


def _round(x: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero, as in SQL."""
    scaled = x * 10.0**places
    return np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**places


class _Pool:
    """Documents (id_2, folded_2, w_2, e_2) by ascending id, their words as postings, and each distinct vector once."""

    def __init__(self, docs: pd.DataFrame):
        docs = docs.sort_values("id_2", ignore_index=True)
        self.ids = docs["id_2"].to_numpy()
        self.name: dict[str, int] = {}
        self.own = np.array([self.name.setdefault(x, len(self.name)) for x in docs["folded_2"]], np.int64)
        at: dict[str, list[int]] = {}
        words = [x.split() for x in docs["w_2"]]
        self.length = np.array([len(x) for x in words], np.float64)
        for i, row in enumerate(words):
            for t in row:
                at.setdefault(t, []).append(i)
        self.postings: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for t in list(at):  # a document holds a word as often as it comes in the word's list
            self.postings[t] = np.unique(np.array(at.pop(t), np.int64), return_counts=True)
        number: dict[bytes | None, int] = {}
        vectors: list[np.ndarray] = []
        which = []
        for e in docs["e_2"]:
            key = None if e is None else np.asarray(e, np.float64).tobytes()
            if key not in number:
                number[key] = len(number)
                vectors.append(np.zeros(0) if e is None else np.asarray(e, np.float64))
            which.append(number[key])
        self.which = np.array(which, np.int64)
        self.sizes = np.array([len(x) for x in vectors])
        if None in number:
            self.sizes[number[None]] = -1
        self.axes = np.zeros((max(map(len, vectors), default=0), len(vectors)))
        for j, x in enumerate(vectors):
            self.axes[: len(x), j] = x

    def products(self, e: np.ndarray | None) -> np.ndarray:
        """Vector products to nine places, added up in the order of the components; as places in an order, so that what has no
        product (a missing vector, another length) comes last and NaN first."""
        if e is None:
            return np.full(len(self.ids), -np.inf)
        total = np.zeros(self.axes.shape[1])
        with np.errstate(all="ignore"):
            for x, axis in zip(e, self.axes):
                total += x * axis
            total = _round(total, 9)
        total[np.isnan(total)] = np.inf
        total[self.sizes != len(e)] = -np.inf
        return total[self.which]

    def fused(self, query: object, own: str, words: str, e: np.ndarray | None, k: int, dense: float, lexical: float, constant: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents but those of the query's own name."""
        out = (self.own == self.name.get(own, -1)) | (self.ids == query)
        keep = np.flatnonzero(~out)
        n = len(keep)
        if not n:
            return self.ids[:0], np.zeros(0)
        norm = 1.5 * (0.25 + 0.75 * self.length / max(self.length[keep].sum() / n, 1.0))
        total = np.zeros(len(self.ids))
        for t in dict.fromkeys(words.split()):
            if t in self.postings:
                docs, tf = self.postings[t]
                df = len(docs) - np.count_nonzero(out[docs])
                total[docs] += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + norm[docs])
        lists = [self.products(e)[keep], _round(total[keep], 9)]
        # Who is beyond this place in both lists scores less than the k-th of the list of the greater weight.
        least = max(dense, lexical) / (constant + k)
        far = n if min(dense, lexical) < 0 or least <= 0 else min(n, int(np.ceil((dense + lexical) / least - constant)) + 1)
        chosen = np.unique(np.concatenate([_first(s, far) for s in lists]))
        scores = _round(sum(w / (constant + _places(s, chosen)) for w, s in zip((dense, lexical), lists)), 12)
        top = np.lexsort((chosen, -scores))[:k]
        return self.ids[keep[chosen[top]]], scores[top]


def _first(scores: np.ndarray, n: int) -> np.ndarray:
    """Where the n greatest scores are, the earlier of equal ones first taken."""
    if n >= len(scores):
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: n - len(above)]])


def _places(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places, from 1, that the scores at these positions have in descending order, the earlier of equal ones first."""
    if len(at) > 256:
        place = np.empty(len(scores), np.int64)
        place[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
        return place[at]
    return np.array([np.count_nonzero(scores > scores[i]) + np.count_nonzero(scores[:i] == scores[i]) + 1 for i in at], np.int64)
