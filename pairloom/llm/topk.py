"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights. A pack of candidates is inverted into postings, one list a dimension;
every query walks its nonzero terms and scatters weight times weight into a dense array of scores (lists that hold most
candidates are kept as dense rows and added whole). Selection partitions each score array around its k-th value, ties go
to smaller ids, and the packs' winners are merged by rank. Packs of queries meet packs of candidates in a grid of tasks.

Cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors of
different lengths meet on the dimensions that they share; repeated candidate rows count each, repeated query rows once;
rows with the query's own id aren't its candidates; fewer than k candidates are all returned; no query or no candidate
gives an empty table; other columns are ignored. Weights beyond 2**31 are outside the contract of a long score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vectors import MOST_PARTS, PACK, blocks_for, in_packs, packs_for, usable

QUERY_PACK = 2048
#: Postings that hold this share of a pack are kept dense.
DENSE = 0.25


def _pack(rows: DataFrame, kind: str) -> DataFrame:
    """One row a partition: its ids, and its weights as a CSR triple (as ``_bytes`` writes them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, terms, weights = [], [], [], []
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(lists.offsets.to_numpy())
            term = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(n)), n)
            some = flat != 0
            ids.append(batch.column(0).to_numpy())
            sizes.append(np.bincount(row[some], minlength=len(n)))
            terms.append(term[some])
            weights.append(flat[some])
        if ids:
            data = [np.concatenate(x) for x in (ids, sizes, terms, weights)]
            made = {"pack": pa.array([TaskContext.get().partitionId()], pa.int32())}
            yield pa.record_batch(made | {c: pa.array([_bytes(x)], pa.binary()) for c, x in zip(("ids", "sizes", "terms", "weights"), data)})

    packed = rows.mapInArrow(run, "pack int, ids binary, sizes binary, terms binary, weights binary")
    return common.materialize(packed, kind)


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, behind one byte that tells how many: packs are copied often."""
    size = next((n for n in (1, 2, 4) if not len(x) or (-(1 << 8 * n - 1) <= x.min() and x.max() < 1 << 8 * n - 1)), 8)
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


class Postings:
    """A pack of candidates, inverted: for each term the candidates that hold it and their weights."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, kind):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        at = place[np.repeat(np.arange(len(ids)), sizes)]
        by = np.argsort(terms, kind="stable")
        names, first = np.unique(terms[by], return_index=True)
        self.lists: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for t, lo, hi in zip(names.tolist(), first, np.append(first[1:], len(by))):
            who, w = at[by[lo:hi]], weights[by[lo:hi]].astype(kind)
            if len(who) >= DENSE * len(ids):
                row = np.zeros(len(ids), kind)
                row[who] = w
                self.lists[t] = (None, row)
            else:
                self.lists[t] = (who, w)

    def scores(self, terms: np.ndarray, weights: np.ndarray, kind) -> np.ndarray:
        total = np.zeros(len(self.ids), kind)
        for t, q in zip(terms.tolist(), weights.tolist()):
            held = self.lists.get(t)
            if held is None:
                continue
            who, w = held
            if who is None:
                total += w * kind(q)
            else:
                total[who] += w * kind(q)  # a candidate is in a list once
        return total


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, best first, ties to the smaller place."""
    if len(scores) > k:
        level = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > level)
        found = np.concatenate([above, np.flatnonzero(scores == level)[: k - len(above)]])
    else:
        found = np.arange(len(scores))
    return found[np.lexsort((found, -scores[found]))]


def top_k(table: DataFrame, is_query: Column, weights: Column, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates for each row where ``is_query`` holds. ``weights`` is an
    array<long> column, null for rows that take no part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), weights.alias("w"), is_query.alias("q")).filter("id is not null and w is not null")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    c_packs, q_packs = packs_for(sums.n, min(16384, max(PACK, sums.n // 64))), packs_for(sums.q or 0, QUERY_PACK)
    candidates = _pack(in_packs(rows.select("id", "w"), c_packs), "candidates")
    queries = _pack(in_packs(rows.filter("q").select("id", "w").dropDuplicates(["id"]), q_packs), "queries")
    (c_each, c_blocks), (q_each, q_blocks) = blocks_for(c_packs), blocks_for(q_packs)
    fields = ("ids", "sizes", "terms", "weights")
    left = candidates.select(F.expr(f"pack div {c_each}").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("y"), *fields)
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("x"), F.expr(f"pack div {q_each}").alias("y"), *(F.col(c).alias(f"q_{c}") for c in fields))
    dealt = left.withColumn("x", F.col("x").cast("int")).withColumn("y", F.col("y").cast("int")).repartition(min(MOST_PARTS, c_blocks * q_blocks), "x", "y")
    right = right.withColumn("x", F.col("x").cast("int")).withColumn("y", F.col("y").cast("int"))
    grid = dealt.join(right.hint("merge"), ["x", "y"])  # packed files are small, their rows are not: never broadcast
    names = ["ids", "sizes", "terms", "weights", "q_ids", "q_sizes", "q_terms", "q_weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, terms, w, q_ids, q_sizes, q_terms, q_w = (_ints(batch.column(c)[i].as_py()) for c in range(8))
                most = int(np.abs(w).max(initial=0)) * int(np.abs(q_w).max(initial=0)) * int(max(sizes.max(initial=0), 1))
                kind = np.int32 if most < 1 << 31 else np.int64
                postings = Postings(ids, sizes, terms, w, kind)
                end = np.cumsum(q_sizes)
                found = []
                for q, lo, hi in zip(q_ids.tolist(), end - q_sizes, end):
                    scores = postings.scores(q_terms[lo:hi], q_w[lo:hi], kind)
                    at = best(scores, k + int(np.searchsorted(postings.ids, q, "right") - np.searchsorted(postings.ids, q)))
                    at = at[postings.ids[at] != q][:k]
                    found.append((np.full(len(at), q), postings.ids[at], scores[at].astype(np.int64)))
                if found:
                    yield pa.record_batch(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    near = grid.select(*names).mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector of ``embeddings`` against all others, components floor(64 x)."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 64))
    return top_k(table, F.col("vec_id") % 20 == 0, F.when(usable(F.col("embedding")), whole), 20)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
