"""Embedding near-duplicates by quantised tile products with error bounds.

Equal vectors form one class. Classes are dealt into packs; each pair of packs is one tile. Unit vectors are quantised to
int8 with a scale of their own, and the exact length of what quantisation took off bounds the error of any product: with
u = p + d and v = q + e, |u.v - p.q| <= |d| + |e| + |d||e|. Products of the integers are exact (kept in 32-bit floats,
whose 24 bits hold them up to 1000 dimensions; wider vectors use doubles). Only pairs whose product plus bound reaches
the threshold are recomputed in double precision. A tile hands on counts and a spanning forest of its links, never all
pairs of a group.

Cases: null, zero and empty vectors and those with null or non-finite components link with nothing and are kept as their
own component; repeated rows and equal vectors link with one another; vectors of different lengths never link; a null
vec_id takes part, and a component of only such rows has component_id null; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import _forest
from .vectors import PACK, in_packs, packs_for, pairs_of_packs, usable


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 values (as floats), scales, and upper bounds of the quantisation errors' lengths."""
    largest = np.abs(x).max(1, keepdims=True)
    x = x / largest  # no overflow of squares
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(unit).max(1, keepdims=True) / 127
    q = np.rint(unit / scale)
    off = np.sqrt(((unit - q * scale) ** 2).sum(1)) + 1e-12
    return unit, q.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale[:, 0], off


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) of cosine >= threshold, a run of rows at a time; with ``same`` (a is b) each pair once."""
    ua, qa, sa, ea = quantise(a)
    ub, qb, sb, eb = (ua, qa, sa, ea) if same else quantise(b)
    a, b = _bounded(a), _bounded(b)
    worst = eb.max()
    widest = sb.max()
    for lo in range(0, len(a), 512):
        hi = min(lo + 512, len(a))
        product = qa[lo:hi] @ qb.T
        need = (threshold - ea[lo:hi] - worst * (1 + ea[lo:hi]) - 1e-9) / (sa[lo:hi] * widest)
        x, y = np.nonzero(product >= need[:, None].astype(product.dtype) * product.dtype.type(1 - 1e-6))
        if same:
            go = x + lo < y
            x, y = x[go], y[go]
        near = product[x, y].astype(float) * sa[lo + x] * sb[y]
        go = near + ea[lo + x] + eb[y] + ea[lo + x] * eb[y] + 1e-9 >= threshold
        x, y = x[go] + lo, y[go]
        for at in range(0, len(x), 200_000):
            i, j = x[at : at + 200_000], y[at : at + 200_000]
            exact = np.einsum("ij,ij->i", a[i], b[j]) / (np.sqrt(np.einsum("ij,ij->i", a[i], a[i])) * np.sqrt(np.einsum("ij,ij->i", b[j], b[j])))
            good = exact >= threshold
            yield i[good], j[good]


def _bounded(x: np.ndarray) -> np.ndarray:
    """The vectors themselves, scaled by a power of two (which is exact) where squares could leave the range of doubles."""
    largest = np.abs(x).max(1, initial=0)
    far = (largest > 1e100) | (largest < 1e-100)
    if not far.any():
        return x
    scale = np.where(far & (largest > 0), -np.frexp(largest)[1], 0)
    return np.ldexp(x, scale[:, None])


def near_duplicates(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: others linked directly at cosine >= threshold, the least id
    reachable by links, and whether that is the row's own."""
    vector = F.col(vector_col)
    wide = vector.cast("array<double>")
    live = usable(vector) & F.coalesce(F.exists(wide, lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(live, F.transform(wide, lambda x: x + F.lit(0.0))).alias("v"))
    # 128 bits name a vector, and each class has a number of its own from there on
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    classes = rows.filter("v is not null").groupBy("v").agg(F.first("h").alias("h"), F.first("h2").alias("h2"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    classes = common.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    packs = packs_for(n, min(16384, max(PACK, n // 64)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            node, times = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                held.setdefault(int(d), []).append((node[at], times[at], flat[(ends[at] - d)[:, None] + np.arange(d)]))
        here = TaskContext.get().partitionId()
        for d, parts in held.items():
            data = [np.concatenate(x) for x in zip(*parts)]
            made = {"pack": pa.array([here], pa.int32()), "d": pa.array([d], pa.int32())}
            yield pa.record_batch(made | {c: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for c, x in zip(("node", "times", "v"), data)})

    packed = common.materialize(in_packs(classes.select("node", "times", "v"), packs).mapInArrow(pack, "pack int, d int, node binary, times binary, v binary"), "packs")
    columns = ("node", "times", "v")
    grid = pairs_of_packs(packed, packs, columns)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                d, i, j, node, times, v, node_2, times_2, v_2 = (batch.column(c)[r].as_py() for c in range(9))
                a, b = np.frombuffer(v).reshape(-1, d), np.frombuffer(v_2).reshape(-1, d)
                node, times, node_2, times_2 = (np.frombuffer(x, np.int64) for x in (node, times, node_2, times_2))
                shift = 0 if i == j else len(a)
                who = node if i == j else np.concatenate([node, node_2])
                count = np.zeros(len(who), np.int64)
                fx = fy = np.zeros(0, np.int64)
                for x, y in tile_links(a, b, i == j, threshold):
                    np.add.at(count, x, times_2[y])
                    np.add.at(count, y + shift, times[x])
                    fx, fy = np.concatenate([fx, x]), np.concatenate([fy, y + shift])
                    if len(fx) > 4 * len(who):
                        fx, fy = _forest(fx, fy, len(who))
                if not len(fx):
                    continue
                some = np.flatnonzero(count)
                yield pa.record_batch({"a": who[some], "b": pa.nulls(len(some), pa.int64()), "n": count[some]})
                fx, fy = _forest(fx, fy, len(who))
                yield pa.record_batch({"a": who[fx], "b": pa.array(who[fy]), "n": np.zeros(len(fx), np.int64)})

    found = common.materialize(grid.mapInArrow(tile, "a long, b long, n long"), "tiles")
    common.release(packed)
    roots = connected_components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.select("node", "times", "least").join(counts, "node", "left").join(roots, "node", "left")
    named = common.materialize(named.select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("node", "n_links", "component_id")
    alone = rows.filter("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    named = named.join(classes.select("node", "h", "h2"), "node")
    linked = rows.filter("h is not null").select("vec_id", "h", "h2").join(named, ["h", "h2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all rows of ``embeddings`` of cosine 0.95 or more, whatever their labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


ORACLE = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, root) as (select distinct a, a from links union select l.b, r.root from reach r join links l on l.a = r.id and r.root < l.b),
roots as (select id, min(root) as root from reach group by id),
counts as (select a as id, count(*) as n from links group by a)
select m.vec_id, coalesce(c.n, 0) as n_links, coalesce(r.root, m.vec_id) as component_id, coalesce(r.root, m.vec_id) = m.vec_id as kept
from embeddings m left join roots r on r.id = m.vec_id left join counts c on c.id = m.vec_id
"""
