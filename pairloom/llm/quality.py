"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every whole text are computed once. Labelled rows add up to normal equations, a matrix a partition and
fold, summed in a tree; the driver solves systems of ``FEATURES`` + 1 unknowns. The scores that each fold gets from
the other fold's fit, counted in ``BINS`` bins, are calibrated by pooling adjacent violators.

Cases: null and empty texts have statistics of zero and are scored; a null doc_id counts as an empty key for the held-out
rule and has no label; several labels of a doc_id all count; null labels don't; with no label, or one class only, every
score is the share of label 1 (0.5 without labels); repeated rows are scored alike; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Random features, their bandwidth in standard deviations, the ridge for each labelled row, bins of the calibration.
FEATURES, BANDWIDTH, RIDGE, BINS, SEED = 128, 6.0, 1e-4, 512, 7

_CLASS = np.zeros((9, 256), bool)
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (9, 10, 11, 12, 13), range(128, 256), b".,;:'\"-", b"!?", b"#$%&*<>{}|\\^~@_=+/[]()")):
    _CLASS[_i, list(_set)] = True
STATS = 24


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of distinct keys and how often its most frequent one occurs."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    if not len(k):
        return np.zeros(rows), np.zeros(rows)
    head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
    run = np.diff(np.append(head, len(k)))
    most = np.zeros(rows)
    np.maximum.at(most, o[head], run)
    return np.bincount(o[head], minlength=rows).astype(float), most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics (rows x STATS) of the texts in a byte buffer."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, first = common.word_bounds(raw, offsets)
    n = np.diff(first).astype(float)
    owner = np.repeat(np.arange(rows), np.diff(first))
    out = np.zeros((rows, STATS))
    some, words = np.maximum(size, 1), np.maximum(n, 1)
    for i in range(len(_CLASS)):
        out[:, i] = _per_row(_CLASS[i][raw], offsets) / some
    length = (ends - starts).astype(float)
    out[:, 9] = np.log1p(size)
    out[:, 10] = np.log1p(n)
    mean = np.bincount(owner, length, rows) / words
    out[:, 11] = mean
    out[:, 12] = np.sqrt(np.maximum(np.bincount(owner, length**2, rows) / words - mean**2, 0))
    most = np.zeros(rows)
    np.maximum.at(most, owner, length)
    out[:, 13] = np.log1p(most)
    if not len(starts):
        return out
    out[:, 14] = np.bincount(owner, length <= 3, rows) / words
    out[:, 15] = np.bincount(owner, length > 14, rows) / words
    hashed = common.word_hashes(raw, starts, ends)
    distinct, top = _repeats(hashed, owner, rows)
    out[:, 16], out[:, 17] = distinct / words, top / words
    out[:, 18] = distinct / np.sqrt(words)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    distinct, top = _repeats(common.mix64(hashed[pair]) + hashed[pair + 1], owner[pair], rows)
    out[:, 19], out[:, 20] = distinct / words, top / words
    upper = _CLASS[1][raw]
    out[:, 21] = np.bincount(owner, upper[starts], rows) / words
    out[:, 22] = np.bincount(owner, upper[starts] & upper[ends - 1] & (length > 1), rows) / words
    line = _per_row(raw == 10, offsets)
    out[:, 23] = np.log1p(n / (line + 1))
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("quality")
        for batch in batches:
            for lo, hi, raw, offsets in common.text_slices(batch.column(1)):
                flat = pa.array(statistics(raw, offsets).ravel())
                at = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * STATS)
                yield pa.record_batch({"doc_id": batch.column(0).slice(lo, hi - lo), "stats": pa.ListArray.from_arrays(at, flat)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def _stats_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)


class Features:
    """Standardised statistics under random cosines, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.spread = mean, spread
        self.w = rng.standard_normal((STATS, FEATURES)) / BANDWIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])


#: Vectors that one task adds up.
FAN_IN = 64


def _summed(df: DataFrame, fn, size: int) -> dict[int, np.ndarray]:
    """Sums over all partitions of the vectors of ``size`` that ``fn(batches)`` gives for each key, added up in a tree:
    at most ``FAN_IN`` vectors meet in a task, in the order of their partitions."""
    schema = "k int, part int, v binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, v in fn(batches).items():
            yield pa.record_batch({"k": pa.array([k], pa.int32()), "part": pa.array([part], pa.int32()), "v": pa.array([v.astype(np.float64).tobytes()], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for v in frame.sort_values("part")["v"]:
            total += np.frombuffer(v)
        return pd.DataFrame({"k": frame["k"].iloc[:1], "part": frame["part"].iloc[:1] // FAN_IN, "v": [total.tobytes()]})

    rows, left = df.mapInArrow(run, schema), df.rdd.getNumPartitions()
    while left > 1:
        rows = rows.groupBy("k", F.expr(f"part div {FAN_IN}")).applyInPandas(add, schema)
        left = -(-left // FAN_IN)
    return {r.k: np.frombuffer(r.v) for r in rows.collect()}


def pool_violators(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The rising step function closest to the bins' mean labels: one value for each bin with weight, NaN elsewhere."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(weight > 0):
        blocks.append([total[i], weight[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2], hi]
    out = np.full(len(weight), np.nan)
    for t, w, lo, hi in blocks:
        out[int(lo) : int(hi) + 1] = t / w
    return np.where(weight > 0, out, np.nan)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def fit(learn: DataFrame):
    """A scorer (statistics -> scores) from rows (stats, y, fold in 0, 1)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> dict:
        total = np.zeros(2 * STATS + 2)
        for batch in batches:
            x, y = _stats_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            total += np.concatenate([x.sum(0), (x**2).sum(0), [len(x), y.sum()]])
        return {0: total}

    sums = _summed(learn, moments, 2 * STATS + 2).get(0, np.zeros(2 * STATS + 2))
    n, ones = sums[-2], sums[-1]
    if not n or ones in (0, n):
        level = ones / n if n else 0.5
        return lambda stats: np.full(len(stats), level)
    mean = sums[:STATS] / n
    features = Features(mean, np.sqrt(np.maximum(sums[STATS : 2 * STATS] / n - mean**2, 1e-12)) + 1e-9)
    d = FEATURES + 1
    upper = np.triu_indices(d)

    def equations(batches: Iterator[pa.RecordBatch]) -> dict:
        out: dict = {}
        for batch in batches:
            z, y, fold = features(_stats_of(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                a, b = z[fold == f], y[fold == f]
                v = np.concatenate([(a.T @ a)[upper], a.T @ b, [len(a)]])
                out[int(f)] = out.get(int(f), 0) + v
        return out

    size = len(upper[0]) + d + 1
    folds = _summed(learn, equations, size)

    def solve(v: np.ndarray) -> np.ndarray:
        a = np.zeros((d, d))
        a[upper] = v[: len(upper[0])]
        a = a + np.triu(a, 1).T
        return np.linalg.solve(a + RIDGE * max(v[-1], 1.0) / FEATURES * np.eye(d), v[len(upper[0]) : -1])

    whole = solve(sum(folds.values()))
    apart = {f: solve(folds[1 - f]) if 1 - f in folds else whole for f in (0, 1)}

    def tally(batches: Iterator[pa.RecordBatch]) -> dict:
        count = np.zeros((2, BINS))
        for batch in batches:
            z, y, fold = features(_stats_of(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            at = _bin(np.where(fold == 0, z @ apart[0], z @ apart[1]))
            np.add.at(count[0], at, 1.0)
            np.add.at(count[1], at, y)
        return {0: count.ravel()}

    weight, total = _summed(learn, tally, 2 * BINS)[0].reshape(2, BINS)
    level = pool_violators(weight, total)
    seen = np.flatnonzero(~np.isnan(level))
    middle = (seen + 0.5) / BINS * 2 - 0.5

    def score(stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(features(stats) @ whole, middle, level[seen]), 0.0, 1.0)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, learn_if, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) of every row of ``docs``, learned from the labels of rows where ``learn_if`` holds."""
    common.bound_batches(docs.sparkSession)
    stats = common.materialize(document_statistics(docs, id_col, text_col), "statistics")
    named = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    fold = (F.crc32(F.col("doc_id").cast("string")) % 2).cast("int")
    learn = common.materialize(stats.filter(learn_if).join(named, "doc_id").select("stats", "y", fold.alias("fold")), "labelled")
    scorer = fit(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"doc_id": batch.column(0), "score": scorer(_stats_of(batch.column(1)))})

    return stats.mapInArrow(run, "doc_id long, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learned from ``labels`` of the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
