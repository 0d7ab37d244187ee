"""Language identification with a string kernel.

The kernel of two texts is the normalised number of blended n-grams (1 to 4 characters of the lower-cased text, hashed to
``DIM`` slots) that both hold. A bounded sample of labelled rows is fitted: landmarks from it span a Nyström space, in
which one-versus-rest ridge regression is solved. As the kernel is an inner product of presence vectors, landmarks and
weights fold into one matrix, and scoring is a batched product of presence vectors with it. Every whole text is scored.

Cases: a null text, and one without a letter, is ``und`` with score 0; a null doc_id counts as an empty key for the
held-out rule; rows without a lang aren't learned from; without any labelled row every text is ``und``; repeated rows are
scored alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bound_batches, worker_cache

#: Slots of the presence vectors; the most labelled rows that are fitted (over all languages); landmarks; ridge.
DIM, TRAIN_ROWS, LANDMARKS, RIDGE = 1 << 15, 3000, 384, 1e-2
LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str]) -> np.ndarray:
    """Which hashed n-grams each text holds (rows x DIM, bool)."""
    out = np.zeros((len(texts), DIM), bool)
    for row, text in zip(out, texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(U64)
        for lo in range(0, len(codes), 1 << 20):
            part = codes[lo : lo + (1 << 20) + 3]
            gram = part
            for n in range(1, 5):
                if n > 1:
                    gram = gram[:-1] * U64(0x100000001B3) + part[n - 1 :]
                if not len(gram):
                    break
                row[((gram + U64(n)) * U64(0x9E3779B97F4A7C15) >> U64(49)).astype(np.int64)] = True
    return out


def fit(packed: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Classes and the folded matrix (DIM x classes): scores are presence @ matrix / sqrt(n-grams present). ``packed`` has
    the rows' presence bits; only the landmarks and a few rows at a time are unpacked."""
    classes = sorted(set(labels))
    norm = np.sqrt(np.maximum(np.bitwise_count(packed).sum(1, dtype=np.int64), 1.0))
    chosen: list[int] = []
    rows = {c: [i for i, y in enumerate(labels) if y == c] for c in classes}
    for c in classes:
        chosen += rows[c][: max(1, LANDMARKS // len(classes))]
    marks = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
    marks /= norm[chosen, None].astype(np.float32)
    kernel = np.empty((len(packed), len(chosen)))
    for lo in range(0, len(packed), 128):
        kernel[lo : lo + 128] = np.unpackbits(packed[lo : lo + 128], axis=1).astype(np.float32) @ marks.T / norm[lo : lo + 128, None]
    own = kernel[chosen]
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = kernel @ root
    y = np.where(np.array(labels)[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]) / z.shape[1], z.T @ y)
    return classes, (marks.T @ (root @ weights).astype(np.float32)).astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Fit on the rows that ``examples`` picks."""
    packed, labels = examples(docs, id_col, text_col, lang_col)
    return fit(packed, labels) if labels else ([], np.zeros((DIM, 0), np.float32))


def outputs(packed: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The ridge outputs of packed presence vectors, a few rows at a time."""
    norm = np.sqrt(np.maximum(np.bitwise_count(packed).sum(1, dtype=np.int64), 1.0))
    parts = [np.unpackbits(packed[lo : lo + 128], axis=1).astype(np.float32) @ matrix for lo in range(0, len(packed), 128)]
    return np.concatenate(parts) / norm[:, None]


def _lead(s: np.ndarray) -> np.ndarray:
    """By how much the best output is above the least, which stays wide where a text mixes languages; 2 where there is
    but one output."""
    return s.max(1) - s.min(1) if s.shape[1] > 1 else np.full(len(s), 2.0)


def least_fit(packed: np.ndarray, labels: list[str], share: float = 0.02) -> tuple[float, float]:
    """Score and lead (best output less the least) below which a text fits no language. Each half of the rows is judged
    by a fit of the other; of the language with the lowest ``share`` quantile, the lead is half of the way from 0, where
    texts without evidence lie. Texts that mix languages may score low, so the score only counts where there is one
    language, a quarter of the way from 0.5."""
    y = np.array(labels)
    half = np.zeros(len(y), int)
    for c in set(labels):
        own = np.flatnonzero(y == c)
        half[own] = np.arange(len(own)) % 2
    scores, leads = [], []
    for k in (0, 1):
        if not (half != k).any() or not (half == k).any():
            continue
        classes, matrix = fit(packed[half != k], y[half != k].tolist())
        s = outputs(packed[half == k], matrix)
        for i, c in enumerate(classes):
            right = (y[half == k] == c) & (s.argmax(1) == i)
            if right.any():
                scores.append(np.quantile((1 + s[right, i]) / 2, share))
                leads.append(np.quantile(_lead(s[right]), share))
    if not scores:
        return 0.0, 0.0
    if len(set(labels)) > 1:
        return 0.0, float(min(leads)) / 2
    low = float(min(scores))
    return min(low, 0.5 + (low - 0.5) / 4), 0.0


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[np.ndarray, list[str]]:
    """Packed presence vectors and languages of at most ``TRAIN_ROWS`` distinct rows of ``docs`` (one a language, if there
    are more languages than that), as many of each language, picked by a hash of id and text. A threshold on the hash, from
    each language's number of distinct rows, cuts the pick down to about twice what is needed before anything is shuffled;
    only its vectors (DIM / 8 bytes each) reach the driver."""
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    named = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    named = named.select(F.col(lang_col).cast("string").alias("lang"), h.alias("h"), F.col(text_col).alias("text"))
    languages = named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not languages:
        return np.zeros((0, DIM // 8), np.uint8), []
    each = max(1, TRAIN_ROWS // len(languages))
    most = [(r.lang, min(2**63 - 1, int((2 * each + 20) / max(r.n, 1) * 2**63))) for r in languages]
    most = F.broadcast(docs.sparkSession.createDataFrame(most, "lang string, most long"))  # one row a language
    few = named.select("lang", "h").join(most, "lang").filter(F.col("h").bitwiseAND((1 << 63) - 1) <= F.col("most")).select("lang", "h").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = few.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "h")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                bits = np.packbits(presence(part.column(2).to_pylist()), axis=1)
                yield pa.record_batch({"h": part.column(1), "lang": part.column(0), "bits": pa.array([b.tobytes() for b in bits], pa.binary())})

    rows = named.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])  # at most TRAIN_ROWS keys
    got = sorted((tuple(r) for r in rows.select("lang", "h", "text").mapInArrow(vectors, "h long, lang string, bits binary").collect()), key=lambda r: (r[0], r[1], r[2]))
    packed = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(len(got), DIM // 8)
    return packed, [r[1] for r in got]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1: half of one plus the best ridge output, clipped) and lead (of the best output
    over the least) for every row."""
    classes, matrix = model
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lead")]
    sent = kept if text_col in kept else [*kept, text_col]
    out = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("lang_pred", "string").add("score", "double").add("lead", "double")
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # DIM x classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("language")
        b = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = part.column(sent.index(text_col)).to_pylist()
                known = [bool(classes and t and LETTER.search(t)) for t in texts]
                names, scores, leads = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                at = [i for i, k in enumerate(known) if k]
                if at:
                    x = presence([texts[i] for i in at])
                    s = (x.astype(np.float32) @ b) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
                    for i, k, v, ahead in zip(at, s.argmax(1).tolist(), s.max(1).tolist(), _lead(s).tolist()):
                        names[i], scores[i], leads[i] = classes[k], min(1.0, max(0.0, (1 + v) / 2)), ahead
                arrays = [part.column(i) for i in range(len(kept))] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(leads, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return docs.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(run, out)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
