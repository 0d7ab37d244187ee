"""Runs that can be resumed and told apart: bounded reads, staged writes, signed checkpoints, caches, queues, reports, scorers."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import require_columns
from .files import manifest


class Scorer(Protocol):
    """Anything that scores pairs: a frame of pairs in, the same pairs with ``predict`` out."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_prefix(spark: SparkSession, paths: list[str], columns: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Rows of several Parquet sources, in the order of the sources and of ``order`` within each, up to ``limit`` rows; the
    limit is a top-k, which keeps at most that many rows a task."""
    parts = None
    for i, path in enumerate(paths):
        part = spark.read.parquet(path).select(F.lit(i).alias("__source"), *columns)
        parts = part if parts is None else parts.unionByName(part)
    return (parts if limit is None else parts.orderBy("__source", *order).limit(limit)).drop("__source")


def count_rows(spark: SparkSession, *paths: str) -> int:
    """Rows of Parquet files from their footers alone: the count is pushed into the scan."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(*paths).agg(F.count(F.lit(1))).first()[0]


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """One JSON file, written beside its place and renamed to it, so that no reader sees a part of it."""
    _write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    beside, files = _files(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    place, _ = _files(spark, path)
    files.delete(place, False)
    if not files.rename(beside, place):
        raise OSError(f"could not move {beside} to {path}")


def read_json(spark: SparkSession, path: str) -> object | None:
    """The value of a JSON file, or None where there is no file."""
    where, files = _files(spark, path)
    if not files.exists(where):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one row


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> dict:
    """Write a table to a staging folder, check it there, write its manifest (rows, bytes and SHA-256 of every file), and move
    the whole to its place, which must be free. Until then nothing stands there."""
    spark = df.sparkSession
    place, files = _files(spark, path)
    if files.exists(place):
        raise FileExistsError(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.parquet(f"{staging}/data")
    written = spark.read.parquet(f"{staging}/data")
    if check is not None:
        check(written)
    listed = [r.asDict() for r in manifest(spark, f"{staging}/data").orderBy("file").collect()]  # one row a file
    found = {"rows": written.count(), "files": listed}
    write_json(spark, f"{staging}/manifest.json", found)
    beside, _ = _files(spark, staging)
    if not files.rename(beside, place):
        raise OSError(f"could not move {staging} to {path}")
    return found


def fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, inputs: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table by the fingerprint of what it is made from: read if it is complete, else built and published."""
    path = f"{root.rstrip('/')}/{fingerprint(inputs)}"
    marker, files = _files(spark, f"{path}/manifest.json")
    if not files.exists(marker):
        publish(build(), path)
    return spark.read.parquet(f"{path}/data")


class Checkpoint:
    """Results by key, appended as they come, under the signature of their run; a folder of another run is refused."""

    def __init__(self, spark: SparkSession, path: str, run: dict, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        mine, there = fingerprint(run), read_json(spark, f"{self.path}/run.json")
        if there is None:
            write_json(spark, f"{self.path}/run.json", {"signature": mine, "run": run})
        elif there["signature"] != mine:
            raise ValueError("the checkpoint belongs to another run")

    def done(self) -> DataFrame | None:
        """All results so far, one for each key."""
        try:
            return self.spark.read.parquet(f"{self.path}/results").dropDuplicates(self.key)
        except AnalysisException:  # none yet
            return None

    def todo(self, work: DataFrame) -> DataFrame:
        had = self.done()
        return work if had is None else work.join(had.select(*self.key), self.key, "left_anti")

    def append(self, results: DataFrame) -> None:
        results.write.mode("append").parquet(f"{self.path}/results")


def work_through(work: DataFrame, act: Callable[[DataFrame], DataFrame], checkpoint: Checkpoint, parts: int, retries: int = 2, until: float | None = None) -> DataFrame | None:
    """Take what isn't done in parts (by a hash of the key), act on one at a time and append its results; a part that fails is
    tried again, ``retries`` times. Past the time ``until`` no further part is begun. Run again, it goes on where it stopped."""
    part = F.pmod(F.xxhash64(*checkpoint.key), F.lit(parts))
    for i in range(parts):
        if until is not None and time.time() >= until:
            break
        some = checkpoint.todo(work.filter(part == i))
        if some.isEmpty():
            continue
        for attempt in range(retries + 1):
            try:
                checkpoint.append(act(some))
                break
            except Exception:
                if attempt == retries:
                    raise
    return checkpoint.done()


def score(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """What a scorer gives, checked: the columns are there, and a score that isn't a finite number within 0 and 1 fails the
    job."""
    out = require_columns(scorer(pairs), ["id1", "id2", "predict"], "the scorer's result")
    p = F.col("predict").cast("double")
    good = p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)
    return out.withColumn("predict", F.when(good, p).otherwise(F.raise_error("a score is not within 0 and 1").cast("double")))


def score_in_time(pairs: DataFrame, scorer: Scorer, fallback: Scorer, checkpoint: Checkpoint, seconds: float, parts: int = 16) -> DataFrame:
    """Scores of as many pairs as the time allows, and the fallback's for the rest; ``late`` says which."""
    had = work_through(pairs, lambda some: score(some, scorer), checkpoint, parts, until=time.time() + seconds)
    rest = checkpoint.todo(pairs)
    late = score(rest, fallback).select("id1", "id2", "predict", F.lit(True).alias("late"))
    return late if had is None else had.select("id1", "id2", "predict", F.lit(False).alias("late")).unionByName(late)


def report(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small table as CSV, JSON and Markdown files; more rows than ``most`` are an error, as a report isn't a data set."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    names = df.columns
    cell = lambda x: "" if x is None else str(x)
    quoted = lambda x: '"' + cell(x).replace('"', '""') + '"' if set(cell(x)) & set(',"\n') else cell(x)
    spark = df.sparkSession
    write_json(spark, f"{path}.json", {"title": title, "rows": [json.loads(json.dumps(r.asDict(), default=str)) for r in rows]})
    _write_text(spark, f"{path}.csv", "\n".join(",".join(map(quoted, r)) for r in [names, *rows]) + "\n")
    lines = ["| " + " | ".join(cell(x).replace("|", "\\|") for x in r) + " |" for r in [names, ["-"] * len(names), *rows]]
    _write_text(spark, f"{path}.md", f"# {title}\n\n" + "\n".join(lines) + "\n")
