"""Readers and writers: predictions of any schema, rule files, logs, checked CSV output, split directories, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import require_columns

#: Names under which a score, and a category, may come, in order of preference.
SCORES, CATEGORIES = ("score", "predict", "prediction", "probability"), ("category", "category_1")


def first_of(columns: list[str], names: tuple[str, ...]) -> str:
    for n in names:
        if n in columns:
            return n
    raise ValueError(f"none of {list(names)} is among {columns}")


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """id1, id2, target, category, score of Parquet predictions, whatever their score and category columns are called."""
    df = spark.read.parquet(*paths)
    require_columns(df, ["id1", "id2", "target"], ", ".join(paths))
    return df.select("id1", "id2", "target", F.col(first_of(df.columns, CATEGORIES)).alias("category"), F.col(first_of(df.columns, SCORES)).cast("double").alias("score"))


def split_paths(specs: list[str]) -> dict[str, str]:
    """NAME=PATH arguments."""
    out: dict[str, str] = {}
    for spec in specs:
        name, eq, path = spec.partition("=")
        if not eq or not name or not path or name in out:
            raise ValueError(f"expected a new NAME=PATH, got {spec!r}")
        out[name] = path
    return out


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The good rows of a JSON-lines log, and the lines that don't parse."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).cache()
    return rows.filter("_corrupt_record is null").drop("_corrupt_record"), rows.filter("_corrupt_record is not null").select("_corrupt_record")


def read_rules(spark: SparkSession, paths: list[str], schema: T.StructType, key: str = "rule_id") -> DataFrame:
    """Rules of CSV, JSON and JSON-lines files; of one key the last file's row counts."""
    parts = None
    for i, path in enumerate(paths):
        reader = spark.read.schema(schema)
        df = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.option("multiLine", path.endswith(".json")).json(path)
        df = df.withColumn("__file", F.lit(i))
        parts = df if parts is None else parts.unionByName(df)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__file")))
    return parts.withColumn("__r", last).filter("__r = 1").drop("__file", "__r")


def write_predictions(df: DataFrame, path: str, row_id: str = "row_id") -> None:
    """CSV of id1, id2, predict in the order of ``row_id``; a score that isn't finite fails the job."""
    score = F.col("predict").cast("double")
    good = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    checked = F.when(good, score).otherwise(F.raise_error("predictions contain NaN or infinity").cast("double"))
    df.select(row_id, "id1", "id2", checked.alias("predict")).orderBy(row_id).drop(row_id).write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One directory for each split."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(split).parquet(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Name, size and SHA-256 of every file under a path, computed where the files are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def key_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """A digest of a table's multiset of keys: exact sums of two 60-bit parts of each key's MD5 and the count, which partial
    aggregation keeps small, hashed into one SHA-256."""
    digest = F.md5(F.concat_ws("|", *keys).cast("binary"))
    parts = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(f"h{i}") for i, x in enumerate(parts)))
    return sums.select("n", F.sha2(F.concat_ws(":", "n", "h0", "h1").cast("binary"), 256).alias("digest"))
