"""Append-only logs: latest state by key, as a batch, and as a stream that keeps a table up to date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest ``order`` for each key: one pre-aggregated maximum, no sort of a key's rows."""
    others = [c for c in log.columns if c not in keys and c not in order]
    top = log.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("r"))
    return top.select(*keys, *(F.col(f"r.{c}").alias(c) for c in [*order, *others]))


def versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that ``keep_latest`` has written and not dropped yet, with their bucket and batch."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException:  # nothing is there yet
        return spark.createDataFrame([], whole)


def current(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The state: of each bucket the rows of its last batch (before a given one)."""
    rows = versions(spark, path, schema)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["bucket", "batch"]).select(*schema.names, "bucket")  # one row a bucket


def keep_latest(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Run over what a stream has now. Keys fall into buckets; a batch rewrites only the buckets that it has rows for, merged
    with their last state, beside it, so that a batch that is run again gives the same table. Of each bucket the last two
    versions stay."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        state = current(spark, path, batch.schema, number).filter(F.col("bucket").isin(touched))
        merged = latest_per_key(rows.unionByName(state), [*keys, "bucket"], order).withColumn("batch", F.lit(number).cast("long"))
        merged.select(*batch.columns, "bucket", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        _drop_old(spark, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _drop_old(spark: SparkSession, path: str) -> None:
    """Delete all but the last two versions of each bucket."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    for bucket in files.listStatus(root):
        if bucket.isDirectory() and bucket.getPath().getName().startswith("bucket="):
            old = sorted((int(b.getPath().getName().split("=")[1]), b.getPath().toString()) for b in files.listStatus(bucket.getPath()) if "=" in b.getPath().getName())
            for _, where in old[:-2]:
                files.delete(jvm.org.apache.hadoop.fs.Path(where), True)


def first_per_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
