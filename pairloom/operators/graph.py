"""Pair graphs: components with their least item as label, split and sampling rules that respect them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset, a session within one process takes a folder of
    its own, and a cluster one in the warehouse, which its executors reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master)
        folder = tempfile.mkdtemp(prefix="pairloom-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pairloom-scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a step's result to the shared folder, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for root in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Edges that one task may finish by itself; more are contracted by rounds of joins until so few are left.
ONE_TASK_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for the endpoints of edges (id1, id2): the least id that each is connected with.

    Rounds of contraction: a node points to its least neighbour, pointers are followed once more, edges are rewritten
    to the nodes pointed at and loops and repeats dropped. Every round leaves one table of pointers; the labels follow
    them in turn at the end. As every step lowers labels, the last label is the least id. Once the edges left are counted
    to be few, one task ends the work.
    """
    ends = edges.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
    ends = cut(ends)
    label = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component_id", F.col("id"))
    jumps, left, made = [], ends.filter("a <> b"), [ends]
    numbers = dict(ends.dtypes)["a"] == "bigint"
    while True:
        n = left.count()
        if not n or (numbers and n <= ONE_TASK_EDGES):
            if n:
                jumps.append(cut(_rooted(left)))
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        hop = point.select(F.col("a").alias("to"), F.col("to").alias("root"))
        jump = cut(point.join(hop, "to").select(F.col("a").alias("node"), "root"))
        at = lambda c, name: jump.select(F.col("node").alias(c), F.col("root").alias(name))  # noqa: B023, E731
        moved = left.join(at("a", "x"), "a").join(at("b", "y"), "b").filter("x <> y")
        left = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        made.append(left)
        jumps.append(jump)
    for jump in jumps:
        step = jump.select(F.col("node").alias("component_id"), "root")
        label = label.join(step, "component_id", "left").select("id", F.coalesce("root", "component_id").alias("component_id"))
    out = cut(label)
    drop(*jumps, *made)
    return out


def _rooted(ends: DataFrame) -> DataFrame:
    """(node, root) of the few edges that are left, in one task: labels are lowered along edges and followed until they rest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"a": [], "b": []}, dtype="int64")])
        nodes, at = np.unique(rows[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while True:
            before = root.copy()
            low = np.minimum(root[a], root[b])
            for end in (a, b):
                np.minimum.at(root, root[end], low)
                np.minimum.at(root, end, low)
            root = root[root]
            if (root == before).all():
                break
        yield pd.DataFrame({"node": nodes, "root": nodes[root]})

    return ends.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInPandas(run, "node long, root long")


def with_groups(edges: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Edges and, for every group of ``members`` (id, key) of two or more, a star around its least id."""
    least = members.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id1"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    star = members.join(least, key).filter("id <> id1").select("id1", F.col("id").alias("id2"))
    return edges.select("id1", "id2").union(star)


def pair_components(pairs: DataFrame) -> DataFrame:
    labels = components(pairs)
    return pairs.join(labels.withColumnRenamed("id", "id1"), "id1")


def largest_remainder(sizes: DataFrame, total: int, keys: list[str], size: str = "n") -> DataFrame:
    """Quotas in proportion to group sizes that add up to ``total``: whole parts, then the largest remainders."""
    whole = Window.partitionBy()
    exact = F.col(size) * float(total) / F.sum(size).over(whole)
    rows = sizes.withColumn("__base", F.floor(exact)).withColumn("__rest", F.round(exact - F.floor(exact), 12))
    left = F.lit(total) - F.sum("__base").over(whole)
    rows = rows.withColumn("__left", left).withColumn("__r", F.row_number().over(Window.orderBy(F.desc("__rest"), *keys)))
    return rows.withColumn("quota", F.col("__base") + (F.col("__r") <= F.col("__left")).cast("long")).drop("__base", "__rest", "__left", "__r")


def sample_by_quota(df: DataFrame, quotas: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first ``quota`` rows of each group."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(F.broadcast(quotas.select(*keys, "quota")), keys).filter("__r <= quota").drop("__r", "quota")


def hash_fraction(key: Column, seed: str) -> Column:
    """A number in [0, 1) for a key, by MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_split(df: DataFrame, group: Column, seed: str, valid: float) -> DataFrame:
    """Whole groups to 'valid' with probability ``valid``, the rest to 'train'."""
    return df.withColumn("split", F.when(hash_fraction(group, seed) < valid, "valid").otherwise("train"))


def group_weights(df: DataFrame, keys: list[str], power: float = -0.5) -> DataFrame:
    """Weights by group size to a power, scaled to a mean of one."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    scale = sizes.agg((F.sum("__n") / F.sum(F.col("__n") * F.pow(F.col("__n").cast("double"), F.lit(power)))).alias("__s"))
    weights = sizes.join(F.broadcast(scale)).select(*keys, (F.pow(F.col("__n").cast("double"), F.lit(power)) * F.col("__s")).alias("weight"))
    return df.join(F.broadcast(weights), keys)


def balanced(df: DataFrame, keys: list[str], label: str, order: list) -> DataFrame:
    """Each group with as many rows of one label as of the other."""
    sizes = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.min("__n").alias("__m"), F.count(F.lit(1)).alias("__labels"))
    rank = F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order))
    return df.withColumn("__r", rank).join(F.broadcast(sizes), keys).filter("__labels = 2 and __r <= __m").drop("__r", "__m", "__labels")
