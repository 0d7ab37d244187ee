"""Reading of embedding columns for the vector operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that meet in one product, on either side, at least; most partitions over which pairs of packs are dealt.
PACK, MOST_PARTS = 4096, 20_000


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its components are there and finite."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def packs_for(n: int, size: int = PACK) -> int:
    return max(1, math.ceil(n / size))


def in_packs(df: DataFrame, n: int) -> DataFrame:
    """Deal rows evenly, whatever their keys, so that each partition makes one pack."""
    return df.repartition(n)


def blocks_for(packs: int) -> tuple[int, int]:
    """Packs of a block, and blocks: pairs of packs are shuffled by pairs of blocks, so that a pack is copied once a block
    and not once a pack."""
    each = min(16, max(1, packs // 16))
    return each, -(-packs // each)


def pairs_of_packs(packed: DataFrame, packs: int, columns: tuple[str, ...]) -> DataFrame:
    """Each pair of packs (i <= j) of one dimension: d, i, j, the columns of i, those of j."""
    each, blocks = blocks_for(packs)
    block = F.expr(f"pack div {each}").cast("int")
    left = packed.select("d", F.col("pack").alias("i"), block.alias("x"), F.explode(F.sequence(block, F.lit(blocks - 1))).alias("y"), *columns)
    right = packed.select("d", F.col("pack").alias("j"), F.explode(F.sequence(F.lit(0), block)).alias("x"), block.alias("y"), *(F.col(c).alias(f"{c}_2") for c in columns))
    dealt = left.repartition(min(MOST_PARTS, blocks * (blocks + 1) // 2), "d", "x", "y")
    return dealt.join(right, ["d", "x", "y"]).filter("i <= j").select("d", "i", "j", *columns, *(f"{c}_2" for c in columns))
