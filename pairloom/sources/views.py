"""Item, pair and prediction views over the supplied tables, in DataFrame form and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def hash_int(text: Column) -> Column:
    """The first 32 bits of a text's MD5 sum as a whole number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: id, name, attributes (JSON text; some empty, some broken), category."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    word = F.substring_index("p_name", " ", 1)
    price = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(', "price": "'), F.floor("p_retailprice").cast("string"), F.lit('"'))).otherwise("")
    color = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(', "color": "'), word, F.lit('"'))).otherwise("")
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit('{"brand": "'), "p_brand", F.lit('", "type": "'), "p_type", F.lit('", "size": "'), size, F.lit(' mm"'), price, color, F.lit("}"))
    text = F.when(F.col("p_partkey") % 97 == 5, "not json").when(F.col("p_partkey") % 11 == 3, "{}").otherwise(text)
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), size, F.lit(" mm"))
    return part.select(F.col("p_partkey").alias("id"), name.alias("name"), text.alias("attributes"), F.col("p_type").alias("category"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled candidate pairs of one category: chains of equal names, and partners seven places on."""
    return _matches(spark, sf_dir).select("id1", "id2", "target")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and their category, which both items share."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    chain = F.lead("p_partkey").over(Window.partitionBy("p_type", "p_name").orderBy("p_partkey"))
    brand = F.lead("p_brand").over(Window.partitionBy("p_type", "p_name").orderBy("p_partkey"))
    far = Window.partitionBy("p_type").orderBy("p_partkey")
    one = part.select(F.col("p_partkey").alias("a"), chain.alias("b"), "p_brand", brand.alias("brand_b"), "p_type")
    two = part.select(F.col("p_partkey").alias("a"), F.lead("p_partkey", 7).over(far).alias("b"), "p_brand", F.lead("p_brand", 7).over(far).alias("brand_b"), "p_type")
    both = one.union(two.filter("a % 5 = 0")).filter("b is not null").distinct()
    turn = F.col("a") % 2 == 0
    mark = (hash_int(F.concat_ws(":", "a", "b")) % 10 < 3) | (F.col("p_brand") == F.col("brand_b"))
    return both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("id1"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("id2"), mark.cast("int").alias("target"), F.col("p_type").alias("category"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their category and the scores of three models (with ties)."""
    def score(salt: str, noise: int) -> Column:
        drawn = hash_int(F.concat_ws(":", F.lit(salt), "id1", "id2")) % noise
        return F.round((drawn + (100 - noise) * F.col("target")) / 100.0, 2)

    return _matches(spark, sf_dir).select("id1", "id2", "category", "target", score("a", 80).alias("score"), score("b", 70).alias("score_b"), score("c", 90).alias("score_c"))


SQL = """
items as (
  select p_partkey as id, concat(p_name, ' ', p_brand, ' ', p_size, ' mm') as name,
    case when p_partkey % 97 = 5 then 'not json' when p_partkey % 11 = 3 then '{}' else
      concat('{"brand": "', p_brand, '", "type": "', p_type, '", "size": "', p_size, ' mm"',
        case when p_partkey % 3 = 0 then concat(', "price": "', cast(floor(p_retailprice) as bigint), '"') else '' end,
        case when p_partkey % 7 = 0 then concat(', "color": "', split_part(p_name, ' ', 1), '"') else '' end, '}') end as attributes,
    p_type as category from part),
raw_matches as (
  select a, b, p_brand, brand_b from (
    select p_partkey as a, lead(p_partkey) over (partition by p_type, p_name order by p_partkey) as b, p_brand,
      lead(p_brand) over (partition by p_type, p_name order by p_partkey) as brand_b from part) where b is not null
  union
  select a, b, p_brand, brand_b from (
    select p_partkey as a, lead(p_partkey, 7) over (partition by p_type order by p_partkey) as b, p_brand,
      lead(p_brand, 7) over (partition by p_type order by p_partkey) as brand_b from part) where b is not null and a % 5 = 0),
matches as (
  select case when a % 2 = 0 then b else a end as id1, case when a % 2 = 0 then a else b end as id2,
    case when ('0x' || substr(md5(concat(a, ':', b)), 1, 8))::bigint % 10 < 3 or p_brand = brand_b then 1 else 0 end as target
  from raw_matches),
predictions as (
  select id1, id2, p_type as category, target,
    round((('0x' || substr(md5(concat('a:', id1, ':', id2)), 1, 8))::bigint % 80 + 20 * target)::double / 100.0::double, 2) as score,
    round((('0x' || substr(md5(concat('b:', id1, ':', id2)), 1, 8))::bigint % 70 + 30 * target)::double / 100.0::double, 2) as score_b,
    round((('0x' || substr(md5(concat('c:', id1, ':', id2)), 1, 8))::bigint % 90 + 10 * target)::double / 100.0::double, 2) as score_c
  from matches join part on id1 = p_partkey)"""
