"""Queries of blocked joins, dependent selections, and the remaining text and JSON functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import attributes as at, audit as au, graph as gr, pairs as pr, retrieval as rt, selection as se
from ..sources import views as v
from .base import query

SAFE = """bags as (select id, category, name, case when json_valid(attributes) then attributes else '{}' end as attributes from items),
keyed as (select id, category, k as key, json_extract_string(attributes, concat('$.', k)) as value from (select id, category, attributes, unnest(json_keys(attributes)) as k from bags))"""


def _n():
    return F.count(F.lit(1))


def _digest(*columns):
    return F.md5(F.concat_ws(":", *columns).cast("binary"))


@query("j17_blocked_similarity_join", "select a, b, round(s, 6) as cosine from (select x.vec_id as a, y.vec_id as b, list_cosine_similarity(x.e, y.e) as s from vecs x join vecs y on x.label = y.label and x.vec_id < y.vec_id) where s >= 0.2", "vecs as (select vec_id, label, cast(embedding as double[]) as e from embeddings)")
def blocked(spark, d):
    e = v.read(spark, d, "embeddings").select("vec_id", F.col("label").alias("block"), F.col("embedding").cast("array<double>").alias("e"))
    return rt.similar_pairs(e, 0.2).select("a", "b", F.round("s", 6).alias("cosine"))


@query("j19_compatible_rules", "select a.p_brand as brand, count(*) as n from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey group by 1")
def compatible(spark, d):
    # pairs within a key are counted from the key's size, without forming them
    sizes = v.read(spark, d, "part").groupBy("p_brand", "p_size").agg(_n().alias("n"))
    out = sizes.groupBy(F.col("p_brand").alias("brand")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n"))
    return out.filter("n > 0")


@query("w24_group_boundaries", "select category, id1, id2, row_number() over w = 1 as starts, row_number() over w = count(*) over (partition by category) as ends from predictions window w as (partition by category order by score, id1, id2)")
def boundaries(spark, d):
    w = Window.partitionBy("category").orderBy("score", "id1", "id2")
    n = F.row_number().over(w)
    return v.predictions(spark, d).select("category", "id1", "id2", (n == 1).alias("starts"), (n == _n().over(Window.partitionBy("category"))).alias("ends"))


@query("w28_least_used_assignment", """select n.id1, n.id2, p.id as donor from (select *, (row_number() over (partition by category order by md5(concat(id1, ':', id2)), id1, id2) - 1) as k from predictions where target = 1) n
  join (select category, id, row_number() over (partition by category order by md5(cast(id as varchar)), id) - 1 as k, count(*) over (partition by category) as m from items where id % 10 = 0) p on p.category = n.category and p.k = n.k % p.m""")
def least_used(spark, d):
    needs = v.predictions(spark, d).filter("target = 1").select("id1", "id2", "category")
    pool = v.items(spark, d).filter("id % 10 = 0").select("category", F.col("id").alias("donor"))
    return se.round_robin(needs, pool, ["category"], [_digest("id1", "id2"), "id1", "id2"], [_digest("donor"), "donor"]).select("id1", "id2", "donor")


@query("t20_seeded_shuffle", "select id, string_agg(concat(key, '=', value), ';' order by md5(concat('7:', id, ':', key)), key) as text from keyed group by id", SAFE)
def shuffled(spark, d):
    rows = at.entries(v.items(spark, d), "id").withColumn("h", F.md5(F.concat_ws(":", F.lit("7"), "id", "key").cast("binary")))
    gathered = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("h", "key", "value"))).alias("a"))
    return gathered.select("id", F.array_join(F.transform("a", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("text"))


@query("m13_prevalence_for_macro_ap")
def prevalence(spark, d):
    found = se.prevalence_for(v.predictions(spark, d), 0.7)
    return spark.createDataFrame([(0.7, round(found, 6))], "macro_ap double, prevalence double")


@query("r23_selection_within_tolerance", "select category, rate from (select category, round(avg(score), 6) as rate, count(*) as n from predictions group by category) where rate >= (select max(rate) from (select round(avg(score), 6) as rate from predictions group by category)) - 0.05 order by n, category limit 1")
def tolerance(spark, d):
    g = v.predictions(spark, d).groupBy("category").agg(F.round(F.avg("score"), 6).alias("rate"), _n().alias("n"))
    best = g.agg(F.max("rate").alias("best"))
    return g.join(F.broadcast(best)).filter("rate >= best - 0.05").orderBy("n", "category").limit(1).select("category", "rate")


@query("i12_attribute_swaps", """select b.id, b.brand as old, c.brand as new from (select id, category, json_extract_string(attributes, '$.brand') as brand from bags where json_extract_string(attributes, '$.brand') is not null) b
  join (select category, brand, row_number() over (partition by category order by brand) - 1 as k, count(*) over (partition by category) as n from (select distinct category, json_extract_string(attributes, '$.brand') as brand from bags where json_extract_string(attributes, '$.brand') is not null)) c
  on c.category = b.category and c.k = b.id % c.n where c.brand <> b.brand""", SAFE)
def swaps(spark, d):
    brand = v.items(spark, d).select("id", "category", F.element_at(at.parse(F.col("attributes")), "brand").alias("old")).filter("old is not null")
    values = brand.select("category", F.col("old").alias("new")).distinct()
    values = values.groupBy("category").agg(F.array_sort(F.collect_set("new")).alias("all"))
    picked = brand.join(F.broadcast(values), "category").select("id", "old", F.element_at("all", (F.col("id") % F.size("all") + 1).cast("int")).alias("new"))
    return picked.filter("new <> old")
