"""Queries of metrics, statistics, graphs, splits, rules, routing and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import graph as gr, metrics as me, pairs as pr, resampling as rs, retrieval as rt, routing as ro, rules as ru
from ..sources import views as v
from .base import query

CURVE = """pts as (select category, score as pt, count(*)::double as w, sum(target)::double as p from predictions group by category, score),
curve as (select *, sum(w) over (partition by category order by pt desc rows unbounded preceding) as cw, sum(p) over (partition by category order by pt desc rows unbounded preceding) as cp,
  sum(w) over (partition by category) as tw, sum(p) over (partition by category) as tp from pts)"""


def _n():
    return F.count(F.lit(1))


@query("m1_m3_macro_average_precision", "select round(avg(ap), 6) as macro_ap, count(*) as groups from (select category, sum(p * cp / cw) / max(tp) as ap from curve group by category)", CURVE)
def macro_ap(spark, d):
    out = me.macro(me.average_precision(v.predictions(spark, d), ["category"]), "ap")
    return out.select(F.round("macro_ap", 6).alias("macro_ap"), "groups")


WEIGHTED = CURVE.replace("count(*)::double as w, sum(target)::double as p", "sum(case when target = 1 then 1.0::double else 0.25::double end) as w, sum(target)::double as p")


@query("m2_m12_weighted_ap", "select category, round(sum(p * cp / cw) / max(tp), 6) as ap from curve group by category", WEIGHTED)
def weighted_ap(spark, d):
    w = F.when(F.col("target") == 1, 1.0).otherwise(0.25)
    return me.average_precision(v.predictions(spark, d), ["category"], weight=w).select("category", F.round("ap", 6).alias("ap"))


@query("m4_roc_auc", "select category, round(sum((w - p) * (cp - p / 2)) / max(tp * (tw - tp)), 6) as auc from curve group by category", CURVE)
def auc(spark, d):
    return me.roc_auc(v.predictions(spark, d), ["category"]).select("category", F.round("auc", 6).alias("auc"))


@query("m7_best_f1", "select category, round(max(2 * cp / (cw + tp)), 6) as f1 from curve group by category", CURVE)
def f1(spark, d):
    return me.best_f1(v.predictions(spark, d), ["category"]).select("category", F.round("f1", 6).alias("f1"))


SLICES = """sliced as (select slice, target, score, score_b from (
  select 'uncertain' as slice, * from predictions where abs(score - 0.5) < 0.2 union all select 'disagree', * from predictions where abs(score - score_b) > 0.3
  union all select 'small_id', * from predictions where id1 < 1000 union all select concat('cat:', category), * from predictions))"""


@query("m19_holm", """select name, p, round(least(1, max(p * (n - r + 1)) over (order by p, name rows unbounded preceding)), 9) as adjusted from (select *, row_number() over (order by p, name) as r, count(*) over () as n from ps)""",
  "ps as (select category as name, round(avg(score) / 20, 9) as p from predictions group by category)")
def holm(spark, d):
    ps = v.predictions(spark, d).groupBy(F.col("category").alias("name")).agg(F.round(F.avg("score") / 20, 9).alias("p"))
    return ru.holm(ps, "p", "name").select("name", "p", F.round("adjusted", 9).alias("adjusted"))


@query("m20_benjamini_hochberg", """select name, p, round(least(1, min(p * n / r) over (order by p desc, name desc rows unbounded preceding)), 9) as q from (select *, row_number() over (order by p, name) as r, count(*) over () as n from ps)""",
  "ps as (select p_brand as name, round(avg(score) / 20, 9) as p from predictions join part on p_partkey = id1 group by p_brand)")
def bh(spark, d):
    brand = v.read(spark, d, "part").select(F.col("p_partkey").alias("id1"), F.col("p_brand").alias("name"))
    ps = v.predictions(spark, d).join(pr.small(brand), "id1").groupBy("name").agg(F.round(F.avg("score") / 20, 9).alias("p"))
    return ru.benjamini_hochberg(ps, "p", "name").select("name", "p", F.round("q", 9).alias("q"))


# graph and splits

REACH = """edges as (select id1 as a, id2 as b from matches where a_filter union select id2, id1 from matches where a_filter),
reach(id, root) as (select distinct a, a from edges union select e.b, r.root from reach r join edges e on e.a = r.id and r.root < e.b),
comp as (select id, min(root) as component_id from reach group by id)"""


def _oracle(name, body, where):
    from . import base

    ctes = REACH.replace("a_filter", where)
    base.ORACLES[name] = f"with recursive {base.views.SQL}, {ctes} {body}"


@query("g1_connected_components")
def components(spark, d):
    return gr.components(v.matches(spark, d)).select("id", "component_id")


_oracle("g1_connected_components", "select id, component_id from comp", "true")


@query("g2_masked_component_sizes")
def masked(spark, d):
    c = gr.components(v.matches(spark, d).filter("target = 1")).groupBy("component_id").agg(_n().alias("size"))
    return c.groupBy("size").agg(_n().alias("components"))


_oracle("g2_masked_component_sizes", "select size, count(*) as components from (select component_id, count(*) as size from comp group by component_id) group by size", "target = 1")


@query("g5_graph_summary")
def graph_summary(spark, d):
    m = v.matches(spark, d)
    inside = gr.components(m.filter("target = 1"))
    neg = m.filter("target = 0").join(inside.select(F.col("id").alias("id1"), F.col("component_id").alias("c1")), "id1").join(inside.select(F.col("id").alias("id2"), F.col("component_id").alias("c2")), "id2")
    a = inside.agg(_n().alias("nodes"), F.count_distinct("component_id").alias("components"))
    return a.join(neg.agg(F.count_if(F.col("c1") == F.col("c2")).alias("negatives_inside")))


_oracle("g5_graph_summary", "select (select count(*) from comp) as nodes, (select count(distinct component_id) from comp) as components, (select count(*) from matches m join comp a on a.id = m.id1 join comp b on b.id = m.id2 where m.target = 0 and a.component_id = b.component_id) as negatives_inside", "target = 1")


@query("g6_component_one_category")
def one_category(spark, d):
    c = gr.pair_components(v.predictions(spark, d)).groupBy("component_id").agg(F.count_distinct("category").alias("categories"))
    return c.groupBy("categories").agg(_n().alias("components"))


_oracle("g6_component_one_category", "select categories, count(*) as components from (select c.component_id, count(distinct p.category) as categories from predictions p join comp c on c.id = p.id1 group by 1) group by 1", "true")


@query("l1_l2_hash_split")
def hash_split(spark, d):
    pairs = gr.hash_split(gr.pair_components(v.predictions(spark, d)), F.col("component_id"), "s", 0.2)
    return pairs.select("id1", "id2", "split")


_oracle("l1_l2_hash_split", "select p.id1, p.id2, case when ('0x' || substr(md5(concat('s:', c.component_id)), 1, 8))::bigint / 4294967296.0::double < 0.2 then 'valid' else 'train' end as split from predictions p join comp c on c.id = p.id1", "true")


@query("l4_largest_remainder_quota", """select category, target, base + (row_number() over (order by rest desc, category, target) <= 300 - sum(base) over ())::int as quota from (
  select category, target, cast(floor(n * 300.0::double / t) as bigint) as base, round(n * 300.0::double / t - floor(n * 300.0::double / t), 12) as rest from (select category, target, count(*) as n, sum(count(*)) over () as t from predictions group by category, target))""")
def quota(spark, d):
    sizes = v.predictions(spark, d).groupBy("category", "target").agg(_n().alias("n"))
    return gr.largest_remainder(sizes, 300, ["category", "target"]).select("category", "target", "quota")


@query("l11_majority_downsample", "select id1, id2 from (select *, row_number() over (partition by category, target order by md5(concat(id1, ':', id2)), id1, id2) as r, least(sum(target) over (partition by category), sum(1 - target) over (partition by category)) as m from predictions) where r <= m")
def downsample(spark, d):
    order = [F.md5(F.concat_ws(":", "id1", "id2").cast("binary")), "id1", "id2"]
    return gr.balanced(v.predictions(spark, d), ["category"], "target", order).select("id1", "id2")


@query("l13_hash_subset", "select id from items order by md5(cast(id as varchar)), id limit 200")
def subset(spark, d):
    return v.items(spark, d).select("id").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(200)


@query("l15_l16_sampling_weights", "select id1, id2, round((1 / sqrt(n)) * (count(*) over ()) / sum(1 / sqrt(n)) over (), 6) as weight from (select *, count(*) over (partition by category, target)::double as n from predictions)")
def sampling_weights(spark, d):
    return gr.group_weights(v.predictions(spark, d), ["category", "target"]).select("id1", "id2", F.round("weight", 6).alias("weight"))


@query("l17_equal_group_mass", "select id1, id2, round(s / total * (select avg(t) from (select sum(score + 0.01) as t from predictions group by category)), 6) as weight from (select *, score + 0.01 as s, sum(score + 0.01) over (partition by category) as total from predictions)")
def mass(spark, d):
    p = v.predictions(spark, d).withColumn("s", F.col("score") + 0.01)
    totals = p.groupBy("category").agg(F.sum("s").alias("total"))
    mean = totals.agg(F.avg("total").alias("mean"))
    return p.join(F.broadcast(totals), "category").join(F.broadcast(mean)).select("id1", "id2", F.round(F.col("s") / F.col("total") * F.col("mean"), 6).alias("weight"))


@query("l23_virtual_copies", "select id + k * 1000000 as id, k from items, (select unnest([0, 1, 2]) as k)")
def copies(spark, d):
    return v.items(spark, d).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select((F.col("id") + F.col("k") * 1000000).alias("id"), "k")


@query("l8_l25_split_assignment", """select id1, id2, case when category = 'ECONOMY' then 'ood' when h < 20 then 'iid' when h < 30 and abs(score - target) > 0.5 then 'hard' else 'train' end as split from (select *, ('0x' || substr(md5(concat('split:', id1)), 1, 8))::bigint % 100 as h from predictions)""")
def assignment(spark, d):
    h = v.hash_int(F.concat(F.lit("split:"), "id1")) % 100
    wrong = F.abs(F.col("score") - F.col("target"))
    split = F.when(F.col("category") == "ECONOMY", "ood").when(h < 20, "iid").when((h < 30) & (wrong > 0.5), "hard").otherwise("train")
    return v.predictions(spark, d).select("id1", "id2", split.alias("split"))


# rules

OCC = """occ as (select id1, id2, target, category, id1 % 5 as fold, rule from (
  select p.*, concat('brand:', x.p_brand) as rule from predictions p join part x on x.p_partkey = p.id1
  union select p.*, concat('size:', x.p_size) from predictions p join part x on x.p_partkey = p.id2
  union select p.*, concat('cat:', category, ':', x.p_size % 5) from predictions p join part x on x.p_partkey = p.id2))"""


def occurrences(spark, d):
    part = v.read(spark, d, "part", "p_partkey", "p_brand", "p_size")
    p = v.predictions(spark, d).join(pr.small(part.select(F.col("p_partkey").alias("id1"), "p_brand")), "id1").join(pr.small(part.select(F.col("p_partkey").alias("id2"), "p_size")), "id2")
    rules = F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("size:"), "p_size"), F.concat(F.lit("cat:"), "category", F.lit(":"), F.col("p_size") % 5))
    return p.select("id1", "id2", "target", "category", (F.col("id1") % 5).alias("fold"), F.explode(rules).alias("rule")).distinct()


@query("r1_r2_rule_statistics", "select rule, count(*) as support, sum(target)::bigint as positives, round(avg(target), 6) as rate, round(avg(target) / (select avg(target) from predictions), 6) as lift from occ group by rule", OCC)
def rule_stats(spark, d):
    base = v.predictions(spark, d).agg(F.avg("target").alias("base"))
    out = ru.rule_counts(occurrences(spark, d)).join(F.broadcast(base))
    return out.select("rule", "support", "positives", F.round(F.col("positives") / F.col("support"), 6).alias("rate"), F.round(F.col("positives") / F.col("support") / F.col("base"), 6).alias("lift"))


@query("r3_r4_leave_one_out_encoding", """select id1, id2, round(avg(ln((pos - target + 1.0::double) / (n - pos - (1 - target) + 1.0::double))), 6) + 0 as encoded from (
  select *, sum(target) over (partition by rule) as pos, count(*) over (partition by rule) as n from occ) where n > 1 group by id1, id2""", OCC)
def leave_one_out(spark, d):
    return ru.target_encoding(occurrences(spark, d), None).select("id1", "id2", (F.round("encoded", 6) + 0.0).alias("encoded"))


@query("r5_cross_fit_encoding", """select o.id1, o.id2, round(avg(ln((t.pos - f.pos + 1.0::double) / (t.n - f.n - t.pos + f.pos + 1.0::double))), 6) + 0 as encoded from occ o
  join (select rule, sum(target) as pos, count(*) as n from occ group by rule) t on t.rule = o.rule join (select rule, fold, sum(target) as pos, count(*) as n from occ group by rule, fold) f on f.rule = o.rule and f.fold = o.fold where t.n > f.n group by o.id1, o.id2""", OCC)
def cross_fit(spark, d):
    return ru.target_encoding(occurrences(spark, d), "fold").select("id1", "id2", (F.round("encoded", 6) + 0.0).alias("encoded"))


@query("r13_cannot_link", "select a.rule as rule_a, b.rule as rule_b, count(*) as pairs from occ a join occ b on a.id1 = b.id1 and a.id2 = b.id2 and a.rule < b.rule group by 1, 2", OCC)
def cannot_link(spark, d):
    return ru.co_occurring(occurrences(spark, d))


@query("m25_m26_rule_gates", """select min_support, count(*) as rules from (select unnest([10, 20, 40]) as min_support) join (select rule, count(*) as support, avg(target) as p, count(*)::double as n, 1.959963984540054::double as z from occ group by rule) on support >= min_support
  where (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n) >= 0.2 group by min_support""", OCC)
def gates(spark, d):
    return ru.gate_sweep(ru.rule_counts(occurrences(spark, d)), [10, 20, 40], 0.2)


# routing


@query("r18_benefit_target", "select id1, id2, round(la - lb, 6) as gain, (la - lb > 0.02) as benefit from (select id1, id2, -(target * ln(a) + (1 - target) * ln(1 - a)) as la, -(target * ln(b) + (1 - target) * ln(1 - b)) as lb from (select *, least(greatest(score, 1e-7), 1 - 1e-7) as a, least(greatest(score_b, 1e-7), 1 - 1e-7) as b from predictions))")
def benefit(spark, d):
    gain = nm.log_loss(F.col("target"), F.col("score")) - nm.log_loss(F.col("target"), F.col("score_b"))
    return v.predictions(spark, d).select("id1", "id2", F.round(gain, 6).alias("gain"), (gain > 0.02).alias("benefit"))


@query("r19_r21_staged_routing", """select id1, id2, round(case when e2 then (score + score_b) / 2 * 0.5 + score_c * 0.5 when e1 then (score + score_b) / 2 else score end, 6) as final from (
  select *, e1 and row_number() over (order by e1 desc, abs(score_b - 0.5), id1, id2) <= floor(n * 0.05 + 1e-12) as e2 from (
    select *, row_number() over (order by abs(score - 0.5), id1, id2) <= floor(n * 0.4 + 1e-12) as e1 from (select *, count(*) over () as n from predictions)))""")
def staged(spark, d):
    return ro.staged(v.predictions(spark, d)).select("id1", "id2", F.round("final", 6).alias("final"))


# retrieval


@query("i1_bm25", """select item_id, doc_id, score, cast(rank as int) as rank from (select item_id, doc_id, round(s, 6) as score, row_number() over (partition by item_id order by s desc, doc_id) as rank from (select q.item_id, d.doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as s from (select distinct item_id, unnest(regexp_extract_all(lower(text), '[0-9a-zа-я]+')) as t from benchmark) q
  join tf d on d.t = q.t join (select t, ln(1 + ((select count(*) from lens) - count(*) + 0.5::double) / (count(*) + 0.5)) as idf from tf group by t) f on f.t = q.t join lens l on l.doc_id = d.doc_id, (select greatest(avg(dl), 1) as avgdl from lens) group by q.item_id, d.doc_id)) where rank <= 20""",
  """toks as (select doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-zа-я]+')) as t from documents), tf as (select doc_id, t, count(*)::double as tf from toks group by doc_id, t),
  lens as (select d.doc_id, len(regexp_extract_all(lower(text), '[0-9a-zа-я]+')) as dl from documents d)""")
def bm25(spark, d):
    queries = v.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = rt.bm25(v.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), queries, 20)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("i6_water_fill_quotas", """select category, count(*) as quota from (select category, row_number() over (order by i / weight, category, i) as r from (
  select category, weight, n, unnest(range(1, least(n, 200) + 1)) as i from (select category, count(*) as n, count(distinct id1) % 5 + 1.0::double as weight from predictions group by category))) where r <= 200 group by category""")
def water_fill(spark, d):
    sizes = v.predictions(spark, d).groupBy("category").agg(_n().alias("capacity"), (F.count_distinct("id1") % 5 + 1.0).alias("weight"))
    return rt.water_fill(sizes, 200).select("category", "quota")
