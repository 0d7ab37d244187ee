"""Queries of sources, predicates, joins, set operations and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, pairs as pr
from ..sources import views as v
from .base import query

AP = """
points as (select category, pt, count(*)::double as w, sum(target)::double as p from scored group by category, pt),
curve as (select *, sum(w) over (partition by category order by pt desc rows unbounded preceding) as cw,
  sum(p) over (partition by category order by pt desc rows unbounded preceding) as cp, sum(p) over (partition by category) as tp from points)"""

SCORED = """
norm as (select id, trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')) as name,
  trim(regexp_replace(lower(attributes), '[^a-z0-9_]+', ' ', 'g')) as attributes, category from items),
pairs as (select m.id1, m.id2, m.target, a.category,
    0.75::double * (a.name = b.name and a.name <> '')::int + 0.20::double * (a.attributes = b.attributes and a.attributes <> '')::int
    + 0.05::double * (a.category = b.category and a.category <> '')::int
    + 0.01::double * least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name), 1) as predict
  from matches m join norm a on a.id = m.id1 join norm b on b.id = m.id2),
scored as (select category, target, round(predict, 9) as pt from pairs)"""


@query("flagship_macro_ap", "select category, round(sum(p * cp / cw) / max(tp), 6) as ap, cast(sum(w) as bigint) as pairs from curve group by category", SCORED + "," + AP)
def flagship(spark, d):
    scored = pr.score_pairs(v.matches(spark, d), v.items(spark, d)).select(F.col("category_1").alias("category"), "target", F.round("predict", 9).alias("score"))
    ap = metrics.average_precision(scored, ["category"])
    sizes = scored.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"))
    return ap.join(sizes, "category").select("category", F.round("ap", 6).alias("ap"), "pairs")


@query("n22_heuristic_score", "select id1, id2, round(predict, 6) as predict from pairs", SCORED)
def heuristic(spark, d):
    return pr.score_pairs(v.matches(spark, d), v.items(spark, d)).select("id1", "id2", F.round("predict", 6).alias("predict"))


@query("s1_required_columns_unique_ids", "select count(*) as items, count(distinct id) as ids, (select count(*) from (select id from items group by id having count(*) > 1)) as repeated from items")
def load_items(spark, d):
    items = pr.require_columns(v.items(spark, d), pr.ITEM_COLUMNS, "items")
    repeated = pr.repeated_ids(items).agg(F.count(F.lit(1)).alias("repeated"))
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("id").alias("ids")).join(repeated)


@query("s5_selected_ids_scan", "select id, name from items where id in (select id1 from matches where target = 1)")
def selected(spark, d):
    ids = v.matches(spark, d).filter("target = 1").select(F.col("id1").alias("id"))
    return v.items(spark, d).join(ids, "id", "left_semi").select("id", "name")


@query("s6_dictionary_codes", "select id, dense_rank() over (order by category) - 1 as code from items")
def codes(spark, d):
    items = v.items(spark, d)
    named = items.select("category").distinct().select("category", (F.dense_rank().over(pr_window("category")) - 1).alias("code"))
    return items.join(F.broadcast(named), "category").select("id", "code")


def pr_window(*columns):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


@query("s9_latest_checkpoint", "select user_id, event_id, k from (select user_id, event_id, cast(json_extract_string(props, '$.k') as bigint) as k, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest(spark, d):
    from ..streaming.latest import latest_per_key

    log = v.read(spark, d, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return latest_per_key(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "k")


@query("k1_prediction_output", "select id1, id2, round(score, 6) as predict, (not isnan(score) and not isinf(score)) as finite from predictions")
def output(spark, d):
    score = F.col("score")
    finite = ~F.isnan(score) & (F.abs(score) < float("inf"))
    return v.predictions(spark, d).select("id1", "id2", F.round("score", 6).alias("predict"), finite.alias("finite"))


@query("k8_upsert", "select id1, id2, score from predictions where not (target = 1 and id1 % 3 = 0) union all select id1, id2, score_b from predictions where target = 1 and id1 % 3 = 0")
def upsert(spark, d):
    p = v.predictions(spark, d)
    new = p.filter("target = 1 and id1 % 3 = 0").select("id1", "id2", F.col("score_b").alias("score"))
    return pr.upsert(p.select("id1", "id2", "score"), new, ["id1", "id2"])


@query("p1_integrity", """select (select count(*) from items) as items, (select count(distinct id) from items) as unique_item_ids,
  (select sum((id is null)::int + (name is null)::int + (attributes is null)::int + (category is null)::int) from items)::bigint as item_null_cells,
  (select count(*) from matches) as pairs, (select sum((id1 is null)::int + (id2 is null)::int + (target is null)::int) from matches)::bigint as pair_null_cells,
  (select count(*) from matches where id1 = id2) as self_pairs, (select count(distinct target) from matches) as target_values,
  (select count(*) - count(distinct (least(id1, id2), greatest(id1, id2))) from matches)::bigint as duplicate_unordered_pairs,
  (select count(*) from matches where id1 not in (select id from items)) as missing_id1_references,
  (select count(*) from matches where id2 not in (select id from items)) as missing_id2_references,
  (select count(*) - count(distinct id) from items)::bigint as duplicate_item_ids""")
def integrity(spark, d):
    return pr.integrity(v.items(spark, d), v.matches(spark, d))


@query("p2_p3_canonical_orientation", "select id1, id2, least(id1, id2) as lo, greatest(id1, id2) as hi, case when id1 = least(id1, id2) then 'canonical' else 'reversed' end as orientation from matches")
def orientation(spark, d):
    p = pr.canonical(v.matches(spark, d))
    return p.select("id1", "id2", "lo", "hi", F.when(F.col("id1") == F.col("lo"), "canonical").otherwise("reversed").alias("orientation"))


@query("j1_hydration", "select id1, id2, target, a.name as name_1, b.name as name_2, a.category as category_1, b.category as category_2 from matches join items a on a.id = id1 join items b on b.id = id2")
def hydration(spark, d):
    return pr.hydrate(v.matches(spark, d), v.items(spark, d), ("name", "category"), strict=True)


@query("j6_symmetric_alignment", """select coalesce(a.lo, b.lo) as lo, coalesce(a.hi, b.hi) as hi, case when a.lo is null then 'right only' when b.lo is null then 'left only'
  when a.target <> b.target then 'target differs' when a.category <> b.category then 'category differs' else 'aligned' end as state
  from (select least(id1, id2) as lo, greatest(id1, id2) as hi, target, category from predictions where id1 % 7 <> 0) a
  full join (select least(id1, id2) as lo, greatest(id1, id2) as hi, case when id1 % 5 = 0 then 1 - target else target end as target, category from predictions where id2 % 9 <> 0) b
  on a.lo = b.lo and a.hi = b.hi""")
def alignment(spark, d):
    p = v.predictions(spark, d)
    right = p.filter("id2 % 9 <> 0").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.when(F.col("id1") % 5 == 0, 1 - F.col("target")).otherwise(F.col("target")).alias("target"), "category", "score")
    return pr.align_predictions(p.filter("id1 % 7 <> 0"), right).select("lo", "hi", "state")


@query("j7_canonical_align", "select least(a.id1, a.id2) as lo, greatest(a.id1, a.id2) as hi, a.score, b.score_b from predictions a join predictions b on least(a.id1, a.id2) = least(b.id1, b.id2) and greatest(a.id1, a.id2) = greatest(b.id1, b.id2)")
def canonical_align(spark, d):
    p = pr.canonical(v.predictions(spark, d))
    return p.select("lo", "hi", "score").join(p.select("lo", "hi", "score_b"), ["lo", "hi"])


@query("j8_context_twice", "select id1, id2, a.name as name_1, b.name as name_2 from predictions join items a on a.id = id1 join items b on b.id = id2 where target = 0")
def context(spark, d):
    return pr.hydrate(v.predictions(spark, d).filter("target = 0").select("id1", "id2"), v.items(spark, d), ("name",))


@query("j9_many_to_many", "select a.id1, a.id2, b.id2 as other, c.category from matches a join matches b on a.id1 = b.id1 and a.id2 < b.id2 join items c on c.id = a.id1")
def many(spark, d):
    m = v.matches(spark, d)
    other = m.select("id1", F.col("id2").alias("other"))
    category = v.items(spark, d).select(F.col("id").alias("id1"), "category")
    return m.join(other, "id1").filter("id2 < other").join(category, "id1").select("id1", "id2", "other", "category")


@query("j10_left_merge_chain", """select i.id, coalesce(a.n, 0) as as_first, coalesce(b.n, 0) as as_second from items i
  left join (select id1, count(*) as n from matches group by id1) a on a.id1 = i.id left join (select id2, count(*) as n from matches group by id2) b on b.id2 = i.id""")
def chain(spark, d):
    m = v.matches(spark, d)
    out = v.items(spark, d).select("id")
    for c, name in (("id1", "as_first"), ("id2", "as_second")):
        out = out.join(m.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(name)), "id", "left")
    return out.select("id", F.coalesce("as_first", F.lit(0)).alias("as_first"), F.coalesce("as_second", F.lit(0)).alias("as_second"))


@query("j12_indicator", "select case when a.id is null then 'right_only' when b.id is null then 'left_only' else 'both' end as side, count(*) as n from (select id from items where id % 3 <> 0) a full join (select id from items where id % 5 <> 0) b on a.id = b.id group by 1")
def indicator(spark, d):
    i = v.items(spark, d)
    a, b = i.filter("id % 3 <> 0").select("id", F.lit(1).alias("l")), i.filter("id % 5 <> 0").select("id", F.lit(1).alias("r"))
    side = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    return a.join(b, "id", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("j13_semi_join", "select id, category from items where id in (select id1 from matches union select id2 from matches)")
def semi(spark, d):
    return v.items(spark, d).join(pr.endpoints(v.matches(spark, d)), "id", "left_semi").select("id", "category")


@query("j14_anti_joins", """select id1, id2 from predictions p where id1 % 13 <> 0 and id2 % 13 <> 0
  and not exists (select 1 from matches f where f.target = 1 and f.id1 % 4 = 1 and least(f.id1, f.id2) = least(p.id1, p.id2) and greatest(f.id1, f.id2) = greatest(p.id1, p.id2))""")
def anti(spark, d):
    p = v.predictions(spark, d).select("id1", "id2")
    ids = v.items(spark, d).filter("id % 13 = 0").select("id")
    bad = v.matches(spark, d).filter("target = 1 and id1 % 4 = 1").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    return pr.without(p, ids, bad)


@query("j15_either_endpoint", "select id1, id2 from matches where id1 % 17 = 0 or id2 % 17 = 0")
def either(spark, d):
    return pr.touching(v.matches(spark, d).select("id1", "id2"), v.items(spark, d).filter("id % 17 = 0").select("id"))


@query("j16_straddling", "select id1, id2 from matches where (id1 % 2 = 0) <> (id2 % 2 = 0)")
def straddle(spark, d):
    return pr.straddling(v.matches(spark, d).select("id1", "id2"), v.items(spark, d).filter("id % 2 = 0").select("id"))


@query("j21_symmetric_difference", "(select id from items where id % 3 = 0 except select id from items where id % 4 = 0) union all (select id from items where id % 4 = 0 except select id from items where id % 3 = 0)")
def difference(spark, d):
    i = v.items(spark, d).select("id")
    a, b = i.filter("id % 3 = 0"), i.filter("id % 4 = 0")
    return a.subtract(b).union(b.subtract(a))


@query("j20_model_outputs", "select id1, id2, score, score_b, score_c from predictions where id1 % 3 > 0 and id2 % 4 > 0")
def outputs(spark, d):
    p = pr.canonical(v.predictions(spark, d))
    out = p.filter("id1 % 3 > 0").select("id1", "id2", "lo", "hi", "score")
    out = out.join(p.filter("id2 % 4 > 0").select("lo", "hi", "score_b"), ["lo", "hi"])
    return out.join(p.select("lo", "hi", "score_c"), ["lo", "hi"]).select("id1", "id2", "score", "score_b", "score_c")


@query("u1_union_all", "select id1, id2, target, null::double as score from matches union all select id1, id2, target, score from predictions")
def union_all(spark, d):
    return v.matches(spark, d).unionByName(v.predictions(spark, d).select("id1", "id2", "target", "score"), allowMissingColumns=True)


@query("u2_distinct_endpoints", "select id1 as id from matches union select id2 from matches")
def distinct_endpoints(spark, d):
    return pr.endpoints(v.matches(spark, d)).distinct()


@query("u3_set_counts", "select (select count(*) from (select id1 from matches intersect select id2 from matches)) as both_sides, (select count(*) from (select id1 from matches except select id2 from matches)) as first_only")
def set_counts(spark, d):
    m = v.matches(spark, d)
    a, b = m.select(F.col("id1").alias("id")), m.select(F.col("id2").alias("id"))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("both_sides")).join(a.subtract(b).agg(F.count(F.lit(1)).alias("first_only")))


@query("u4_shared_across_splits", "select id, count(distinct target) as n from (select id1 as id, target from matches union all select id2, target from matches) group by id having count(distinct target) > 1")
def shared(spark, d):
    return pr.endpoints(v.matches(spark, d), "target").groupBy("id").agg(F.count_distinct("target").alias("n")).filter("n > 1")


@query("u5_missing_ids", "select id from items except (select id1 from matches union select id2 from matches)")
def missing(spark, d):
    return v.items(spark, d).select("id").subtract(pr.endpoints(v.matches(spark, d)))


@query("u6_unique_keys", "select name, min(id) as id from items group by name having count(*) = 1")
def unique_keys(spark, d):
    return v.items(spark, d).groupBy("name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
