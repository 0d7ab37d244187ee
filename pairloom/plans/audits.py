"""Queries of predicates, audits, selections and JSON functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as nm, text as tx
from ..operators import attributes as at, audit as au, graph as gr, metrics as me, pairs as pr, rules as ru
from ..sources import files as fi, views as v
from .base import query


def _n():
    return F.count(F.lit(1))


PARSED = """bags as (select id, category, name, json_valid(attributes) as ok, case when json_valid(attributes) then attributes else '{}' end as attributes from items)"""


@query("p4_p5_p6_bins", """select id1, id2, case when score >= 0.5 and target = 1 then 'hit' when score >= 0.5 then 'false alarm' when target = 1 then 'miss' else 'rest' end as kind,
  case when score < 0.2 then 'a' when score < 0.4 then 'b' when score < 0.6 then 'c' else 'd' end as left_closed, case when score <= 0.2 then 'a' when score <= 0.4 then 'b' when score <= 0.6 then 'c' else 'd' end as right_closed from predictions""")
def bins(spark, d):
    s, y = F.col("score"), F.col("target")
    kind = F.when((s >= 0.5) & (y == 1), "hit").when(s >= 0.5, "false alarm").when(y == 1, "miss").otherwise("rest")
    edges, labels = [0.2, 0.4, 0.6], ["a", "b", "c", "d"]
    return v.predictions(spark, d).select("id1", "id2", kind.alias("kind"), au.ladder(s, edges, labels).alias("left_closed"), au.ladder(s, edges, labels, True).alias("right_closed"))


@query("p8_p16_states_and_signatures", """select id1, id2, case when a = b then 'match' when a is not null and b is not null then 'conflict' when a is null or b is null then 'missing' end as brand,
  case when s = '' then 'none' else s end as signature from (select *, concat_ws('+', case when a <> b then 'brand' end, case when c <> e then 'size' end, case when abs(score - score_b) > 0.3 then 'models' end) as s from (
    select p.*, json_extract_string(x.attributes, '$.brand') as a, json_extract_string(y.attributes, '$.brand') as b, json_extract_string(x.attributes, '$.size') as c, json_extract_string(y.attributes, '$.size') as e
    from predictions p join bags x on x.id = p.id1 join bags y on y.id = p.id2))""", PARSED)
def states(spark, d):
    bag = at.parse(F.col("attributes"))
    parsed = v.items(spark, d).select("id", F.element_at(bag, "brand").alias("brand"), F.element_at(bag, "size").alias("size"))
    p = pr.hydrate(v.predictions(spark, d), parsed, ("brand", "size"))
    a, b = F.col("brand_1"), F.col("brand_2")
    flags = [(a != b, "brand"), (F.col("size_1") != F.col("size_2"), "size"), (F.abs(F.col("score") - F.col("score_b")) > 0.3, "models")]
    return p.select("id1", "id2", au.side_state(a == b, a.isNotNull() & b.isNotNull(), a.isNull() | b.isNull()).alias("brand"), au.signature(flags).alias("signature"))


@query("p10_prediction_validity", "select category, sum((target not in (0, 1))::int)::bigint as bad_labels, sum((score < 0 or score > 1)::int)::bigint as bad_scores, count(distinct target) as classes, count(distinct target) = 2 as valid from predictions group by category")
def validity(spark, d):
    return au.prediction_faults(v.predictions(spark, d))


@query("p11_rejection_reasons", "select id1, id2, r as reasons from (select id1, id2, concat_ws(',', case when abs(score - 0.5) < 0.1 then 'uncertain' end, case when score > 0.8 and target = 0 then 'wrong side' end, case when abs(id1 - id2) < 5 then 'too close' end) as r from predictions) where r <> ''")
def rejected(spark, d):
    s = F.col("score")
    rules = [(F.abs(s - 0.5) < 0.1, "uncertain"), ((s > 0.8) & (F.col("target") == 0), "wrong side"), (F.abs(F.col("id1") - F.col("id2")) < 5, "too close")]
    return v.predictions(spark, d).select("id1", "id2", F.array_join(au.reasons(rules), ",").alias("reasons")).filter("reasons <> ''")


@query("p13_relevance_filter", "select id1, id2 from predictions where category in ('SMALL', 'ECONOMY') and target in (1)")
def relevance(spark, d):
    return v.predictions(spark, d).filter(F.col("category").isin("SMALL", "ECONOMY") & F.col("target").isin(1)).select("id1", "id2")


@query("p14_one_hot", "select id, (category = 'SMALL')::int as small, (category = 'ECONOMY')::int as economy, (category = 'UNKNOWN')::int as other from items")
def hot(spark, d):
    out = au.one_hot(v.items(spark, d), "category", ["SMALL", "ECONOMY", "UNKNOWN"])
    return out.select("id", F.col("`category=SMALL`").alias("small"), F.col("`category=ECONOMY`").alias("economy"), F.col("`category=UNKNOWN`").alias("other"))


@query("p15_regimes", "select category, case category when 'SMALL' then 'strict' when 'ECONOMY' then 'tolerant' else 'default' end as regime, count(*) as n from items group by 1, 2")
def regimes(spark, d):
    table = F.create_map(F.lit("SMALL"), F.lit("strict"), F.lit("ECONOMY"), F.lit("tolerant"))
    return v.items(spark, d).groupBy("category", F.coalesce(F.element_at(table, F.col("category")), F.lit("default")).alias("regime")).agg(_n().alias("n"))


@query("a31_signal_conjunctions", """select a.s as signal_a, b.s as signal_b, count(*) as n, round(avg(a.target), 6) as rate from sig a join sig b on a.id1 = b.id1 and a.id2 = b.id2 and a.s < b.s group by 1, 2""",
  "sig as (select id1, id2, target, s from (select id1, id2, target, unnest([case when score > 0.6 then 'high' end, case when score_b > 0.6 then 'high_b' end, case when id1 % 3 = 0 then 'third' end, case when abs(score - score_c) > 0.4 then 'apart' end]) as s from predictions) where s is not null)")
def conjunctions(spark, d):
    s = [(F.col("score") > 0.6, "high"), (F.col("score_b") > 0.6, "high_b"), (F.col("id1") % 3 == 0, "third"), (F.abs(F.col("score") - F.col("score_c")) > 0.4, "apart")]
    rows = v.predictions(spark, d).select("target", F.array_sort(au.reasons(s)).alias("s"))
    one = rows.select("target", "s", F.posexplode("s").alias("i", "signal_a"))
    both = one.select("target", "signal_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("signal_b"))
    return both.groupBy("signal_a", "signal_b").agg(_n().alias("n"), F.round(F.avg("target"), 6).alias("rate"))


@query("a33_univariate_importance", """select feature, round(avg(ap), 6) as macro_ap from (select feature, category, sum(p * cp / cw) / max(tp) as ap from (
  select *, sum(w) over (partition by feature, category order by pt desc rows unbounded preceding) as cw, sum(p) over (partition by feature, category order by pt desc rows unbounded preceding) as cp, sum(p) over (partition by feature, category) as tp from (
    select feature, category, pt, count(*)::double as w, sum(target)::double as p from (select category, target, 'score' as feature, score as pt from predictions union all select category, target, 'score_b', score_b from predictions union all select category, target, 'score_c', score_c from predictions) group by 1, 2, 3)) group by 1, 2) group by 1""")
def importance(spark, d):
    names = ["score", "score_b", "score_c"]
    long = v.predictions(spark, d).select("category", "target", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in names))).alias("x")).select("category", "target", "x.*")
    return me.average_precision(long, ["feature", "category"]).groupBy("feature").agg(F.round(F.avg("ap"), 6).alias("macro_ap"))


@query("a34_hardness_quantiles", "select target, score > 0.3 as eligible, round(quantile_cont(abs(score - target), 0.5), 6) as p50, round(quantile_cont(abs(score - target), 0.9), 6) as p90, count(*) as n from predictions group by 1, 2")
def hardness(spark, d):
    wrong = F.abs(F.col("score") - F.col("target"))
    g = v.predictions(spark, d).groupBy("target", (F.col("score") > 0.3).alias("eligible"))
    return g.agg(F.round(F.percentile(wrong, 0.5), 6).alias("p50"), F.round(F.percentile(wrong, 0.9), 6).alias("p90"), _n().alias("n"))


@query("b1_b9_parsed_bags", "select id, ok, coalesce(json_extract_string(attributes, '$.color'), json_extract_string(attributes, '$.brand')) as first_filled, len(list_filter(json_keys(attributes), lambda k: regexp_matches(k, 'ri'))) as matching_keys from bags", PARSED)
def parsed(spark, d):
    bag = at.parse(F.col("attributes"))
    safe = F.coalesce(bag, F.create_map().cast("map<string,string>"))
    return v.items(spark, d).select("id", bag.isNotNull().alias("ok"), F.coalesce(F.element_at(safe, "color"), F.element_at(safe, "brand")).alias("first_filled"), F.size(F.filter(F.map_keys(safe), lambda k: k.rlike("ri"))).cast("long").alias("matching_keys"))


@query("b13_b14_best_fact", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by value desc, cast(json_extract_string(props, '$.k') as bigint) desc, event_id) as r from events) where r = 1")
def best_fact(spark, d):
    e = v.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    top = e.groupBy("user_id", "event_type").agg(F.min(F.struct((-F.col("value")).alias("a"), (-F.col("k")).alias("b"), "event_id")).alias("t"))
    return top.select("user_id", "event_type", "t.event_id")


@query("t21_t23_subtype_and_coverage", """select id, coalesce(json_extract_string(attributes, '$.type'), split_part(name, ' ', 1)) as subtype,
  len(list_filter(list_distinct(string_split(lower(name), ' ')), lambda t: contains(lower(attributes), t))) as covered, len(list_distinct(string_split(lower(name), ' '))) as tokens from bags""", PARSED)
def subtype(spark, d):
    bag = at.parse(F.col("attributes"))
    rows = v.items(spark, d).select("id", "name", bag.alias("bag"), F.when(bag.isNotNull(), F.col("attributes")).otherwise("{}").alias("text"))
    words = F.array_distinct(F.split(F.lower("name"), " "))
    return rows.select("id", F.coalesce(F.element_at("bag", "type"), F.substring_index("name", " ", 1)).alias("subtype"), F.size(F.filter(words, lambda t: F.contains(F.lower("text"), t))).cast("long").alias("covered"), F.size(words).cast("long").alias("tokens"))


@query("n26_n27_weighted_scores", "select id1, id2, round(0.45 * score + 0.20 * score_b + 0.15 * score_c + 0.15 * abs(score - score_b) + 0.05 * target, 6) as hard, round(1 / (1 + exp(-(ln(greatest(score, 0.001)) - ln(greatest(1 - score, 0.001))))), 6) as softmax from predictions")
def weighted(spark, d):
    s, b, c = (F.col(x) for x in ("score", "score_b", "score_c"))
    two = nm.sigmoid(F.log(F.greatest(s, F.lit(0.001))) - F.log(F.greatest(1 - s, F.lit(0.001))))
    return v.predictions(spark, d).select("id1", "id2", F.round(0.45 * s + 0.20 * b + 0.15 * c + 0.15 * F.abs(s - b) + 0.05 * F.col("target"), 6).alias("hard"), F.round(two, 6).alias("softmax"))


@query("l12_balance_supplement", "select id1, id2, category, target from (select *, row_number() over (partition by category, target order by abs(score - 0.5) desc, md5(concat(id1, ':', id2)), id1, id2) as r from predictions where id1 % 2 = 1) where r <= case when target = 1 then 12 else 20 end")
def supplement(spark, d):
    weak = v.predictions(spark, d).filter("id1 % 2 = 1").select("id1", "id2", "category", "target", "score")
    plan = weak.select("category", "target").distinct().withColumn("needed", F.when(F.col("target") == 1, 12).otherwise(20))
    order = [F.desc(F.abs(F.col("score") - 0.5)), F.md5(F.concat_ws(":", "id1", "id2").cast("binary")), "id1", "id2"]
    return au.supplement(weak, plan, order).select("id1", "id2", "category", "target")


@query("l24_error_curriculum", "select id1, id2, case when wrong and hard then 'ERROR_AND_HARD' when wrong then 'ERROR_ONLY' else 'HARD_ONLY' end as kind from (select *, (score >= 0.5)::int <> target as wrong, abs(score - target) >= 0.4 as hard from predictions) where wrong or hard")
def curriculum(spark, d):
    wrong, hard = (F.col("score") >= 0.5).cast("int") != F.col("target"), F.abs(F.col("score") - F.col("target")) >= 0.4
    kind = F.when(wrong & hard, "ERROR_AND_HARD").when(wrong, "ERROR_ONLY").otherwise("HARD_ONLY")
    return v.predictions(spark, d).filter(wrong | hard).select("id1", "id2", kind.alias("kind"))


@query("m24_effect_scope", "select case when low > 0.25 then 'GLOBAL' when low > 0.15 then 'WITH_EXCEPTIONS' when high > 0.5 then 'CATEGORY_SPECIFIC' else 'HETEROGENEOUS' end as scope, count(*) as rules from (select p_brand, min(rate) as low, max(rate) as high from (select p_brand, category, avg(target) as rate from predictions join part on p_partkey = id1 group by 1, 2) group by 1) group by 1")
def scope(spark, d):
    brand = v.read(spark, d, "part").select(F.col("p_partkey").alias("id1"), "p_brand")
    rates = v.predictions(spark, d).join(pr.small(brand), "id1").groupBy("p_brand", "category").agg(F.avg("target").alias("rate"))
    g = rates.groupBy("p_brand").agg(F.min("rate").alias("low"), F.max("rate").alias("high"))
    kind = F.when(F.col("low") > 0.25, "GLOBAL").when(F.col("low") > 0.15, "WITH_EXCEPTIONS").when(F.col("high") > 0.5, "CATEGORY_SPECIFIC").otherwise("HETEROGENEOUS")
    return g.groupBy(kind.alias("scope")).agg(_n().alias("rules"))


@query("r24_runtime_estimate", "select share, round(78.4 + share * 54.1, 6) as minutes from (select unnest([0.05, 0.4, 1.0])::double as share)")
def runtime(spark, d):
    return spark.createDataFrame([(0.05,), (0.4,), (1.0,)], "share double").withColumn("minutes", F.round(78.4 + F.col("share") * 54.1, 6))


@query("r29_length_buckets", "select bucket, count(*) as n, min(len) as low, max(len) as high from (select length(text) as len, (row_number() over (order by length(text), doc_id) - 1) // 64 as bucket from documents) group by bucket")
def buckets(spark, d):
    t = v.read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("len"))
    nth = F.row_number().over(Window.orderBy("len", "doc_id")) - 1
    return t.select("len", nth.alias("nth")).groupBy(F.floor(F.col("nth") / 64).alias("bucket")).agg(_n().alias("n"), F.min("len").alias("low"), F.max("len").alias("high"))


@query("i15_evidence_weights", "select id1, id2, round(least(n / m, 2.0), 6) as weight from (select id1, id2, count(*) over (partition by id1)::double as n from matches), (select median(n)::double as m from (select count(*) as n from matches group by id1))")
def evidence(spark, d):
    m = v.matches(spark, d)
    counts = m.groupBy("id1").agg(_n().cast("double").alias("n"))
    middle = counts.agg(F.percentile("n", 0.5).alias("m"))
    return m.join(counts, "id1").join(F.broadcast(middle)).select("id1", "id2", F.round(F.least(F.col("n") / F.col("m"), F.lit(2.0)), 6).alias("weight"))


@query("l14_l22_hash_samples", "select id1, id2 from (select *, row_number() over (partition by category order by md5(concat('mix:', id1, ':', id2)), id1, id2) as r, count(*) over (partition by category) as n from predictions) where r <= greatest(1, floor(n * 0.1))")
def samples(spark, d):
    order = [F.md5(F.concat(F.lit("mix:"), F.concat_ws(":", "id1", "id2")).cast("binary")), "id1", "id2"]
    return au.anchored(v.predictions(spark, d), ["category"], 0.1, order).select("id1", "id2")
