"""Queries of aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attributes as at, pairs as pr, ranking as rk
from ..sources import views as v
from .base import query

def _n():
    return F.count(F.lit(1))


ENTRIES = """keyed as (select id, category, k as key, json_extract_string(attributes, concat('$.', k)) as value
  from (select id, category, attributes, unnest(json_keys(case when json_valid(attributes) then attributes else '{}' end)) as k from items))"""


@query("a1_category_summary", """select i.category, i.items, p.pairs, p.positives, p.pairs - p.positives as negatives, round(p.positives / p.pairs::double, 6) as positive_rate
  from (select category, count(*) as items from items group by category) i full join
  (select category, count(*) as pairs, sum(target)::bigint as positives from predictions group by category) p on i.category = p.category""")
def category_summary(spark, d):
    items = v.items(spark, d).groupBy("category").agg(_n().alias("items"))
    pairs = v.predictions(spark, d).groupBy("category").agg(_n().alias("pairs"), F.sum("target").alias("positives"))
    out = items.join(pairs, "category", "full").withColumn("negatives", F.col("pairs") - F.col("positives"))
    return out.withColumn("positive_rate", F.round(F.col("positives") / F.col("pairs"), 6))


@query("a2_category_quota", "select category, target, count(*) as n from predictions group by category, target")
def quota(spark, d):
    return v.predictions(spark, d).groupBy("category", "target").agg(_n().alias("n"))


@query("a3_attribute_key_frequency", "select key, count(distinct id) as items, round(count(distinct id) / (select count(*) from items)::double, 6) as coverage from keyed group by key", ENTRIES)
def key_frequency(spark, d):
    return at.key_frequency(v.items(spark, d)).select("key", "items", F.round("coverage", 6).alias("coverage"))


@query("a3_coverage_matrix", "select i.category, " + ", ".join(f"round(count(*) filter (where key = '{k}') / max(n)::double, 6) as {k}" for k in ("brand", "size", "price", "color")) + " from (select category, count(*) as n from items group by category) i left join keyed on keyed.category = i.category group by i.category", ENTRIES)
def coverage(spark, d):
    return at.coverage_by_category(v.items(spark, d), ["brand", "size", "price", "color"])


@query("a3_json_quality", "select count(*) filter (where not json_valid(attributes)) as invalid_json_rows, count(*) filter (where n = 0) as empty_attribute_objects, round(avg(n), 6) as mean_keys, round(quantile_cont(n, 0.5), 6) as median_keys, round(quantile_cont(n, 0.95), 6) as p95_keys from (select attributes, case when json_valid(attributes) then len(json_keys(attributes)) else 0 end as n from items)")
def json_quality(spark, d):
    bag = at.parse(F.col("attributes"), keep_empty=True)
    rows = v.items(spark, d).select(bag.isNull().alias("bad"), F.coalesce(F.size(bag), F.lit(0)).alias("n"))
    rows = rows.withColumn("n", F.when(F.col("bad"), 0).otherwise(F.col("n")))
    return rows.agg(F.count_if("bad").alias("invalid_json_rows"), F.count_if(F.col("n") == 0).alias("empty_attribute_objects"), F.round(F.avg("n"), 6).alias("mean_keys"), F.round(F.percentile("n", 0.5), 6).alias("median_keys"), F.round(F.percentile("n", 0.95), 6).alias("p95_keys"))


@query("a4_a5_frequent_keys", """select key, items, occurrences, rank from (select *, row_number() over (order by occurrences desc, items desc, key) as rank,
  coalesce(sum(occurrences) over (order by occurrences desc, items desc, key rows between unbounded preceding and 1 preceding), 0) / sum(occurrences) over ()::double as before
  from (select key, count(distinct id) as items, count(*) as occurrences from keyed group by key)) where before < 0.9 and items >= 50 and rank <= 10""", ENTRIES)
def frequent(spark, d):
    return at.frequent_keys(v.items(spark, d), 0.9, 50, 10)


@query("a6_endpoint_degree", """select degree, count(*) as items, sum(pos)::bigint as positives, round(sum(count(*)) over (order by degree) / sum(count(*)) over ()::double, 6) as share
  from (select id, count(*) as degree, sum(target) as pos from (select id1 as id, target from matches union all select id2, target from matches) group by id) group by degree""")
def degree(spark, d):
    ends = pr.endpoints(v.matches(spark, d), "target").groupBy("id").agg(_n().alias("degree"), F.sum("target").alias("pos"))
    counts = ends.groupBy("degree").agg(_n().alias("items"), F.sum("pos").alias("positives"))
    up = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("share", F.round(F.sum("items").over(up) / F.sum("items").over(Window.partitionBy()), 6))


@query("a7_endpoints_by_category", "select category, count(distinct id) as items from (select category, id1 as id from predictions union all select category, id2 from predictions) group by category")
def endpoints(spark, d):
    return pr.endpoints(v.predictions(spark, d), "category").groupBy("category").agg(F.count_distinct("id").alias("items"))


@query("a8_a9_label_histogram", "select coalesce(category, '__ALL__') as category, count(*) as pairs, sum(target)::bigint as positives, round(avg(score), 6) as mean_score from predictions group by grouping sets ((category), ())")
def histogram(spark, d):
    rows = v.predictions(spark, d).rollup("category").agg(_n().alias("pairs"), F.sum("target").alias("positives"), F.round(F.avg("score"), 6).alias("mean_score"))
    return rows.withColumn("category", F.coalesce("category", F.lit("__ALL__")))


@query("a10_soft_label_grid", "select k, count(*) as n, count(*) filter (where target = 1) as positives, round(count(*) / sum(count(*)) over ()::double, 6) as share from (select cast(round(score * 9) as bigint) as k, target from predictions) group by k")
def grid(spark, d):
    rows = v.predictions(spark, d).select(F.round(F.col("score") * 9).cast("long").alias("k"), "target")
    out = rows.groupBy("k").agg(_n().alias("n"), F.count_if(F.col("target") == 1).alias("positives"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


SPLIT = "case when ('0x' || substr(md5(category || id1), 1, 8))::bigint % 5 = 0 then 'valid' else 'train' end"


def split_of():
    return F.when(v.hash_int(F.concat("category", "id1")) % 5 == 0, "valid").otherwise("train")


@query("a15_strong_asymmetry", """select p.id1, p.id2 from predictions p join items a on a.id = p.id1 join items b on b.id = p.id2
  join (select category, quantile_cont(length(attributes), 0.1) as lo, quantile_cont(length(attributes), 0.9) as hi from items group by category) q on q.category = p.category
  where least(length(a.attributes), length(b.attributes)) <= lo and greatest(length(a.attributes), length(b.attributes)) >= hi""")
def asymmetry(spark, d):
    items = v.items(spark, d).select("id", "category", F.length("attributes").alias("detail"))
    limits = items.groupBy("category").agg(F.percentile("detail", 0.1).alias("lo"), F.percentile("detail", 0.9).alias("hi"))
    pairs = pr.hydrate(v.predictions(spark, d).select("id1", "id2", "category"), items, ("detail",)).join(F.broadcast(limits), "category")
    return pairs.filter((F.least("detail_1", "detail_2") <= F.col("lo")) & (F.greatest("detail_1", "detail_2") >= F.col("hi"))).select("id1", "id2")


@query("a16_vocabulary_overlap", """select a.category as category_a, b.category as category_b, round(count(*) filter (where a.w = b.w) / (max(a.n) + max(b.n) - count(*) filter (where a.w = b.w))::double, 6) as jaccard
  from (select *, count(*) over (partition by category) as n from (select distinct p_type as category, p_name as w from part)) a
  join (select *, count(*) over (partition by category) as n from (select distinct p_type as category, p_name as w from part)) b on a.category < b.category group by 1, 2""")
def overlap(spark, d):
    words = v.read(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("w")).distinct()
    sizes = words.groupBy("category").agg(_n().alias("n"))
    shared = words.alias("a").join(words.alias("b"), F.col("a.w") == F.col("b.w")).filter("a.category < b.category")
    shared = shared.groupBy(F.col("a.category").alias("category_a"), F.col("b.category").alias("category_b")).agg(_n().alias("c"))
    grid = sizes.select(F.col("category").alias("category_a"), F.col("n").alias("na")).join(F.broadcast(sizes.select(F.col("category").alias("category_b"), F.col("n").alias("nb"))), F.col("category_a") < F.col("category_b"))
    out = grid.join(shared, ["category_a", "category_b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return out.select("category_a", "category_b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


@query("a17_surface_variants", "select key, count(distinct raw) as variants, count(*) as n from (select lower(regexp_replace(text, '[^a-zA-Z]+', '', 'g')) as key, text as raw from (select unnest(string_split(text, ' ')) as text from benchmark)) where key <> '' group by key having count(distinct raw) > 1 order by variants desc, n desc, key limit 100")
def variants(spark, d):
    words = v.read(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("raw"))
    keyed = words.withColumn("key", F.lower(F.regexp_replace("raw", "[^a-zA-Z]+", ""))).filter("key <> ''")
    out = keyed.groupBy("key").agg(F.count_distinct("raw").alias("variants"), _n().alias("n")).filter("variants > 1")
    return out.orderBy(F.desc("variants"), F.desc("n"), "key").limit(100)


@query("a18_keys_by_category_count", "select categories, count(*) as keys from (select key, count(distinct category) as categories from keyed group by key) group by categories", ENTRIES)
def key_spread(spark, d):
    keys = at.entries(v.items(spark, d), "category").groupBy("key").agg(F.count_distinct("category").alias("categories"))
    return keys.groupBy("categories").agg(_n().alias("keys"))


@query("a21_group_summary", "select category, target, round(avg(score), 6) as mean, round(quantile_cont(score, 0.5), 6) as p50, round(quantile_cont(score, 0.9), 6) as p90 from predictions group by category, target")
def summary(spark, d):
    return v.predictions(spark, d).groupBy("category", "target").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.percentile("score", 0.5), 6).alias("p50"), F.round(F.percentile("score", 0.9), 6).alias("p90"))


@query("a22_group_purity", """select p_brand as key, p_type as top, n as votes, total as support, round(n / total::double, 6) as purity from (
  select p_brand, p_type, count(*) as n, sum(count(*)) over (partition by p_brand)::bigint as total, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by p_brand, p_type) where r = 1 and n / total::double >= 0.2""")
def purity(spark, d):
    return rk.purity(v.read(spark, d, "part"), "p_brand", "p_type", 0.2).select("key", "top", "votes", "support", F.round("purity", 6).alias("purity"))


BAGS = ENTRIES + """, shared as (select p.id1, p.id2, p.category, p.target, a.key, a.value = b.value as equal from predictions p join keyed a on a.id = p.id1 join keyed b on b.id = p.id2 and b.key = a.key)"""


def bag_pairs(spark, d):
    bags = v.items(spark, d).select("id", F.coalesce(at.parse(F.col("attributes")), F.create_map().cast("map<string,string>")).alias("bag"))
    return pr.hydrate(v.predictions(spark, d).select("id1", "id2", "category", "target"), bags, ("bag",))


@query("a23_a24_discriminative_keys", """select category, key, n, n_equal, strength, rank from (select *, row_number() over (partition by category order by strength desc, key) as rank from (
  select category, key, count(*) as n, count(*) filter (where equal) as n_equal,
  round(abs((coalesce(sum(target) filter (where equal), 0) + 1.0::double) / (count(*) filter (where equal) + 2) - (coalesce(sum(target) filter (where not equal), 0) + 1.0::double) / (count(*) filter (where not equal) + 2)) * ln(1.0::double + count(*)), 9) as strength
  from shared group by category, key)) where rank <= 3""", BAGS)
def discriminative(spark, d):
    return at.discriminative_keys(bag_pairs(spark, d), 3)


@query("b11_shared_keys", "select p.id1, p.id2, count(s.key) as shared_keys, count(*) filter (where equal) as matches, count(*) filter (where not equal) as conflicts from predictions p left join shared s on s.id1 = p.id1 and s.id2 = p.id2 group by p.id1, p.id2", BAGS)
def shared_keys(spark, d):
    out = at.shared_key_comparison(bag_pairs(spark, d))
    return out.select("id1", "id2", *(F.col(c).cast("long").alias(c) for c in ("shared_keys", "matches", "conflicts")))


@query("a26_threshold_grid", """select t as threshold, sum((score >= t and target = 1)::int)::bigint as tp, sum((score >= t and target = 0)::int)::bigint as fp, round(sum((score >= t and target = 1)::int) / sum(target)::double, 6) as recall
  from predictions, (select unnest([0.1, 0.3, 0.5, 0.7, 0.9])::double as t) group by t""")
def threshold_grid(spark, d):
    # thresholds become columns first, so the pairs are read once and only sums are unpivoted
    hit = lambda t: F.col("score") >= t
    grid = [0.1, 0.3, 0.5, 0.7, 0.9]
    sums = v.predictions(spark, d).agg(F.sum("target").alias("p"), *(F.count_if(hit(t) & (F.col("target") == 1)).alias(f"tp{i}") for i, t in enumerate(grid)), *(F.count_if(hit(t) & (F.col("target") == 0)).alias(f"fp{i}") for i, t in enumerate(grid)))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.round(F.col(f"tp{i}") / F.col("p"), 6).alias("recall")) for i, t in enumerate(grid)))).alias("r"))
    return rows.select("r.*")


@query("a25_confusion", "select category, sum((score >= 0.5 and target = 1)::int)::bigint as tp, sum((score >= 0.5 and target = 0)::int)::bigint as fp, sum((score < 0.5 and target = 1)::int)::bigint as fn, sum((score < 0.5 and target = 0)::int)::bigint as tn from predictions group by category")
def confusion(spark, d):
    from ..operators import metrics

    return metrics.confusion(v.predictions(spark, d), ["category"], F.lit(0.5)).select("category", "tp", "fp", "fn", "tn")


@query("a28_correlations", """select round(corr(score, score_b), 6) as pearson, round(corr(ra, rb), 6) as spearman from (select score, score_b, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as ra,
  rank() over (order by score_b) + (count(*) over (partition by score_b) - 1) / 2.0::double as rb from predictions)""")
def correlations(spark, d):
    p = rk.average_rank(rk.average_rank(v.predictions(spark, d).select("score", "score_b"), "score", "ra"), "score_b", "rb")
    return p.agg(F.round(F.corr("score", "score_b"), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


@query("a32_decile_calibration", "select decile, count(*) as n, round(avg(score), 6) as mean_score, round(avg(target), 6) as rate from (select score, target, ntile(10) over (order by score, id1, id2) as decile from predictions) group by decile")
def deciles(spark, d):
    return rk.calibration_table(v.predictions(spark, d), 10, ["score", "id1", "id2"])


@query("a36_crosstab", "select category, sum((target = 0)::int)::bigint as t0, sum((target = 1)::int)::bigint as t1, round(avg(target), 6) as share from predictions group by category")
def crosstab(spark, d):
    out = v.predictions(spark, d).groupBy("category").pivot("target", [0, 1]).agg(_n())
    out = out.select("category", F.coalesce("0", F.lit(0)).alias("t0"), F.coalesce("1", F.lit(0)).alias("t1"))
    return out.withColumn("share", F.round(F.col("t1") / (F.col("t0") + F.col("t1")), 6))


@query("a42_dominant_key", "select category, key, n from (select category, key, count(*) as n, row_number() over (partition by category order by count(*) desc, key) as r from keyed group by category, key) where r = 1", ENTRIES)
def dominant(spark, d):
    counts = at.entries(v.items(spark, d), "category").groupBy("category", "key").agg(_n().alias("n"))
    top = counts.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("neg"), "key")).alias("t"))
    return top.select("category", F.col("t.key").alias("key"), (-F.col("t.neg")).alias("n"))


@query("a43_value_support", "select category, key, value, count(*) as support from keyed group by category, key, value", ENTRIES)
def value_support(spark, d):
    return at.entries(v.items(spark, d), "category").groupBy("category", "key", "value").agg(_n().alias("support"))


@query("a41_rule_error_counts", "select p_brand as rule, count(distinct id1) as items, count(*) as pairs, sum(wrong)::bigint as errors, round(sum(wrong) / count(*)::double, 6) as error_rate from (select p_brand, id1, ((score >= 0.5)::int <> target)::int as wrong from predictions join part on p_partkey = id1) group by p_brand")
def rule_errors(spark, d):
    brand = v.read(spark, d, "part").select(F.col("p_partkey").alias("id1"), F.col("p_brand").alias("rule"))
    wrong = ((F.col("score") >= 0.5).cast("int") != F.col("target")).cast("int")
    out = v.predictions(spark, d).join(pr.small(brand), "id1").groupBy("rule").agg(F.count_distinct("id1").alias("items"), _n().alias("pairs"), F.sum(wrong).alias("errors"))
    return out.withColumn("error_rate", F.round(F.col("errors") / F.col("pairs"), 6))


# windows


@query("w1_normalized_rank", "select id1, id2, round((rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double) / count(*) over (), 9) as r from predictions")
def normalized_rank(spark, d):
    return rk.percent_rank_average(v.predictions(spark, d), "score", [], "r").select("id1", "id2", F.round("r", 9).alias("r"))


@query("w2_grouped_percent_rank", "select id1, id2, round((rank() over (partition by category, target order by score) + (count(*) over (partition by category, target, score) - 1) / 2.0::double) / count(*) over (partition by category, target), 9) as r from predictions")
def grouped_rank(spark, d):
    return rk.percent_rank_average(v.predictions(spark, d), "score", ["category", "target"], "r").select("id1", "id2", F.round("r", 9).alias("r"))


@query("w3_equal_frequency_bands", """select id1, id2, (n > q1)::int + (n > q2)::int + (n > q3)::int as band from (select *, row_number() over (order by score, id1, id2) as n from predictions),
  (select quantile_cont(n, 0.25) as q1, quantile_cont(n, 0.5) as q2, quantile_cont(n, 0.75) as q3 from (select row_number() over (order by score, id1, id2) as n from predictions))""")
def bands(spark, d):
    return rk.equal_frequency_bands(v.predictions(spark, d), ["score", "id1", "id2"], 4, "band").select("id1", "id2", "band")


@query("w4_w5_group_transforms", "select id1, id2, count(*) over (partition by category) as n, (select count(distinct target) from predictions q where q.id1 = p.id1) as labels from predictions p")
def transforms(spark, d):
    p = v.predictions(spark, d)
    n = p.groupBy("category").agg(_n().alias("n"))
    labels = p.groupBy("id1").agg(F.count_distinct("target").alias("labels"))
    return p.join(F.broadcast(n), "category").join(labels, "id1").select("id1", "id2", "n", "labels")


@query("w11_top_budget", "select id1, id2, (row_number() over (order by abs(score - 0.5), id1, id2) <= (select floor(count(*) * 0.4 + 1e-12) from predictions)) as routed from predictions")
def top_budget(spark, d):
    return rk.top_budget(v.predictions(spark, d), 0.4, [F.abs(F.col("score") - 0.5), "id1", "id2"]).select("id1", "id2", F.col("chosen").alias("routed"))


@query("w12_restricted_top", """select id1, id2 from (select id1, id2, row_number() over (order by score_b desc, id1, id2) as r from (
  select *, row_number() over (order by abs(score - 0.5), id1, id2) as q from predictions) where q <= (select floor(count(*) * 0.4 + 1e-12) from predictions)) where r <= (select floor(count(*) * 0.05 + 1e-12) from predictions)""")
def restricted(spark, d):
    p = v.predictions(spark, d)
    return rk.top_within(p, 0.4, [F.abs(F.col("score") - 0.5), "id1", "id2"], 0.05, [F.desc("score_b"), "id1", "id2"]).select("id1", "id2")


@query("w14_budget_by_category", "select id1, id2 from (select *, row_number() over (partition by category order by benefit desc, id1, id2) as r, count(*) over (partition by category) as n from (select *, abs(score - target) - abs(score_b - target) as benefit from predictions)) where r <= floor(n * 0.1 + 1e-12) and benefit > 0")
def budget(spark, d):
    p = v.predictions(spark, d).withColumn("benefit", F.abs(F.col("score") - F.col("target")) - F.abs(F.col("score_b") - F.col("target")))
    chosen = rk.top_budget(p, 0.1, [F.desc("benefit"), "id1", "id2"], ["category"])
    return chosen.filter("chosen and benefit > 0").select("id1", "id2")


@query("w15_head_per_group", "select category, id1, id2 from (select *, row_number() over (partition by category order by score desc, id1, id2) as r from predictions) where r <= 5")
def heads(spark, d):
    return rk.head(v.predictions(spark, d), ["category"], [F.desc("score"), "id1", "id2"], 5).select("category", "id1", "id2")


@query("w16_w20_hash_quota", "select category, id from (select category, id, row_number() over (partition by category order by md5(cast(id as varchar)), id) as r from items) where r <= 20")
def hash_quota(spark, d):
    return rk.head(v.items(spark, d), ["category"], [F.md5(F.col("id").cast("string").cast("binary")), "id"], 20).select("category", "id")


@query("w17_argmax", "select category, id1, id2, score from (select *, row_number() over (partition by category order by score desc, id1, id2) as r from predictions) where r = 1")
def argmax(spark, d):
    best = v.predictions(spark, d).groupBy("category").agg(F.min(F.struct((-F.col("score")).alias("s"), "id1", "id2")).alias("b"))
    return best.select("category", "b.id1", "b.id2", (-F.col("b.s")).alias("score"))


@query("w18_review_queue", """select id1, id2, string_agg(reason, ',' order by reason) as reasons from (
  select * from (select id1, id2, 'high negative' as reason from predictions where target = 0 order by score desc, id1, id2 limit 20) union all
  select * from (select id1, id2, 'low positive' from predictions where target = 1 order by score, id1, id2 limit 20) union all
  select * from (select id1, id2, 'disagreement' from predictions order by abs(score - score_b) desc, id1, id2 limit 20) union all
  select * from (select id1, id2, 'uncertain' from predictions order by abs(score - 0.5), id1, id2 limit 20)) group by id1, id2""")
def review(spark, d):
    p = v.predictions(spark, d)
    parts = [("high negative", p.filter("target = 0"), [F.desc("score")]), ("low positive", p.filter("target = 1"), ["score"]), ("disagreement", p, [F.desc(F.abs(F.col("score") - F.col("score_b")))]), ("uncertain", p, [F.abs(F.col("score") - 0.5)])]
    return rk.review_queue([(name, df, order + ["id1", "id2"]) for name, df, order in parts], 20)


@query("w19_confident_errors", "(select 'FP' as kind, id1, id2, score from predictions where target = 0 order by score desc, id1, id2 limit 10) union all (select 'FN', id1, id2, score from predictions where target = 1 order by score, id1, id2 limit 10)")
def errors(spark, d):
    p = v.predictions(spark, d)
    fp = p.filter("target = 0").orderBy(F.desc("score"), "id1", "id2").limit(10).select(F.lit("FP").alias("kind"), "id1", "id2", "score")
    fn = p.filter("target = 1").orderBy("score", "id1", "id2").limit(10).select(F.lit("FN").alias("kind"), "id1", "id2", "score")
    return fp.union(fn)


@query("w22_pareto", "select category, a, b from m x where not exists (select 1 from m y where y.a >= x.a and y.b >= x.b and (y.a > x.a or y.b > x.b))", "m as (select concat(category, ':', target) as category, round(avg(score), 6) as a, round(avg(1 - score_c), 6) as b from predictions group by 1)")
def pareto(spark, d):
    m = v.predictions(spark, d).groupBy(F.concat_ws(":", "category", "target").alias("category")).agg(F.round(F.avg("score"), 6).alias("a"), F.round(F.avg(1 - F.col("score_c")), 6).alias("b"))
    return rk.pareto(m, ["a", "b"])


@query("w27_min_coverage", "select t as tolerance, coalesce(cast(min(k) as varchar), 'not_reached') as coverage from (select unnest([0.5, 0.7, 1.1])::double as t) left join (select cast(round(score * 10) as bigint) as k, avg(target) as rate from predictions group by 1) on rate >= t group by t")
def min_coverage(spark, d):
    rates = v.predictions(spark, d).groupBy(F.round(F.col("score") * 10).cast("long").alias("k")).agg(F.avg("target").alias("rate"))
    grid = spark.createDataFrame([(0.5,), (0.7,), (1.1,)], "tolerance double")
    out = grid.join(rates, F.col("rate") >= F.col("tolerance"), "left").groupBy("tolerance").agg(F.min("k").alias("k"))
    return out.select("tolerance", F.coalesce(F.col("k").cast("string"), F.lit("not_reached")).alias("coverage"))
