"""Queries of data analyses: duplicates, splits, completeness, n-grams, values, nested JSON, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analysis as an, attributes as at, features as fe, pairs as pr, serialize as se, similarity as sim
from ..sources import views as v
from . import features as fp
from .base import query

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def _names(shares):
    return [f"p{int(q * 100):02d}" for q in shares]


ENDS = "ends as (select id, count(*) as degree, sum(target)::bigint as positives from (select unnest([id1, id2]) as id, target from matches) group by id)"


@query("a6_degree_quantiles", " union all ".join(f"select '{n}' as quantile, quantile_cont(degree, {q})::double as degree from ends" for n, q in zip(_names(SHARES), SHARES)) + " union all select 'mean', avg(degree) from ends", ENDS)
def a6(spark, d):
    return an.degree_quantiles(v.matches(spark, d), SHARES)


@query("a6_top_endpoints", "select e.id, degree, positives, name, category from (select * from ends order by degree desc, id limit 20) e left join items i on i.id = e.id", ENDS)
def a6_top(spark, d):
    return an.top_endpoints(v.matches(spark, d), v.items(spark, d), 20)


MESSY = "messy as (select id1, id2, target from matches union all select id2, id1, case when id1 % 12 = 0 then 1 - target else target end from matches where id1 % 6 = 0 union all select id1, id2, target from matches where id1 % 10 = 1 union all select id1, id1, 1 from matches where id1 % 40 = 2)"


def messy(spark, d):
    """Pairs with some reversed (a part of those with the other label), repeated, or paired with themselves."""
    m = v.matches(spark, d)
    turned = m.filter("id1 % 6 = 0").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.when(F.col("id1") % 12 == 0, 1 - F.col("target")).otherwise(F.col("target")).alias("target"))
    return m.unionAll(turned).unionAll(m.filter("id1 % 10 = 1")).unionAll(m.filter("id1 % 40 = 2").select("id1", F.col("id1").alias("id2"), F.lit(1).alias("target")))


@query("a11_duplicates_and_conflicts", """select * from (select count(*) filter (where n > 1) as exact_groups, sum(n - 1)::bigint as exact_extra_rows from (select count(*) as n from messy group by id1, id2)),
  (select count(*) filter (where n > 1) as unordered_groups, sum(n - 1)::bigint as unordered_extra_rows, count(*) filter (where o > 1) as reversed_groups, count(*) filter (where l > 1) as conflicting_groups from (select count(*) as n, count(distinct target) as l, count(distinct id1 <= id2) as o from messy group by least(id1, id2), greatest(id1, id2))),
  (select count(*) filter (where id1 = id2) as self_pairs from messy)""", MESSY)
def a11(spark, d):
    return an.duplicate_summary(messy(spark, d))


ASSIGNED = "assigned as (select id1, id2, category, target, case when category = 'PROMO' then 'ood' when id1 % 4 = 0 then 'valid' else 'train' end as split from predictions)"


def assigned(spark, d):
    split = F.when(F.col("category") == "PROMO", "ood").when(F.col("id1") % 4 == 0, "valid").otherwise("train")
    return v.predictions(spark, d).select("id1", "id2", "category", "target", split.alias("split"))


@query("a12_split_summary", """select s.split, s.pairs, s.positives, s.prevalence, p.unique_products, p.overlap_with_train, c.category_count, c.categories, c.absent_from_train from (select split, count(*) as pairs, sum(target)::bigint as positives, round(avg(target), 6) as prevalence from assigned group by split) s
  join (select e.split, count(*) as unique_products, count(t.id) as overlap_with_train from ends e left join (select id from ends where split = 'train') t on t.id = e.id group by e.split) p using (split)
  join (select split, count(*) as category_count, string_agg(category, '; ' order by category) as categories, coalesce(string_agg(category, '; ' order by category) filter (where category not in (select category from assigned where split = 'train')), '') as absent_from_train from (select distinct split, category from assigned) group by split) c using (split)""",
  f"{ASSIGNED}, ends as (select distinct split, unnest([id1, id2]) as id from assigned)")
def a12(spark, d):
    return an.split_summary(assigned(spark, d)).withColumn("prevalence", F.round("prevalence", 6))


@query("a13_multiset_equality", "select (select count(*) from (select id1, id2 from matches except all select id1, id2 from got)) as lost, (select count(*) from (select id1, id2 from got except all select id1, id2 from matches)) as added", "got as (select id1, id2 from matches where id1 % 50 <> 1 union all select id1, id2 from matches where id1 % 60 = 2)")
def a13(spark, d):
    """Against splits that lose some pairs and hold others twice."""
    m = v.matches(spark, d).select("id1", "id2")
    return an.multiset_difference(m, m.filter("id1 % 50 <> 1").unionAll(m.filter("id1 % 60 = 2")))


FULL = """words0 as (select id, category, length(name) as title_chars, length(attributes) as attributes_chars, lower(name) as low, case when id % 97 = 5 or id % 11 = 3 then [] else list_filter(list_transform(['brand', 'type', 'size', 'price', 'color'], lambda k: lower(json_extract_string(case when id % 97 = 5 then '{}' else attributes end, concat('$.', k)))), lambda x: x is not null) end as vals from items),
words as (select *, trim(regexp_replace(low, '[^0-9a-z]+', ' ', 'g')) as title, list_transform(vals, lambda x: trim(regexp_replace(x, '[^0-9a-z]+', ' ', 'g'))) as clean from words0),
toks as (select *, list_distinct(regexp_extract_all(title, '[0-9a-z]+')) as tokens, list_distinct(regexp_extract_all(array_to_string(clean, ' '), '[0-9a-z]+')) as value_tokens from words),
fullness as (select id, category, len(vals) as attribute_count, title_chars, attributes_chars, length(array_to_string(clean, '')) as value_chars, len(tokens) as title_tokens, len(list_filter(tokens, lambda t: not list_contains(value_tokens, t))) as title_only_tokens,
  len(list_filter(tokens, lambda t: not list_contains(value_tokens, t))) / len(tokens)::double as title_only_share, len(list_filter(tokens, lambda t: length(t) >= 3 and regexp_matches(t, '[0-9]'))) as title_identifiers,
  len(list_filter(tokens, lambda t: length(t) >= 3 and regexp_matches(t, '[0-9]') and not list_contains(value_tokens, t))) as title_only_identifiers, len(list_filter(clean, lambda x: contains(concat(' ', title, ' '), concat(' ', x, ' ')))) as values_in_title from toks)"""
METRICS = ["attribute_count", "title_chars", "attributes_chars", "value_chars", "title_tokens", "title_only_tokens", "title_only_share", "title_identifiers", "title_only_identifiers", "values_in_title"]


@query("a14_completeness_quantiles", " union all ".join(f"select '{m}' as metric, unnest([{', '.join(repr(n) for n in _names(SHARES))}, 'mean']) as quantile, round(unnest(list_append(quantile_cont({m}, [{', '.join(map(str, SHARES))}])::double[], avg({m}))), 6) as value from fullness" for m in METRICS), FULL)
def a14(spark, d):
    return an.quantile_table(an.completeness(v.items(spark, d)), METRICS, SHARES).withColumn("value", F.round("value", 6))


@query("a14_completeness_by_category", "select category, count(*) as products, round(avg(attribute_count), 6) as mean_attributes, quantile_cont(attribute_count, 0.5)::double as median_attributes, round(avg(title_only_share), 6) as mean_title_only_share, count(*) filter (where title_only_identifiers > 0) as with_title_only_identifier, count(*) filter (where values_in_title > 0) as with_value_in_title from fullness group by category", FULL)
def a14_by(spark, d):
    c = an.completeness(v.items(spark, d))
    return c.groupBy("category").agg(
        F.count(F.lit(1)).alias("products"), F.round(F.avg("attribute_count"), 6).alias("mean_attributes"), F.percentile("attribute_count", 0.5).alias("median_attributes"), F.round(F.avg("title_only_share"), 6).alias("mean_title_only_share"),
        F.count_if(F.col("title_only_identifiers") > 0).alias("with_title_only_identifier"), F.count_if(F.col("values_in_title") > 0).alias("with_value_in_title"),
    )


SIG = f"{ASSIGNED}, sig as (select id, concat(category, '|', lower(split_part(name, ' ', 1))) as s from items), se as (select e.split, g.s from (select distinct split, unnest([id1, id2]) as id from assigned) e join sig g on g.id = e.id), sc as (select split, s, count(*) as n from se group by 1, 2), ps as (select a.split, a.target, least(x.s, y.s) as a, greatest(x.s, y.s) as b from assigned a join sig x on x.id = a.id1 join sig y on y.id = a.id2), tl as (select a, b, min(target) as lo, max(target) as hi from ps where split = 'train' group by 1, 2)"


@query("a19_content_signatures", """select c.*, coalesce(k.same_label, 0) as same_label, coalesce(k.conflicting_label, 0) as conflicting_label, coalesce(k.mixed_label, 0) as mixed_label from (
  select c.split, count(*) as signatures, count(*) filter (where n > 1) as repeated, coalesce(sum(n) filter (where n > 1), 0)::bigint as items_in_repeated, count(t.s) as seen_in_train, coalesce(sum(n) filter (where t.s is not null), 0)::bigint as items_seen_in_train from sc c left join (select s from sc where split = 'train') t on t.s = c.s group by c.split) c
  left join (select split, count(*) filter (where lo = hi and target = lo) as same_label, count(*) filter (where lo = hi and target <> lo) as conflicting_label, count(*) filter (where lo <> hi) as mixed_label from ps join tl using (a, b) where split <> 'train' group by split) k using (split)""", SIG)
def a19(spark, d):
    """Signatures of category and first word, so that splits share some."""
    signed = v.items(spark, d).select("id", F.concat_ws("|", "category", F.lower(F.substring_index("name", " ", 1))).alias("signature"))
    return an.signature_overlap(assigned(spark, d), signed)


@query("a20_named_aggregates", "select category, count(*) filter (where score > 0.5) as high, (select string_agg(id, ',' order by id::bigint) from (select distinct id1::varchar as id from predictions q where q.category = p.category order by id::bigint limit 3)) as examples from predictions p group by category")
def a20(spark, d):
    p = v.predictions(spark, d)
    firsts = an.first_examples(p.select("category", "id1").distinct(), ["category"], "id1", ["id1"])
    return p.groupBy("category").agg(F.count_if(F.col("score") > 0.5).alias("high")).join(firsts, "category")


KEYED = "pairkeys as (select p.category, p.target, k, lower(json_extract_string(x.attributes, concat('$.', k))) as a, lower(json_extract_string(y.attributes, concat('$.', k))) as b from predictions p join items x on x.id = p.id1 join items y on y.id = p.id2, (select unnest(['brand', 'type', 'size', 'price', 'color']) as k) where x.id % 97 <> 5 and y.id % 97 <> 5)"


@query("a23_variant_keys", """select category, key, conflict_0, conflict_1, equal_0, equal_1, conflicts, round(conflict_0 / conflicts::double, 6) as negative_rate, round((conflict_0 + 5 * rate) / (conflicts + 5), 6) as smoothed, round((conflict_0 + 5 * rate) / (conflicts + 5) - rate, 6) as lift, conflicts >= 3 and conflict_0 / conflicts::double >= 0.6 as candidate from (
  select category, k as key, count(*) filter (where a <> b and target = 0) as conflict_0, count(*) filter (where a <> b and target = 1) as conflict_1, count(*) filter (where a = b and target = 0) as equal_0, count(*) filter (where a = b and target = 1) as equal_1, count(*) filter (where a <> b) as conflicts from pairkeys where a is not null and b is not null group by 1, 2)
  join (select category, 1 - avg(target) as rate from predictions group by category) using (category) where conflicts > 0""", KEYED)
def a23(spark, d):
    bags = v.items(spark, d).select("id", at.parse_folded(F.col("attributes")).alias("bag"))
    out = an.variant_keys(pr.hydrate(v.predictions(spark, d), bags, ("bag",)))
    return out.select("category", "key", "conflict_0", "conflict_1", "equal_0", "equal_1", "conflicts", *(F.round(c, 6).alias(c) for c in ("negative_rate", "smoothed", "lift")), "candidate")


GRAMS = """gw as (select id, regexp_extract_all(lower(name), '[0-9a-z]+') as w from items),
gi as (select id, list_distinct(flatten([list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' ')) for n in [1, 2, 3]])) as grams, list_distinct(flatten([list_transform(range(1, length(array_to_string(w, '')) - n + 2), lambda i: substr(array_to_string(w, ''), i, n)) for n in [3, 4, 5]])) as chars from gw)"""
_COMMON = """select '{k}' as kind, pattern, count(*) as support, count(*) filter (where target = 0) as negatives, count(*) filter (where target = 0 and score >= 0.5) as false_positives, count(*) filter (where target = 1) as positives, count(*) filter (where target = 1 and score < 0.5) as false_negatives,
  round(count(*) filter (where target = 0 and score >= 0.5) / nullif(count(*) filter (where target = 0), 0)::double, 6) as fpr, round(count(*) filter (where target = 1 and score < 0.5) / nullif(count(*) filter (where target = 1), 0)::double, 6) as fnr from (
  select target, score, unnest(list_intersect(a.{c}, b.{c})) as pattern from predictions p join gi a on a.id = p.id1 join gi b on b.id = p.id2) group by pattern having count(*) >= 5"""


@query("a29_common_ngram_errors", _COMMON.format(k="word", c="grams") + " union all " + _COMMON.format(k="char", c="chars"), GRAMS)
def a29(spark, d):
    """Word runs of one to three and character runs of three to five; all that a pair shares count."""
    words = tx.tokens(F.col("name"))
    plain = F.regexp_extract_all(F.lower("name"), F.lit("([0-9a-z]+)"), 1)
    items = pr.spread(v.items(spark, d)).select("id", F.array_distinct(tx.word_ngrams(plain, 1, 3)).alias("grams"), F.array_distinct(tx.char_ngrams(F.array_join(plain, " "), 3, 5)).alias("chars"))
    p = pr.hydrate(v.predictions(spark, d), items, ("grams", "chars"))
    parts = [an.common_gram_errors(p, F.col(f"{c}_1"), F.col(f"{c}_2"), 5).select(F.lit(k).alias("kind"), "*") for k, c in (("word", "grams"), ("char", "chars"))]
    out = parts[0].unionByName(parts[1])
    return out.withColumn("fpr", F.round("fpr", 6)).withColumn("fnr", F.round("fnr", 6))


LIFT = """tg as (select p.target, ((score >= 0.5)::int <> target) as wrong, case when target = 1 then 'fn' else 'fp' end as error_type, regexp_extract_all(lower(concat(a.name, ' ', b.name)), '[0-9a-z]+') as w from predictions p join items a on a.id = p.id1 join items b on b.id = p.id2),
lg as (select error_type, wrong, unnest(list_distinct(flatten([list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' ')) for n in [3, 4, 5]]))) as gram from tg), lb as (select error_type, avg(wrong::int) as base from tg group by 1)"""


@query("a30_ngram_error_lift", "select g.error_type, gram, count(*) as support, sum(wrong::int)::bigint as errors, round(avg(wrong::int), 6) as error_rate, round(avg(wrong::int) / greatest(max(base), 1e-12), 6) as error_lift from lg g join lb on lb.error_type = g.error_type group by 1, 2 having count(*) >= 3", LIFT)
def a30(spark, d):
    p = pr.hydrate(v.predictions(spark, d), v.items(spark, d), ("name",))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "name_1", "name_2")), F.lit("([0-9a-z]+)"), 1)
    out = an.gram_error_lift(p, tx.word_ngrams(words, 3, 5), 3)
    return out.select("error_type", "gram", "support", "errors", F.round("error_rate", 6).alias("error_rate"), F.round("error_lift", 6).alias("error_lift"))


ERR = "err as (select id1, id2, case when score >= 0.5 and target = 0 then 'FALSE_POSITIVE' when score < 0.5 and target = 1 then 'FALSE_NEGATIVE' else 'CORRECT_BUT_HARD' end as error_type from predictions where (score >= 0.5)::int <> target or abs(score - 0.5) < 0.2)"


def _occurrences():
    from . import evaluation as ev

    return ev


@query("a35_rule_curriculum", "select rule, count(*) as targeted_pairs, count(*) filter (where error_type = 'FALSE_POSITIVE') as false_positive, count(*) filter (where error_type = 'FALSE_NEGATIVE') as false_negative, count(*) filter (where error_type = 'CORRECT_BUT_HARD') as correct_but_hard from (select distinct id1, id2, rule from occ) o join err using (id1, id2) group by rule", f"{_occurrences().OCC}, {ERR}")
def a35(spark, d):
    p = v.predictions(spark, d)
    wrong = (F.col("score") >= 0.5).cast("int") != F.col("target")
    kind = F.when(wrong & (F.col("target") == 0), "FALSE_POSITIVE").when(wrong, "FALSE_NEGATIVE").otherwise("CORRECT_BUT_HARD")
    errors = p.filter(wrong | (F.abs(F.col("score") - 0.5) < 0.2)).select("id1", "id2", kind.alias("error_type"))
    return an.rule_curriculum(_occurrences().occurrences(spark, d), errors)


@query("a38_complexity_and_usage", "select * from (select count(*) as unique_ids, sum(n)::bigint as uses, min(n) as least, max(n) as most, round(avg(n), 6) as mean, round(max(n) / min(n)::double, 6) as ratio, round(stddev_pop(n) / avg(n), 6) as variation from (select brand, count(*) as n from (select json_extract_string(case when id % 97 = 5 then '{}' else attributes end, '$.brand') as brand from items) where brand is not null group by brand)), (select quantile_cont(len(regexp_extract_all(name, '[0-9A-Za-z]+')), 0.9)::double as words_p90, round(avg(length(name)), 6) as mean_chars, count(*) filter (where id % 97 = 5) as unparsed from items)")
def a38(spark, d):
    items = v.items(spark, d)
    brand = items.select(F.try_element_at(at.parse(F.col("attributes")), F.lit("brand")).alias("brand"))
    use = an.usage(brand, "brand").select("unique_ids", "uses", "least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "ratio", "variation")))
    words = F.size(F.regexp_extract_all("name", F.lit("([0-9A-Za-z]+)"), 1))
    size = items.agg(F.percentile(words, 0.9).alias("words_p90"), F.round(F.avg(F.length("name")), 6).alias("mean_chars"), F.count_if(at.parse(F.col("attributes")).isNull()).alias("unparsed"))
    return use.join(size)


@query("a40_normalisation_impact", "select count(distinct key) as concepts_before, count(distinct coalesce(t, key)) as concepts_after, count(*) filter (where coalesce(t, key) <> key) as facts_affected, (select count(*) from (select distinct id, key from kf)) as pair_rules_before, (select count(*) from (select distinct id, coalesce(t, key) from kf)) as pair_rules_after, (select count(*) from (select distinct id, key from kf)) - (select count(*) from (select distinct id, coalesce(t, key) from kf)) as collapsed from kf",
       "kf as (select id, k as key, case k when 'price' then 'size' when 'color' then 'shade' end as t from items, (select unnest(['brand', 'type', 'size', 'price', 'color']) as k) where id % 97 <> 5 and json_extract_string(attributes, concat('$.', k)) is not null)")
def a40(spark, d):
    facts = at.entries(v.items(spark, d), "id").select(F.col("id").alias("pair_id"), F.col("key").alias("concept"), F.lit("same").alias("relation"))
    return an.normalisation_impact(facts, spark.createDataFrame([("price", "size"), ("color", "shade")], "source string, target string"))


VALUES = "vr as (select id, category, json_extract_string(attributes, '$.brand') as kind, k as key, json_extract_string(attributes, concat('$.', k)) as value from items, (select unnest(['size', 'color']) as k) where id % 97 <> 5 and json_extract_string(attributes, concat('$.', k)) is not null)"


@query("a43_value_support", "select c.id1, c.id2, c.key, coalesce(a.n, 0) as category_old, coalesce(b.n, 0) as category_new, coalesce(e.n, 0) as typed_old, coalesce(f.n, 0) as typed_new from (select m.id1, m.id2, x.category, x.kind, x.key, x.value as old, y.value as new from matches m join vr x on x.id = m.id1 join vr y on y.id = m.id2 and y.key = x.key where x.value <> y.value) c left join (select category, key, value, count(*) as n from vr group by 1, 2, 3) a on a.category = c.category and a.key = c.key and a.value = c.old left join (select category, key, value, count(*) as n from vr group by 1, 2, 3) b on b.category = c.category and b.key = c.key and b.value = c.new left join (select category, kind, key, value, count(*) as n from vr group by 1, 2, 3, 4) e on e.category = c.category and e.kind = c.kind and e.key = c.key and e.value = c.old left join (select category, kind, key, value, count(*) as n from vr group by 1, 2, 3, 4) f on f.category = c.category and f.kind = c.kind and f.key = c.key and f.value = c.new", VALUES)
def a43(spark, d):
    """Support of both values of each differing size and color, in the category and in the category with the brand."""
    bag = at.parse(F.col("attributes"))
    rows = v.items(spark, d).select("id", "category", F.try_element_at(bag, F.lit("brand")).alias("kind"), F.explode(bag).alias("key", "value")).filter(F.col("key").isin("size", "color"))
    left = rows.withColumnsRenamed({"id": "id1", "value": "old"})
    right = rows.select(F.col("id").alias("id2"), "key", F.col("value").alias("new"))
    moved = v.matches(spark, d).select("id1", "id2").join(left, "id1").join(right, ["id2", "key"]).filter("old <> new")
    out = an.transition_support(moved, rows, {"category": ["category"], "typed": ["category", "kind"]})
    return out.select("id1", "id2", "key", "category_old", "category_new", "typed_old", "typed_new")


@query("n13_structure_similarity", "select m.id1, m.id2, round(exp(-(" + " + ".join(f"abs(x.{c} - y.{c}) / (select coalesce(nullif(stddev_pop({c}), 0), 1) from fullness)" for c in ("attribute_count", "title_chars", "title_tokens", "title_only_share")) + ") / 4), 6) as similarity from matches m join fullness x on x.id = m.id1 join fullness y on y.id = m.id2", FULL)
def n13(spark, d):
    measures = ["attribute_count", "title_chars", "title_tokens", "title_only_share"]
    out = an.structure_similarity(v.matches(spark, d).select("id1", "id2"), an.completeness(v.items(spark, d)).select("id", *measures), measures)
    return out.select("id1", "id2", F.round("similarity", 6).alias("similarity"))


KINDS = ["source_exact_transition", "source_endpoint_values", "human_scope_attribute_values", "human_category_attribute_values", "other"]


@query("n24_quality_score", f"""select id1, id2, round(least(1, greatest(0, 0.34 * (0.40 * least(1, greatest(0, (score_b - 0.70) / 0.30)) + 0.25 * least(1, ln(1 + id1 % 30) / ln(21)) + 0.20 * least(1, (id2 % 10) / greatest(1, id1 % 30)::double) + 0.15 * case id1 % 3 when 0 then 1.0 when 1 then 0.0 else 0.35 end)
  + 0.27 * list_extract([1.0, 0.9, 0.82, 0.62, 0.0], (id1 % 5 + 1)::int) + 0.16 * (0.60 * least(1, greatest(0, (id2 % 9 - 3) / 5.0)) + 0.40 * least(1, greatest(0, 1 - abs(score_c - 0.80) / 0.25))) + 0.18 * exp(-abs(ln(greatest(score, 1e-8)) - ln(0.05)) / 2) + 0.05 * case when target = 1 then 1 else 0.55 end)), 6) as quality from predictions""")
def n24(spark, d):
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (c("id1") % 5 + 1).cast("int"))
    given = {
        "probability": c("score_b"), "support": (c("id1") % 30).cast("double"), "singletons": (c("id2") % 10).cast("double"), "cross_split": F.when(c("id1") % 3 == 0, True).when(c("id1") % 3 == 1, False), "evidence": kind,
        "title_tokens": (c("id2") % 9).cast("double"), "name_similarity": c("score_c"), "baseline": c("score"), "brand_context": c("target") == 1,
    }
    return v.predictions(spark, d).select("id1", "id2", F.round(an.quality_score(given), 6).alias("quality"))


CANON = [
    ("gold_color", "", "Белое золото", "белое"), ("gold_color", "", "yellow / red", "комбинированное"), ("gold_color", "", "Розовое", "красное"), ("gold_color", "", "двухцветное", "комбинированное"), ("gold_color", "", "Green", "green"),
    ("storage_capacity", "смартфон", "1 ТБ", "1024 ГБ"), ("storage_capacity", "смартфон", "256gb", "256 ГБ"), ("storage_capacity", "ноутбук", "256gb", "256gb"), ("package_quantity", "", "012 шт.", "12 шт"), ("package_quantity", "", "7", "7 шт"), ("package_quantity", "", "a few", None),
    ("length", "", "1,5 м", "1500 мм"), ("width", "", "2.54 см", "25.4 мм"), ("diameter", "", '10"', "254 мм"), ("diameter", "", ".5 inch", "12.7 мм"), ("wheel_diameter", "", "29 дюймов", "736.6 мм"), ("length", "", "30 мм", "30 мм"), ("length", "", "long", None),
    ("size", "смычок", "Размер: 3⁄4", "3/4"), ("size", "смычок", "½", "1/2"), ("size", "платье", " 42  RU", "42 ru"), ("other", "", "  A  b ", "a b"), ("other", "", "", None),
]


@query("n3_canonical_values", "select * from (values " + ", ".join("(" + ", ".join("null" if x is None else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in CANON) + ") as t(concept, product, raw, value)")
def n3(spark, d):
    rows = spark.createDataFrame([r[:3] for r in CANON], "concept string, product string, raw string")
    return rows.select("concept", "product", "raw", an.canonical_value(F.col("concept"), F.col("product"), F.col("raw")).alias("value"))


@query("n4_domain_sizes", "select concept, count(distinct value) as domain from (values " + ", ".join("(" + ", ".join("null" if x is None else "'" + x + "'" for x in (r[0], r[3])) + ")" for r in CANON) + ") as t(concept, value) group by concept")
def n4(spark, d):
    return n3(spark, d).groupBy("concept").agg(F.count_distinct("value").alias("domain"))


# cards


def cards(spark, d):
    bag = F.coalesce(at.parse(F.col("attributes")), F.create_map().cast("map<string,string>"))
    return v.items(spark, d).select("id", "name", "category", bag.alias("bag")).withColumn("card", se.card(F.col("category"), F.col("name"), F.col("bag"), ["brand", "size"]))


CARDS = """kv as (select id, category, name, list_filter(list_transform(['brand', 'size', 'color', 'price', 'type'], lambda k: {'k': k, 'v': json_extract_string(case when id % 97 = 5 then '{}' else attributes end, concat('$.', k))}), lambda x: x.v is not null) as kvs from items),
cards as (select *, concat('Категория: ', category, chr(10), 'Название: ', name, chr(10), array_to_string(list_transform(kvs, lambda x: concat(x.k, ': ', x.v)), chr(10))) as card from kv)"""


@query("t15_title_line", "select id, name as title from items")
def t15(spark, d):
    return cards(spark, d).select("id", se.title_line(F.regexp_replace("card", "Название: ", "  НАЗВАНИЕ :  ")).alias("title"))


@query("t16_fields_and_exchange", "select id, len(kvs) as fields, case when len(list_filter(kvs, lambda x: x.k = 'size')) > 0 then replace(replace(card, concat('size: ', list_filter(kvs, lambda x: x.k = 'size')[1].v), 'size: 99 [x] $1'), name, replace(name, list_filter(kvs, lambda x: x.k = 'size')[1].v, '99 [x] $1')) end as changed from cards", CARDS)
def t16(spark, d):
    c = cards(spark, d).withColumn("parsed", se.fields(F.col("card")))
    old = F.coalesce(F.try_element_at("parsed", F.lit("size")), F.lit("?"))
    return c.select("id", F.size("parsed").alias("fields"), se.exchange(F.col("card"), F.lit("size"), old, F.lit("99 [x] $1")).alias("changed"))


@query("t18_cut_cards", "select id, case when length(card) <= 100 then card else concat(array_to_string(list_filter(list_transform(range(1, len(string_split(card, chr(10))) + 1), lambda i: case when i = 1 or length(array_to_string(list_slice(string_split(card, chr(10)), 1, i), chr(10))) <= 76 then string_split(card, chr(10))[i] end), lambda x: x is not null), chr(10)), chr(10), 'Характеристики обрезаны') end as text from cards", CARDS)
def t18(spark, d):
    return cards(spark, d).select("id", se.cut_lines(F.col("card"), 100).alias("text"))


@query("t19_rich_cards", "select id, concat('Название: ', name, chr(10), array_to_string(list_transform(list_sort(list_transform(kvs, lambda x: {'r': case x.k when 'brand' then 1 when 'color' then 5 else 50 end, 'k': x.k, 'v': x.v})), lambda x: concat(x.k, ': ', x.v)), chr(10))) as text from kv", CARDS)
def t19(spark, d):
    with_seller = F.map_concat("bag", F.create_map(F.lit("seller"), F.lit("someone")))
    return cards(spark, d).select("id", se.rich_card(F.col("name"), with_seller).alias("text"))


@query("t2_compatibility_fold", "select id, concat(lower(name), ' - 5 kg 2 sser fi') as text from items")
def t2(spark, d):
    raw = F.concat("name", F.lit("  -\t５ ㎏ ² ẞer ﬁ "))
    return v.items(spark, d).select("id", se.compatibility_fold(raw).alias("text"))


@query("t26_phrases", "select doc_id, len(regexp_extract_all(lower(text), '(?:^|[^0-9a-z_])the\\b')) as times, regexp_matches(lower(text), '(?:^|[^0-9a-z_])and\\b') as has_and from (select doc_id, regexp_replace(text, '[^ -~]', '.', 'g') as text from documents where text is not null)")
def t26(spark, d):
    """Whole-word occurrences, in texts without letters beyond ASCII."""
    docs = v.read(spark, d, "documents", "doc_id", "text").filter("text is not null")
    text = F.regexp_replace("text", "[^ -~]", ".")
    return docs.select("doc_id", an.phrase_count(text, "the").alias("times"), (an.phrase_count(text, "And") > 0).alias("has_and"))


@query("t14_identifier_tokens", "select id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(concat(title, ' ', array_to_string(list_concat(case when kind > 0 then brand else [] end, model), ' ')), '[0-9a-z]+'), lambda t: length(t) >= 3 and regexp_matches(t, '[0-9]')))), ',') as identifiers from bags", fp.RICH)
def t14(spark, d):
    bag = at.multi_bag(F.col("attributes"))
    keyed = F.flatten(F.map_values(F.map_filter(bag, lambda k, _: k.rlike("brand|model|sku|артикул"))))
    whole = F.concat_ws(" ", tx.fold(F.col("name")), F.array_join(keyed, " "))
    tokens = F.filter(tx.tokens(whole), lambda t: (F.length(t) >= 3) & t.rlike("[0-9]"))
    return fp.rich_items(spark, d).select("id", F.array_join(F.array_sort(tokens), ",").alias("identifiers"))


# nested JSON and joins


def facts(spark, d):
    """Facts kept as JSON: two sides, each with a list of evidence."""
    entry = lambda s, n: F.struct(F.lit(s).alias("source"), n.alias("raw_attribute_name"))
    rows = at.entries(v.items(spark, d), "id").select("id", F.col("key").alias("concept"), "value")
    one = F.struct(F.array(entry("attribute", F.col("concept")), entry("title", F.col("value"))).alias("evidence"))
    two = F.struct(F.when(F.col("id") % 2 == 0, F.array(entry("attribute", F.upper("concept")))).alias("evidence"))
    return rows.select("id", "concept", F.to_json(F.struct(one.alias("a"), two.alias("b"))).alias("fact"))


@query("b15_evidence_rows", "select id, concept, side, source, name from (select id, key as concept, 'a' as side, unnest(['attribute', 'title']) as source, unnest([key, value]) as name from kr union all select id, key, 'b', 'attribute', upper(key) from kr where id % 2 = 0)",
       "kr as (select id, k as key, trim(json_extract_string(attributes, concat('$.', k))) as value from items, (select unnest(['brand', 'type', 'size', 'price', 'color']) as k) where id % 97 <> 5 and json_extract_string(attributes, concat('$.', k)) is not null)")
def b15(spark, d):
    return an.evidence_rows(facts(spark, d), "fact")


@query("b17_json_arrays", "select category, concat('[', string_agg(concat('{\"id\":', id, ',\"name\":\"', name, '\"}'), ',' order by id), ']') as encoded, count(*) as decoded from items where id % 20 = 1 group by category")
def b17(spark, d):
    """Rows of a group as one JSON array, and how many come back out of it."""
    rows = v.items(spark, d).filter("id % 20 = 1").groupBy("category").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "name")))).alias("encoded"))
    return rows.withColumn("decoded", F.size(F.from_json("encoded", "array<struct<id:bigint,name:string>>")).cast("long"))


@query("b18_nested_keys", "select id, case when id % 97 = 5 then '' else concat_ws(',', 'card', 'name', 'list', 'deep', 'x', 'deep', 'x') end as keys, id % 3 = 0 as absent from items")
def b18(spark, d):
    nested = F.to_json(F.struct(F.struct("name", F.array(F.struct(F.struct(F.lit(1).alias("x")).alias("deep")), F.struct(F.struct(F.lit(2).alias("x")).alias("deep"))).alias("list")).alias("card")))
    rows = v.items(spark, d).withColumn("nested", F.when(F.col("id") % 97 == 5, "not json").otherwise(nested))
    said = F.when(F.col("id") % 3 == 0, F.element_at(F.array(*map(F.lit, ["Нет данных", "уточните у продавца", "N/A"])), (F.col("id") % 2 + 1).cast("int"))).otherwise("red")
    return rows.select("id", F.array_join(an.nested_keys(F.col("nested")), ",").alias("keys"), an.absent(said).alias("absent"))


@query("j5_one_to_one_merge", "select m.id1, m.id2, m.target, p.score from matches m left join predictions p on p.id1 = m.id1 and p.id2 = m.id2 and p.target = m.target and p.id1 % 7 <> 0")
def j5(spark, d):
    """Fails where either side repeats a key."""
    scores = v.predictions(spark, d).filter("id1 % 7 <> 0").select("id1", "id2", "target", "score")
    return an.one_to_one(v.matches(spark, d), scores, ["id1", "id2", "target"])


@query("j11_outer_summary", "select coalesce(i.category, p.category) as category, i.items, p.pairs from (select category, count(*) as items from items where category <> 'SMALL' group by 1) i full join (select category, count(*) as pairs from predictions where category <> 'LARGE' group by 1) p on p.category = i.category")
def j11(spark, d):
    """Categories of either side, with what the other lacks left null."""
    items = v.items(spark, d).filter("category <> 'SMALL'").groupBy("category").agg(F.count(F.lit(1)).alias("items"))
    pairs = v.predictions(spark, d).filter("category <> 'LARGE'").groupBy("category").agg(F.count(F.lit(1)).alias("pairs"))
    return items.join(pairs, "category", "full").select("category", "items", "pairs")


_BAD = " or ".join(fp.disjoint(f"a.{f}_values", f"b.{f}_values") for f in fe.FAMILIES)
AUDITED = f"""{fp.RICH}, {fp.CHEAP}, {MESSY}, cd as (select id, concat(category, '|', title, '|', kind, '|', id % 97 = 5, '|', array_to_string(flat, ';')) as card from bags),
flagged as (select m.*, least(m.id1, m.id2) as lo, greatest(m.id1, m.id2) as hi, least(x.card, y.card) as clo, greatest(x.card, y.card) as chi, a.title = b.title as same_title, x.card = y.card as same_card, ({fp._CONTEXT}) > 0 as numeric_conflict, {fp.disjoint('a.skus', 'b.skus')} as code_conflict, {_BAD} as critical, {fp._jaccard('a.tokens', 'b.tokens', '0.0')} as alike
  from messy m join cheap a on a.id = m.id1 join cheap b on b.id = m.id2 join cd x on x.id = m.id1 join cd y on y.id = m.id2),
told as (select *, min(target) over (partition by lo, hi) <> max(target) over (partition by lo, hi) or min(target) over (partition by clo, chi) <> max(target) over (partition by clo, chi) as conflicting from flagged)"""


@query("p9_audit_buckets", "select case when conflicting then 'conflicting' when (target = 0 and (same_title or same_card)) or (target = 1 and (numeric_conflict or code_conflict or critical)) then 'suspicious' else 'clean' end as bucket, count(*) as n, count(*) filter (where target = 0 and (same_title or same_card)) as suspicious_negatives, count(*) filter (where target = 1 and (numeric_conflict or code_conflict or critical)) as suspicious_positives, count(*) filter (where target = 0 and alike >= 0.5) as very_alike_negatives, count(*) filter (where target = 1 and alike <= 0.3) as very_unlike_positives from told group by 1", AUDITED)
def p9(spark, d):
    out = fe.label_audit(messy(spark, d), fp.rich_items(spark, d), 0.5, 0.3)
    count = lambda c: F.count_if(F.col(c))
    return out.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), count("suspicious_negative_identity").alias("suspicious_negatives"), count("suspicious_positive_conflict").alias("suspicious_positives"), count("very_alike_negative").alias("very_alike_negatives"), count("very_unlike_positive").alias("very_unlike_positives"))
