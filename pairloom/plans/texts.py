"""Queries of text, set, unit and similarity functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm, text as tx, units
from ..operators import attributes as at, pairs as pr, similarity as sim
from ..sources import views as v
from .base import query


def docs(spark, d):
    return v.read(spark, d, "documents", "doc_id", "text")


@query("t5_t7_whitespace_folding", "select doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) as clean, md5(translate(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 'ё', 'е')) as folded from documents")
def folding(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.squeeze(F.col("text")).cast("binary")).alias("clean"), F.md5(tx.fold(F.col("text")).cast("binary")).alias("folded"))


@query("t6_words_only", "select id, trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')) as name, trim(regexp_replace(lower(attributes), '[^a-z0-9_]+', ' ', 'g')) as attributes from items")
def words_only(spark, d):
    return pr.prepare_items(v.items(spark, d)).select("id", "name", "attributes")


@query("t1_alnum_only", "select item_id, trim(regexp_replace(lower(text), '[^0-9a-zа-я]+', ' ', 'g')) as text from benchmark")
def alnum(spark, d):
    return v.read(spark, d, "benchmark").select("item_id", tx.alnum_only(F.col("text")).alias("text"))


@query("t4_letter_digit_split", "select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g')) as name from items")
def boundary(spark, d):
    return v.items(spark, d).select("id", tx.split_boundaries(F.col("name")).alias("name"))


@query("t8_decimal_tokens", "select item_id, array_to_string(regexp_extract_all(replace(lower(text), ',', '.'), '[0-9a-zа-я.]+'), ' ') as text from benchmark")
def decimals(spark, d):
    return v.read(spark, d, "benchmark").select("item_id", tx.decimal_tokens(F.col("text")).alias("text"))


@query("t9_snake_case", "select name, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as concept from (select distinct name from items)")
def snake(spark, d):
    return v.items(spark, d).select("name").distinct().select("name", tx.snake_case(F.col("name")).alias("concept"))


@query("t10_token_sets", "select item_id, len(list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я]+'))) as tokens, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я]+')), lambda t: length(t) >= 3 or regexp_matches(t, '[0-9]'))) as long_tokens from benchmark")
def token_sets(spark, d):
    t = F.col("text")
    return v.read(spark, d, "benchmark").select("item_id", F.size(tx.tokens(t)).cast("long").alias("tokens"), F.size(tx.long_tokens(t)).cast("long").alias("long_tokens"))


@query("t11_t13_numbers_codes_specs", """select id, array_to_string(list_sort(list_distinct(regexp_extract_all(replace(name, ',', '.'), '[0-9]+(?:\\.[0-9]+)?'))), ' ') as numbers,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(n), '-', ''), '[0-9a-zа-я]+'), lambda t: regexp_matches(t, '[0-9]') and regexp_matches(t, '[a-zа-я]')))), ' ') as codes,
  array_to_string(list_sort(list_distinct(regexp_extract_all(concat(id % 16, '/', id % 512), '[0-9]+/[0-9]+'))), ' ') as specs from (select *, replace(name, '#', '') as n from items)""")
def numbers(spark, d):
    n = F.regexp_replace("name", "#", "")
    spec = F.concat_ws("/", F.col("id") % 16, F.col("id") % 512)
    join = lambda a: F.array_join(F.array_sort(a), " ")
    return v.items(spark, d).select("id", join(tx.numbers(F.col("name"))).alias("numbers"), join(tx.codes(n)).alias("codes"), join(tx.slash_specs(spec)).alias("specs"))


@query("t17_serialize", """select id, string_agg(concat(key, ': ', value), '. ' order by case key when 'brand' then 1 when 'type' then 2 when 'color' then 3 when 'size' then 4 else 5 end, key) as text
  from keyed where value is not null and value <> '' group by id""", """keyed as (select id, k as key, json_extract_string(attributes, concat('$.', k)) as value
  from (select id, attributes, unnest(json_keys(case when json_valid(attributes) then attributes else '{}' end)) as k from items))""")
def serialize(spark, d):
    return v.items(spark, d).select("id", sim.serialize(at.parse(F.col("attributes")), ["brand", "type", "color", "size"]).alias("text")).filter("text <> ''")


@query("t24_ngrams", """select item_id, len(words) + greatest(len(words) - 1, 0) + greatest(len(words) - 2, 0) as word_ngrams, (greatest(n - 2, 0) + greatest(n - 3, 0) + greatest(n - 4, 0)) as char_ngrams
  from (select item_id, regexp_extract_all(text, '[^ ]+') as words, length(replace(text, ' ', '')) as n from (select item_id, trim(regexp_replace(lower(text), '[^0-9a-zа-я]+', ' ', 'g')) as text from benchmark))""")
def ngrams(spark, d):
    t = tx.alnum_only(F.col("text"))
    rows = v.read(spark, d, "benchmark").select("item_id", t.alias("t"))
    words = F.filter(F.split("t", " "), lambda w: w != "")
    return rows.select("item_id", F.size(tx.word_ngrams(words, 1, 3)).cast("long").alias("word_ngrams"), F.size(tx.char_ngrams(F.col("t"), 3, 5)).cast("long").alias("char_ngrams"))


@query("t25_balanced_budget", "select id1, id2, case when a + b <= 40 then a when a <= 20 then a when b <= 20 then 40 - b else 20 end as first, case when a + b <= 40 then b when b <= 20 then b when a <= 20 then 40 - a else 20 end as second from (select id1, id2, id1 % 60 as a, id2 % 60 as b from matches)")
def budget(spark, d):
    rows = v.matches(spark, d).select("id1", "id2", (F.col("id1") % 60).alias("a"), (F.col("id2") % 60).alias("b"))
    first, second = sim.balanced_budget(F.col("a"), F.col("b"), 40)
    return rows.select("id1", "id2", first.alias("first"), second.alias("second"))


@query("t27_t28_signatures", "select id, concat_ws('|', category, json_extract_string(attributes, '$.brand')) as family, sha256(concat(lower(category), '|', lower(name))) as signature from items where json_valid(attributes) and json_extract_string(attributes, '$.brand') is not null")
def signature(spark, d):
    bag = at.parse(F.col("attributes"))
    rows = v.items(spark, d).withColumn("brand", F.element_at(bag, "brand")).filter("brand is not null")
    return rows.select("id", F.concat_ws("|", "category", "brand").alias("family"), F.sha2(F.concat(F.lower("category"), F.lit("|"), F.lower("name")), 256).alias("signature"))


@query("b5_b6_set_relations", """select id1, id2, len(list_intersect(a, b)) as shared, len(list_distinct(list_concat(a, b))) as united, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double, 6) as jaccard,
  len(list_intersect(a, b)) = 0 as disjoint, len(list_intersect(a, b)) < len(list_distinct(list_concat(a, b))) as unequal
  from (select m.id1, m.id2, list_distinct(regexp_extract_all(lower(x.name), '[0-9a-zа-я]+')) as a, list_distinct(regexp_extract_all(lower(y.name), '[0-9a-zа-я]+')) as b from matches m join items x on x.id = m.id1 join items y on y.id = m.id2)""")
def relations(spark, d):
    parsed = v.items(spark, d).select("id", tx.tokens(F.col("name")).alias("tokens"))
    p = pr.hydrate(v.matches(spark, d).select("id1", "id2"), parsed, ("tokens",))
    a, b = F.col("tokens_1"), F.col("tokens_2")
    return p.select("id1", "id2", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), F.size(F.array_union(a, b)).cast("long").alias("united"), F.round(nm.jaccard(a, b), 6).alias("jaccard"), nm.conflict(a, b).alias("disjoint"), nm.conflict(a, b, "unequal").alias("unequal"))


@query("b7_value_relation", """select id1, id2, case when a is null and b is null then null when a is null or b is null then 'missing_one_side' when a = b then null when contains(a, b) or contains(b, a) then 'specificity_difference' else 'different_value' end as relation
  from (select m.id1, m.id2, json_extract_string(case when json_valid(x.attributes) then x.attributes else '{}' end, '$.size') as a, json_extract_string(case when json_valid(y.attributes) then y.attributes else '{}' end, '$.size') as b from matches m join items x on x.id = m.id1 join items y on y.id = m.id2)""")
def value_relation(spark, d):
    parsed = v.items(spark, d).select("id", F.element_at(at.parse(F.col("attributes")), "size").alias("size"))
    p = pr.hydrate(v.matches(spark, d).select("id1", "id2"), parsed, ("size",))
    return p.select("id1", "id2", sim.value_relation(F.col("size_1"), F.col("size_2")).alias("relation"))


@query("b16_changed_keys", """select id1, id2, string_agg(k, ',' order by k) as changed from (select m.id1, m.id2, unnest(['brand', 'color', 'price', 'size', 'type']) as k, case when json_valid(x.attributes) then x.attributes else '{}' end as a, case when json_valid(y.attributes) then y.attributes else '{}' end as b
  from matches m join items x on x.id = m.id1 join items y on y.id = m.id2) where json_extract_string(a, concat('$.', k)) is distinct from json_extract_string(b, concat('$.', k)) group by id1, id2""")
def changed(spark, d):
    bags = v.items(spark, d).select("id", F.coalesce(at.parse(F.col("attributes")), F.create_map().cast("map<string,string>")).alias("bag"))
    p = pr.hydrate(v.matches(spark, d).select("id1", "id2"), bags, ("bag",))
    return p.select("id1", "id2", F.array_join(at.changed_keys(F.col("bag_1"), F.col("bag_2")), ",").alias("changed")).filter("changed <> ''")


@query("n14_length_features", "select id1, id2, round(least(a, b) / greatest(a, b)::double, 6) as ratio, abs(a - b) as delta from (select id1, id2, length(x.name) as a, length(y.name) as b from matches join items x on x.id = id1 join items y on y.id = id2)")
def lengths(spark, d):
    p = pr.hydrate(v.matches(spark, d).select("id1", "id2"), v.items(spark, d).select("id", F.length("name").alias("n")), ("n",))
    return p.select("id1", "id2", F.round(F.least("n_1", "n_2") / F.greatest("n_1", "n_2"), 6).alias("ratio"), F.abs(F.col("n_1") - F.col("n_2")).cast("long").alias("delta"))


@query("n15_n17_probability_functions", """select id1, id2, round(ln(q / (1 - q)), 6) as logit, round(1 / (1 + exp(-(score * 4 - 2))), 6) as sigmoid, round(-(q2 * ln(q2) + (1 - q2) * ln(1 - q2)) / ln(2), 6) as entropy, round(-(target * ln(q7) + (1 - target) * ln(1 - q7)), 6) as loss
  from (select *, least(greatest(score, 1e-6), 1 - 1e-6) as q, least(greatest(score, 1e-12), 1 - 1e-12) as q2, least(greatest(score, 1e-7), 1 - 1e-7) as q7 from predictions)""")
def probabilities(spark, d):
    s = F.col("score")
    return v.predictions(spark, d).select("id1", "id2", F.round(nm.logit(s), 6).alias("logit"), F.round(nm.sigmoid(s * 4 - 2), 6).alias("sigmoid"), F.round(nm.entropy(s), 6).alias("entropy"), F.round(nm.log_loss(F.col("target"), s), 6).alias("loss"))


@query("n18_wilson", """select category, n, k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) as lower, round(least(1, (p + z * z / (2 * n) + z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)), 6) as upper
  from (select category, count(*) as n, sum(target)::bigint as k, avg(target) as p, 1.959963984540054::double as z from predictions group by category)""")
def wilson(spark, d):
    g = v.predictions(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("k"))
    return g.select("category", "n", "k", F.round(nm.wilson(F.col("k"), F.col("n")), 6).alias("lower"), F.round(nm.wilson(F.col("k"), F.col("n"), True), 6).alias("upper"))


@query("n21_prevalence_weight", "select category, round(sum(target) * 0.9::double / (0.1::double * sum(1 - target)), 6) as weight from predictions group by category")
def weights(spark, d):
    g = v.predictions(spark, d).groupBy("category").agg(F.sum("target").alias("p"), F.sum(1 - F.col("target")).alias("n"))
    return g.select("category", F.round(nm.negative_weight(F.col("p"), F.col("n"), F.lit(0.1)), 6).alias("weight"))


@query("n25_lexical_fallback", """select id1, id2, round(j * case when conflict then 0.25 else 1.0 end, 6) as score from (select id1, id2, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double as j, len(na) > 0 and len(nb) > 0 and len(list_intersect(na, nb)) = 0 as conflict
  from (select m.id1, m.id2, list_distinct(regexp_extract_all(lower(x.name), '[0-9a-zа-я]+')) as a, list_distinct(regexp_extract_all(lower(y.name), '[0-9a-zа-я]+')) as b, list_distinct(regexp_extract_all(x.name, '[0-9]+')) as na, list_distinct(regexp_extract_all(y.name, '[0-9]+')) as nb from matches m join items x on x.id = m.id1 join items y on y.id = m.id2))""")
def fallback(spark, d):
    return sim.lexical_fallback(v.matches(spark, d).select("id1", "id2"), v.items(spark, d)).select("id1", "id2", F.round("score", 6).alias("score"))


@query("n19_n20_vector_features", """select a.vec_id as a, b.vec_id as b, round(list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))), 6) as cosine,
  round(list_sum(list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]))) / 64, 6) as l1, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))), 6) as l2
  from v a join v b on b.vec_id = a.vec_id + 1""", "v as (select vec_id, cast(embedding as double[]) as e from embeddings)")
def vectors(spark, d):
    e = v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = e.alias("a").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("e").alias("f")), "vec_id")
    diff = F.zip_with("e", "f", lambda x, y: x - y)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return pairs.select(F.col("vec_id").alias("a"), "b", F.round(nm.cosine(F.col("e"), F.col("f")), 6).alias("cosine"), F.round(total(F.transform(diff, F.abs)) / F.size("e"), 6).alias("l1"), F.round(nm.norm(diff), 6).alias("l2"))


@query("n10_n11_char_tfidf_cosine", """select id1, id2, round(sum(w1 * w2) / (max(n1) * max(n2)), 6) as cosine from (
  select m.id1, m.id2, w.idf * (a.g is not null)::int as w1, w.idf * (b.g is not null)::int as w2, sqrt(na.s) as n1, sqrt(nb.s) as n2
  from matches m join grams a on a.id = m.id1 join grams b on b.id = m.id2 and b.g = a.g join idf w on w.g = a.g join norms na on na.id = m.id1 join norms nb on nb.id = m.id2) group by id1, id2""",
  """words as (select id, concat(' ', unnest(string_split(trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')), ' ')), ' ') as w from items),
  grams as (select distinct id, g from (select id, unnest(list_concat(list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substring(w, i, 3)), list_transform(range(1, greatest(length(w) - 2, 1)), lambda i: substring(w, i, 4)))) as g from words where length(w) >= 3) where length(g) >= 3),
  idf as (select g, ln((1 + (select count(*) from items)) / (1 + count(*))::double) + 1 as idf from grams group by g),
  norms as (select id, sum(idf * idf) as s from grams join idf using (g) group by id)""")
def tfidf(spark, d):
    out = sim.char_tfidf_cosine(v.matches(spark, d).select("id1", "id2"), v.items(spark, d), 3, 4)
    return out.filter("cosine > 0").select("id1", "id2", F.round("cosine", 6).alias("cosine"))


@query("f9_f10_score_interactions", "select id1, id2, round((score + score_b) / 2, 6) as mean, least(score, score_b) as low, greatest(score, score_b) as high, round(abs(score - score_b), 6) as gap, round(abs(score - 0.5) * 2, 6) as confidence from predictions")
def interactions(spark, d):
    a, b = F.col("score"), F.col("score_b")
    return v.predictions(spark, d).select("id1", "id2", F.round((a + b) / 2, 6).alias("mean"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.round(F.abs(a - b), 6).alias("gap"), F.round(F.abs(a - 0.5) * 2, 6).alias("confidence"))
