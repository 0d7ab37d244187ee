"""Queries of splits and samples by component, stratum and quota."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr, pairs as pr, sampling as sa
from ..sources import views as v
from . import base
from .base import query


def reach(name: str, edges: str) -> str:
    """SQL that labels the nodes of ``edges`` (a select of a, b) with the least node that each reaches, as ``name`` (id, component_id)."""
    return f"""{name}_e as (select a, b from ({edges}) union select b, a from ({edges})),
{name}_r(id, root) as (select distinct a, a from {name}_e union select e.b, r.root from {name}_r r join {name}_e e on e.a = r.id and r.root < e.b),
{name} as (select id, min(root) as component_id from {name}_r group by id)"""


def _oracle(name: str, body: str, ctes: str) -> None:
    base.ORACLES[name] = f"with recursive {base.views.SQL}, {ctes} {body}"


PAIRS = "select id1 as a, id2 as b from matches"
COMP = reach("comp", PAIRS)
ANCHORED = f"{COMP}, anchored as (select p.*, c.component_id, md5(concat(p.id1, ':', p.id2)) as h from predictions p join comp c on c.id = p.id1)"


def quota_sql(total: int, source: str = "predictions") -> str:
    return f"""select category, target, base + (row_number() over (order by rest desc, category, target) <= {total} - sum(base) over ())::int as quota from (
  select category, target, cast(floor(n * {total}.0::double / t) as bigint) as base, round(n * {total}.0::double / t - floor(n * {total}.0::double / t), 12) as rest from (select category, target, count(*) as n, sum(count(*)) over () as t from {source} group by category, target))"""


def _order():
    return [sa.order_hash("id1", "id2"), "id1", "id2"]


def _components(spark, d):
    return gr.pair_components(v.predictions(spark, d))


@query("l5_component_anchors")
def l5(spark, d):
    p = _components(spark, d)
    quotas = gr.largest_remainder(p.groupBy("category", "target").agg(F.count(F.lit(1)).alias("n")), 40, ["category", "target"])
    return sa.component_anchors(p, quotas, ["category", "target"], _order()).select("id1", "id2", "component_id", "category", "target")


_oracle("l5_component_anchors", f"""select id1, id2, component_id, category, target from (
  select *, row_number() over (partition by category, target order by h, id1, id2) as r from (select *, row_number() over (partition by component_id order by h, id1, id2) as k from anchored) where k = 1) a
  join ({quota_sql(40)}) q using (category, target) where r <= quota""", ANCHORED)


@query("l6_whole_components")
def l6(spark, d):
    sizes = gr.pair_components(v.matches(spark, d)).groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    return sa.components_to_count(sizes, 40, sa.order_hash("component_id")).select("component_id", "n")


# taken(i) is what the pass has taken up to the i-th component
_oracle("l6_whole_components", "select component_id, n from walk where took", f"""{COMP},
ordered as (select *, row_number() over (order by md5(component_id::varchar), component_id) as i from (select c.component_id, count(*) as n from matches m join comp c on c.id = m.id1 group by 1)),
walk(i, component_id, n, took, taken) as (select i, component_id, n, n <= 40, case when n <= 40 then n else 0 end::bigint from ordered where i = 1
  union all select o.i, o.component_id, o.n, w.taken + o.n <= 40, case when w.taken + o.n <= 40 then w.taken + o.n else w.taken end from walk w join ordered o on o.i = w.i + 1)""")


SIGNALS = ("abs(score - target) > 0.5", "abs(score - target)", "abs(score_b - target)", "abs(score - score_c)")


@query("l7_hard_anchors")
def l7(spark, d):
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    p = _components(spark, d).withColumn("model_is_error", gap("score", "target") > 0.5).withColumn("model_wrongness", gap("score", "target")).withColumn("lexical_hardness", gap("score_b", "target")).withColumn("diagnostic_hardness", gap("score", "score_c"))
    return sa.hard_anchors(p, 30, _order()).select("id1", "id2", "component_id", "category", "target", "reason")


def _hard(total: int) -> str:
    """The three sources as CTEs, each after what the ones before it took."""
    counts = [round(total * 0.4), round(total * 0.5)]
    counts.append(total - sum(counts))
    parts, used = [f"q0 as ({quota_sql(total)})"], []
    for i, (reason, score, where, n) in enumerate(zip(("model_error", "lexical_surprise", "diagnostic"), SIGNALS[1:], (SIGNALS[0], "true", "true"), counts)):
        free = " and ".join([where, *(f"component_id not in (select component_id from s{j})" for j in used)])
        parts.append(f"""s{i} as (select id1, id2, component_id, category, target, '{reason}' as reason from (
  select * from (select *, row_number() over (partition by category, target order by sc desc, h, id1, id2) as r from (select *, row_number() over (partition by component_id order by sc desc, h, id1, id2) as k from (select *, {score} as sc from anchored where {free})) where k = 1)
  join q{i} using (category, target) where r <= quota) order by sc desc, h, id1, id2 limit {n})""")
        parts.append(f"q{i + 1} as (select q.category, q.target, q.quota - coalesce(u.n, 0) as quota from q{i} q left join (select category, target, count(*) as n from s{i} group by 1, 2) u on u.category = q.category and u.target = q.target)")
        used.append(i)
    return ", ".join(parts)


_oracle("l7_hard_anchors", "select * from s0 union all select * from s1 union all select * from s2", f"{ANCHORED}, {_hard(30)}")


@query("l9_quota_groups")
def l9(spark, d):
    p = _components(spark, d)
    groups = p.groupBy("category", F.col("component_id").alias("group_id")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("target").alias("positives"))
    quotas = p.groupBy("category").agg(F.round(F.count(F.lit(1)) * 0.2).cast("long").alias("pairs"), F.round(F.sum("target") * 0.2).cast("long").alias("positives"))
    return sa.quota_groups(groups, quotas, "rules")


@query("l18_group_folds")
def l18(spark, d):
    return sa.stratified_group_folds(_components(spark, d), 5)


_oracle("l18_group_folds", """select component_id, cast((case when ((r - 1) // 5) % 2 = 0 then (r - 1) % 5 else 4 - (r - 1) % 5 end + ('0x' || substr(md5(stratum), 1, 8))::bigint) % 5 as int) as fold from (
  select *, row_number() over (partition by stratum order by size desc, component_id) as r from (
    select component_id, sum(n) as size, arg_min(concat(category, '||', target), (-n, category, target)) as stratum from (select component_id, category, target, count(*) as n from anchored group by 1, 2, 3) group by 1))""", ANCHORED)


@query("l19_hard_mining", """select id1, id2, target, copy, md5(concat('mine:', id1, ':', id2, ':', copy)) as shuffle_key from (select id1, id2, target, 0 as copy from predictions
  union all select id1, id2, target, 1 from h join (select target as t, quantile_cont(hard, 0.8) as cut from h where id1 % 3 <> 0 group by target) q on q.t = h.target where id1 % 3 <> 0 and hard >= cut)""", "h as (select *, case when target = 1 then 1 - score else score end as hard from predictions)")
def l19(spark, d):
    """Pairs whose first id isn't divisible by three are eligible for mining."""
    return sa.oversampled(v.predictions(spark, d), F.col("id1") % 3 != 0, 0.8, "mine")


@query("l20_l21_stable_ids", "select id1, id2, pair_id, ('0x' || concat(" + ", ".join(f"substr(sha256(pair_id), {2 * i + 1}, 2)" for i in reversed(range(8))) + "))::ubigint % 100 < 20 as validation from (select id1, id2, concat('rp_', substr(sha256(concat(least(id1, id2), ':', greatest(id1, id2))), 1, 24)) as pair_id from matches)")
def l21(spark, d):
    p = pr.canonical(v.matches(spark, d))
    p = p.select("id1", "id2", F.concat(F.lit("rp_"), F.substring(F.sha2(F.concat_ws(":", "lo", "hi").cast("binary"), 256), 1, 24)).alias("pair_id"))
    return p.withColumn("validation", sa.little_endian_bucket(F.col("pair_id"), 100) < 20)


_MIX = "(({x})::uhugeint * {f}::uhugeint % 18446744073709551616::uhugeint)::ubigint"
_A = f"xor(xor({_MIX.format(x='id1', f=0x9E3779B185EBCA87)}, {_MIX.format(x='id2', f=0xC2B2AE3D27D4EB4F)}), 42::ubigint)"


@query("l22_mixed_priority", f"select id1, id2, round((xor(y, y >> 27) >> 11)::double / 9007199254740992.0::double, 12) as priority from (select id1, id2, {_MIX.format(x='xor(x, x >> 30)', f=0xBF58476D1CE4E5B9)} as y from (select id1, id2, {_A} as x from matches))")
def l22(spark, d):
    return v.matches(spark, d).select("id1", "id2", F.round(sa.mixed_priority(F.col("id1"), F.col("id2"), 42), 12).alias("priority"))


_EX = "excluded as (select id from items where id % 10 = 3), rest as (select i.* from items i where category <> 'ECONOMY' and id not in (select id from excluded)), apart as (select * from items where category = 'ECONOMY')"


@query("l25_exclusion_split", """select 'items_apart' as part, (select count(*) from apart) as n_rows, 0 as uncovered union all select 'items_rest', (select count(*) from rest), 0
  union all select 'pairs_apart', (select count(*) from matches where id1 in (select id from apart) and id2 in (select id from apart)), 0 union all select 'pairs_rest', (select count(*) from matches where id1 in (select id from rest) and id2 in (select id from rest)), 0""", _EX)
def l25(spark, d):
    items, pairs = v.items(spark, d), v.matches(spark, d)
    parts = sa.exclusion_split(items, pairs, F.col("category") == "ECONOMY", items.filter("id % 10 = 3"))
    return sa.split_checks(parts, pairs)


SIGNED = "select a.id as a, b.id as b from items a join items b on a.category = b.category and lower(split_part(a.name, ' Brand', 1)) = lower(split_part(b.name, ' Brand', 1)) and a.id < b.id where a.id in (select id1 from matches union select id2 from matches) and b.id in (select id1 from matches union select id2 from matches)"
CONTENT = reach("content", f"{PAIRS} union {SIGNED}")


def _signature():
    return F.concat_ws("|", "category", F.lower(F.substring_index("name", " Brand", 1)))


@query("g4_content_components")
def g4(spark, d):
    """Components of pairs, joined where they hold items of one category and product name."""
    return sa.content_components(v.matches(spark, d), v.items(spark, d).select("id", _signature().alias("signature")))


_oracle("g4_content_components", "select id, component_id from content", CONTENT)


@query("g3_components_with_groups")
def g3(spark, d):
    named = v.items(spark, d).select("id", F.concat_ws("|", "category", "name").alias("key"))
    return gr.components(gr.with_groups(v.matches(spark, d).filter("target = 1"), named, "key")).select("id", "component_id")


_oracle("g3_components_with_groups", "select id, component_id from named", reach("named", "select id1 as a, id2 as b from matches where target = 1 union select a.id, b.id from items a join items b on a.category = b.category and a.name = b.name and a.id < b.id"))

_SPLIT = "case when ('0x' || substr(md5(concat('{seed}:', {key})), 1, 8))::bigint / 4294967296.0::double < 0.2 then 'valid' else 'train' end"
SCENARIOS = f"""{COMP}, {CONTENT}, scen as (
  select 'component_13' as scenario, m.id1, m.id2, {_SPLIT.format(seed=13, key='c.component_id')} as split from matches m join comp c on c.id = m.id1
  union all select 'component_42', m.id1, m.id2, {_SPLIT.format(seed=42, key='c.component_id')} from matches m join comp c on c.id = m.id1
  union all select 'exact_name', m.id1, m.id2, {_SPLIT.format(seed=13, key='c.component_id')} from matches m join content c on c.id = m.id1)"""


def _scenarios(spark, d):
    """Two seeds, merged product names, and a color signature that too few items have to count."""
    color = F.regexp_extract("attributes", '"color": "([^"]*)"', 1)
    return sa.scenarios(v.matches(spark, d), v.items(spark, d), ["13", "42"], 0.2, {"exact_name": _signature(), "seller?": color})


@query("l3_scenarios")
def l3(spark, d):
    return _scenarios(spark, d)


_oracle("l3_scenarios", "select scenario, id1, id2, split from scen", SCENARIOS)


@query("l10_split_overlap")
def l10(spark, d):
    """Four strategies side by side: random pairs, components by two seeds, components joined by names."""
    pairs = v.matches(spark, d)
    random = gr.hash_split(pairs, F.concat_ws(":", "id1", "id2"), "13", 0.2).select(F.lit("pair").alias("scenario"), "id1", "id2", "split")
    assigned = random.unionByName(_scenarios(spark, d)).join(pairs, ["id1", "id2"])
    out = sa.split_overlap(assigned, v.items(spark, d), {"name": _signature()})
    return out.select("scenario", "train_pairs", "valid_pairs", F.round("positive_gap", 6).alias("positive_gap"), "shared_ids", "shared_name")


_oracle("l10_split_overlap", """select s.scenario, count(*) filter (where split = 'train') as train_pairs, count(*) filter (where split = 'valid') as valid_pairs, round(abs(avg(target) filter (where split = 'valid') - avg(target) filter (where split = 'train')), 6) as positive_gap,
  max(x.n) as shared_ids, max(y.n) as shared_name from assigned s
  join (select scenario, count(*) filter (where k = 2) as n from (select scenario, id, count(distinct split) as k from ends group by 1, 2) group by 1) x on x.scenario = s.scenario
  join (select scenario, count(*) filter (where k = 2) as n from (select scenario, sig, count(distinct split) as k from ends group by 1, 2) group by 1) y on y.scenario = s.scenario group by s.scenario""",
  f"""{SCENARIOS}, assigned as (select s.*, m.target from (select * from scen union all select 'pair', id1, id2, {_SPLIT.format(seed=13, key="concat(id1, ':', id2)")} from matches) s join matches m on m.id1 = s.id1 and m.id2 = s.id2),
ends as (select e.*, concat(i.category, '|', lower(split_part(i.name, ' Brand', 1))) as sig from (select scenario, split, unnest([id1, id2]) as id from assigned) e join items i on i.id = e.id)""")  # fmt: skip


@query("u7_representation_overlap", """select representation, count(*) filter (where t) as train_unique, count(*) filter (where v) as validation_unique, count(*) filter (where t and v) as shared_unique, round(count(*) filter (where t and v) / greatest(1, count(*) filter (where v))::double, 6) as validation_seen_share
  from (select representation, value, bool_or(id % 5 <> 0) as t, bool_or(id % 5 = 0) as v from (select id, 'name' as representation, lower(split_part(name, ' Brand', 1)) as value from items union all select id, 'brand', json_extract_string(attributes, '$.brand') from (select * from items where id % 97 <> 5) union all select id, 'tokens', unnest(string_split(lower(split_part(name, ' Brand', 1)), ' ')) from items) where value <> '' group by 1, 2) group by 1""")
def u7(spark, d):
    items = v.items(spark, d)
    product = F.lower(F.substring_index("name", " Brand", 1))
    columns = {"name": F.array(product), "brand": F.array(F.regexp_extract("attributes", '"brand": "([^"]*)"', 1)), "tokens": F.split(product, " ")}
    out = sa.representation_overlap(items.filter("id % 5 <> 0"), items.filter("id % 5 = 0"), columns)
    return out.withColumn("validation_seen_share", F.round("validation_seen_share", 6))
