"""Queries of prototypes, anchors, routing grids, retrieval, exemplar banks, tasks, and checks of generated data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import attributes as at, features as fe, generation as ge, graph as gr, metrics as me, pairs as pr, policies as po, retrieval as rt, routing as ro, rules as ru, similarity as sim
from ..sources import files as fi, views as v
from . import features as fp
from .base import query
from .policies import GATED, Z
from .statistics import AP, curve_sql


def lower_upper(k: str, n: str) -> tuple[str, str]:
    body = f"(({k} / {n}::double) + {Z} * {Z} / (2 * {n}) {{s}} {Z} * sqrt((({k} / {n}::double) * (1 - {k} / {n}::double) + {Z} * {Z} / (4 * {n})) / {n})) / (1 + {Z} * {Z} / {n})"
    return f"greatest(0, {body.format(s='-')})", f"least(1, {body.format(s='+')})"


# facts and prototypes

FACTS = f"""{fp.RICH}, facts as (select p.id1, p.id2, concat(p.id1, ':', p.id2) as pair_id, p.category, p.target as label, case when p.id1 % 3 = 0 then 'validation' else 'discovery' end as split, k as concept, x as va, y as vb,
  count(*) over (partition by p.id1, p.id2) = 1 as singleton from (select p.*, unnest(['brand', 'size', 'model', 'storage']) as k, unnest([array_to_string(a.brand, ' '), array_to_string(a.size, ' '), array_to_string(a.model, ' '), array_to_string(a.storage, ' ')]) as x, unnest([array_to_string(b.brand, ' '), array_to_string(b.size, ' '), array_to_string(b.model, ' '), array_to_string(b.storage, ' ')]) as y
    from predictions p join bags a on a.id = p.id1 join bags b on b.id = p.id2) p where x <> '' and y <> '' and x <> y)"""


def facts(spark, d):
    """Differing attributes of pairs, as facts."""
    bags = fp.rich_items(spark, d).select("id", at.multi_bag(F.col("attributes")).alias("bag"))
    p = pr.hydrate(v.predictions(spark, d), bags, ("bag",))
    rows = p.select("id1", "id2", "category", "target", "bag_1", "bag_2", F.explode(F.array(*map(F.lit, ("brand", "size", "model", "storage")))).alias("concept"))
    value = lambda i: F.array_join(F.coalesce(F.try_element_at(f"bag_{i}", F.col("concept")), F.array().cast("array<string>")), " ")
    rows = rows.select("id1", "id2", F.concat_ws(":", "id1", "id2").alias("pair_id"), "category", F.col("target").alias("label"), F.when(F.col("id1") % 3 == 0, "validation").otherwise("discovery").alias("split"), "concept", F.lit("different_value").alias("relation"), value(1).alias("value_a"), value(2).alias("value_b"))
    rows = rows.filter("value_a <> '' and value_b <> '' and value_a <> value_b")
    alone = rows.groupBy("pair_id").agg((F.count(F.lit(1)) == 1).alias("singleton"))
    return rows.join(alone, "pair_id")


@query("r12_prototypes", """select category, concept, family as value_family, count(*) as pair_support, count(*) filter (where label = 0) as label0, count(*) filter (where label = 1) as label1, count(*) filter (where label = 0 and singleton) as singleton_label0, count(*) filter (where label = 1 and singleton) as singleton_label1,
  count(*) filter (where label = 0 and split = 'discovery') as discovery_label0, count(*) filter (where label = 1 and split = 'discovery') as discovery_label1, count(*) filter (where label = 0 and split = 'validation') as validation_label0, count(*) filter (where label = 1 and split = 'validation') as validation_label1, md5(concat_ws('|', category, 'different_value', concept, family)) as prototype_key
  from (select *, case when regexp_matches(concat(va, vb), '[0-9]') and regexp_matches(concat(va, vb), '[a-z]') then 'code' when regexp_matches(concat(va, vb), '[0-9]') then 'number' else 'text' end as family from facts) group by category, concept, family""", FACTS)
def r12(spark, d):
    return ge.prototypes(facts(spark, d)).drop("relation", "block_key")


VECS = "vecs as (select vec_id, label, cast(embedding as double[]) as e from embeddings), sims as (select x.vec_id as a, y.vec_id as b, round(list_cosine_similarity(x.e, y.e), 9) as s from vecs x join vecs y on x.label = y.label and x.vec_id <> y.vec_id), top as (select * from (select *, row_number() over (partition by a order by s desc, b) as r from sims) where r <= 5), mut as (select x.a, x.b, x.s from top x join top y on y.a = x.b and y.b = x.a where x.s + 1e-7 >= 0.2)"


def _vectors(spark, d):
    return v.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("block"))


@query("r14_blocked_mutual_neighbours", "select a, b, round(s, 6) as cosine from mut where a < b", VECS)
def r14(spark, d):
    return rt.mutual(rt.nearest(_vectors(spark, d), 5), 0.2).filter("a < b").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("r14_pooled_evidence", """select node, round(coalesce(sum(s * (b % 3)), 0) + node % 3, 6) as label0, round(coalesce(sum(s * (b % 5)), 0) + node % 5, 6) as label1, count(b) as neighbours, coalesce(sum(s * (b % 3)), 0) + node % 3 + coalesce(sum(s * (b % 5)), 0) + node % 5 >= 4 and greatest(coalesce(sum(s * (b % 3)), 0) + node % 3, coalesce(sum(s * (b % 5)), 0) + node % 5) / (coalesce(sum(s * (b % 3)), 0) + node % 3 + coalesce(sum(s * (b % 5)), 0) + node % 5) >= 0.6 as is_candidate
  from (select vec_id as node from embeddings) n left join mut on a = node and not ((node % 7 = 1 and b % 7 = 2) or (node % 7 = 2 and b % 7 = 1)) group by node""", VECS)
def r14_pooled(spark, d):
    """Evidence of mutual neighbours, weighted by similarity; concepts 1 and 2 may not be joined."""
    nodes = _vectors(spark, d).select(F.col("vec_id").alias("node"), (F.col("vec_id") % 7).cast("string").alias("concept"), (F.col("vec_id") % 3).cast("double").alias("label0"), (F.col("vec_id") % 5).cast("double").alias("label1"))
    links = rt.mutual(rt.nearest(_vectors(spark, d), 5), 0.2)
    out = rt.pooled_evidence(nodes, links, spark.createDataFrame([("1", "2")], "concept_a string, concept_b string"), ["label0", "label1"])
    total = F.col("label0") + F.col("label1")
    good = (total >= 4) & (F.greatest("label0", "label1") / F.greatest(total, F.lit(1e-12)) >= 0.6)
    return out.select("node", F.round("label0", 6).alias("label0"), F.round("label1", 6).alias("label1"), "neighbours", good.alias("is_candidate"))


_LOW, _HIGH = lower_upper("positives", "support")
ANCHORED = f"{GATED}, an as (select id1, id2, target, category, unnest(anchors) as anchor from kinds), ans as (select anchor, count(*) as support, sum(target)::bigint as positives, count(distinct category) as categories from an group by anchor)"


def _anchored(spark, d):
    pairs = v.predictions(spark, d)
    typed = fe.typed_native(pairs, fp.rich_items(spark, d), fp.RULES, fp.REGIMES)
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in po.anchors(F.col("score")).items())))
    return typed.withColumn("anchors", named)


@query("r17_anchor_statistics", f"select anchor, support, positives, categories, round(positives / support::double, 6) as rate, round({_LOW}, 6) as low, round({_HIGH}, 6) as high from ans", ANCHORED)
def r17(spark, d):
    rows = _anchored(spark, d).select("id1", "id2", "target", "category", F.explode("anchors").alias("anchor"))
    out = ge.anchor_statistics(rows)
    return out.select("anchor", "support", "positives", "categories", *(F.round(c, 6).alias(c) for c in ("rate", "low", "high")))


@query("r17_anchored_rules", "select a.anchor, r.rule, count(*) as n, round(avg(a.target), 6) as with_rule, round(avg(a.target) - max(s.positives / s.support::double), 6) as difference from an a join (select id1, id2, replace(unnest(rules), '::', '|') as rule from kinds) r using (id1, id2) join ans s on s.anchor = a.anchor group by 1, 2", ANCHORED)
def r17_rules(spark, d):
    """Anchors and rules of a pair are written once, as both sides of the join read them."""
    p = gr.cut(_anchored(spark, d).select("id1", "id2", "target", "category", "anchors", "fired_rules"))
    rows = p.select("id1", "id2", "target", "category", F.explode("anchors").alias("anchor"))
    out = ge.anchor_statistics(rows, p.select("id1", "id2", F.explode("fired_rules").alias("rule")))
    return out.select("anchor", "rule", "n", F.round("with_rule", 6).alias("with_rule"), F.round("difference", 6).alias("difference"))


@query("r16_evidence_tiers", "select rule, n, case when n >= 20 and k / n::double >= 0.5 then 'strong' when n >= 8 then 'medium' else 'weak' end as tier from (select unnest(rules) as rule, count(*) as n, sum(target) as k from kinds group by 1)", GATED)
def r16(spark, d):
    rows = _anchored(spark, d).select("target", F.explode("fired_rules").alias("rule"))
    out = rows.groupBy(F.regexp_replace("rule", r"\|", "::").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("rate"))
    return out.select("rule", "n", F.when((F.col("n") >= 20) & (F.col("rate") >= 0.5), "strong").when(F.col("n") >= 8, "medium").otherwise("weak").alias("tier"))


# routing grids

_MODES = {"quarter": 0.25, "half": 0.5, "whole": 1.0}
_BLEND = "(({1} * score) + {0} * {2})"
_ROUTES = " union all ".join(
    f"select id1, id2, category, target, score as base, '{m}' as mode, '{e}' as expert, (1 - {w}) * score + {w} * {e} as other, round(abs(score - target) - abs((1 - {w}) * score + {w} * {e} - target), 9) as gain from predictions"
    for m, w in _MODES.items() for e in ("score_b", "score_c")
)
ROUTES = f"""one as ({_ROUTES}), routes as (select * from one union all select id1, id2, category, target, base, mode, 'best', case when gb >= gc then ob else oc end, greatest(gb, gc) from (select b.id1, b.id2, b.category, b.target, b.base, b.mode, b.other as ob, b.gain as gb, c.other as oc, c.gain as gc from one b join one c on c.id1 = b.id1 and c.id2 = b.id2 and c.mode = b.mode where b.expert = 'score_b' and c.expert = 'score_c')),
placed as (select *, 'global' as policy, row_number() over (partition by mode, expert order by gain desc, id1, id2) as r, count(*) over (partition by mode, expert) as n from routes union all select *, 'category', row_number() over (partition by mode, expert, category order by gain desc, id1, id2), count(*) over (partition by mode, expert, category) from routes),
cut as (select p.*, budget, r <= floor(budget * n + 1e-12) and gain > 0 as go, round(case when r <= floor(budget * n + 1e-12) and gain > 0 then other else base end, 9) as final from placed p, (select unnest([0.05, 0.2, 0.4])::double as budget)),
{curve_sql('rc', 'cut', 'mode, expert, policy, budget, category', 'final')}"""


@query("r20_oracle_routing_grid", f"select * from (select mode, expert, policy, budget, count(*) filter (where go) as routed from cut group by 1, 2, 3, 4) join (select mode, expert, policy, budget, round(avg(ap), 6) as macro_ap from (select mode, expert, policy, budget, category, {AP} as ap from rc group by 1, 2, 3, 4, 5) group by 1, 2, 3, 4) using (mode, expert, policy, budget)", ROUTES)
def r20(spark, d):
    out = ro.oracle_routes(v.predictions(spark, d), _MODES, ["score_b", "score_c"], [0.05, 0.2, 0.4])
    return out.withColumn("macro_ap", F.round("macro_ap", 6))


_WB = "select unnest([0.25, 0.5, 0.75])::double"
GRID = f"""m1 as (select *, row_number() over (order by abs(score - 0.5), id1, id2) <= floor(n * 0.4 + 1e-12) as e1 from (select *, count(*) over () as n from predictions)),
m2 as (select *, row_number() over (order by e1 desc, abs(score_b - 0.5), id1, id2) <= floor(n * 0.05 + 1e-12) and e1 as ins, row_number() over (order by e1::int, abs(score_b - 0.5), id1, id2) <= floor(n * 0.05 + 1e-12) and not e1 as outs from m1),
gr as (select category, target, wb as weight_b, wc as weight_c, scheme, round(case when scheme = 'hierarchical' and ins then (1 - wc) * mid + wc * score_c when scheme = 'exclusive' and outs then (1 - wc) * score + wc * score_c else mid end, 9) as s
  from (select *, case when e1 then (1 - wb) * score + wb * score_b else score end as mid from m2, ({_WB} as wb), ({_WB} as wc), (select unnest(['hierarchical', 'exclusive']) as scheme))), {curve_sql('gs', 'gr', 'scheme, weight_b, weight_c, category', 's')},
gm as (select scheme, weight_b, weight_c, avg(ap) as macro_ap from (select scheme, weight_b, weight_c, category, {AP} as ap from gs group by 1, 2, 3, 4) group by 1, 2, 3)"""


@query("r21_blend_grid", "select scheme, weight_b, weight_c, round(macro_ap, 6) as macro_ap, row_number() over (partition by scheme order by round(macro_ap, 9) desc, weight_b, weight_c) = 1 as best from gm", GRID)
def r21(spark, d):
    grid = ro.blend_grid(v.predictions(spark, d), [0.25, 0.5, 0.75])
    best = ro.best_blends(grid).select("scheme", "weight_b", "weight_c", F.lit(True).alias("best"))
    return grid.join(F.broadcast(best), ["scheme", "weight_b", "weight_c"], "left").select("scheme", "weight_b", "weight_c", F.round("macro_ap", 6).alias("macro_ap"), F.coalesce("best", F.lit(False)).alias("best"))  # one row a scheme


@query("w27_coverage_frontier", f"select scheme, coalesce(min(weight_b + weight_c) filter (where macro_ap >= top - 0.02)::varchar, 'not_reached') as least_weight, coalesce(min(weight_b + weight_c) filter (where macro_ap >= 2)::varchar, 'not_reached') as unreachable, count(*) filter (where front) as frontier from (select *, max(macro_ap) over (partition by scheme) as top, not exists (select 1 from gm o where o.scheme = g.scheme and o.weight_b + o.weight_c <= g.weight_b + g.weight_c and round(o.macro_ap, 9) >= round(g.macro_ap, 9) and (o.weight_b + o.weight_c < g.weight_b + g.weight_c or round(o.macro_ap, 9) > round(g.macro_ap, 9))) as front from gm g) group by scheme", GRID)
def w27(spark, d):
    """The least total weight that comes within a tolerance of each scheme's best, or not_reached, and how many settings no
    other beats in both weight and quality."""
    grid = ro.blend_grid(v.predictions(spark, d), [0.25, 0.5, 0.75]).withColumn("cost", F.col("weight_b") + F.col("weight_c")).withColumn("q", F.round("macro_ap", 9))
    top = grid.groupBy("scheme").agg(F.max("macro_ap").alias("top"))
    least = grid.join(F.broadcast(top), "scheme").groupBy("scheme").agg(*(F.coalesce(F.min(F.when(c, F.col("cost"))).cast("string"), F.lit("not_reached")).alias(n) for n, c in (("least_weight", F.col("macro_ap") >= F.col("top") - 0.02), ("unreachable", F.col("macro_ap") >= 2))))  # two rows
    other = grid.select("scheme", F.col("cost").alias("oc"), F.col("q").alias("oq"))
    front = grid.join(other, (grid["scheme"] == other["scheme"]) & (F.col("oc") <= F.col("cost")) & (F.col("oq") >= F.col("q")) & ((F.col("oc") < F.col("cost")) | (F.col("oq") > F.col("q"))), "left_anti")
    return least.join(front.groupBy("scheme").agg(F.count(F.lit(1)).alias("frontier")), "scheme")


# retrieval, banks, tasks


def bank(spark, d):
    items = v.items(spark, d)
    vectors = v.read(spark, d, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").cast("array<double>").alias("e"))
    rows = items.select("id", "category", "name", F.regexp_extract("name", "(Brand#[0-9])", 1).alias("subtype"), F.concat_ws(" ", "name", "attributes").alias("text"), (F.col("id") % 500).alias("vec"))
    return rows.join(vectors, "vec").drop("vec")


BANK = """bk as (select i.id, category, name, lower(name) as folded, regexp_extract(name, '(Brand#[0-9])', 1) as subtype, regexp_extract_all(lower(concat(name, ' ', attributes)), '[0-9a-z]+') as w, cast(embedding as double[]) as e from items i join embeddings v on v.vec_id = i.id % 500),
sz as (select category, subtype, count(*) as n from bk group by 1, 2), qs as (select b.*, s.n from bk b join sz s using (category, subtype) where b.id % 50 = 0),
cand as (select q.id as query_id, d.id, d.w, len(d.w) as dl, list_distinct(q.w) as asked, round(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])), 9) as dense from qs q join bk d on d.category = q.category and d.id <> q.id and d.folded <> q.folded and (q.n < 8 or d.subtype = q.subtype)),
st as (select query_id, count(*) as n, greatest(avg(dl), 1) as avgdl from cand group by 1), tfs as (select query_id, id, dl, t, count(*)::double as tf from (select query_id, id, dl, asked, unnest(w) as t from cand) where list_contains(asked, t) group by 1, 2, 3, 4),
dfs as (select query_id, t, count(*) as df from tfs group by 1, 2), lex as (select tfs.query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as s from tfs join dfs on dfs.query_id = tfs.query_id and dfs.t = tfs.t join st on st.query_id = tfs.query_id group by 1, 2),
both_ as (select c.query_id, c.id, c.dense, coalesce(l.s, 0) as lexical from cand c left join lex l on l.query_id = c.query_id and l.id = c.id),
fused as (select query_id, id, round(0.55::double / (20 + row_number() over (partition by query_id order by dense desc, id)) + 0.45::double / (20 + row_number() over (partition by query_id order by lexical desc, id)), 12) as score from both_)"""


@query("i2_i3_hybrid_retrieval", "select * from (select query_id, id, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank, round(score, 9) as score from fused) where rank <= 5", BANK)
def i2_i3(spark, d):
    return rt.hybrid(bank(spark, d), F.col("id") % 50 == 0, 5).withColumn("score", F.round("score", 9))


SIZED = "sized as (select id, category, name, case when id % 97 = 5 then 0 when id % 11 = 3 then 0 else len(json_keys(attributes)) end as n from (select id, category, name, case when id % 97 = 5 then '{}' else attributes end as attributes from items))"


@query("i4_exemplar_bank", "select category, id, n as attributes_n, cast(turn as int) as turn from (select *, row_number() over (partition by category order by md5(concat('bank:', id)), id) - 1 as turn from sized where n between 3 and 40) where turn < 8", SIZED)
def i4(spark, d):
    bag = at.parse_folded(F.col("attributes"))
    return ge.exemplar_bank(v.items(spark, d), bag, 8, "bank").select("category", "id", F.col("attributes_n").cast("long").alias("attributes_n"), "turn")


@query("i4_category_profiles", """select s.category, count(*) as items, quantile_cont(n, 0.1)::double as attributes_p10, quantile_cont(n, 0.5)::double as attributes_p50, quantile_cont(n, 0.9)::double as attributes_p90, quantile_cont(length(name), 0.1)::double as chars_p10, quantile_cont(length(name), 0.5)::double as chars_p50, quantile_cont(length(name), 0.9)::double as chars_p90, max(top_keys) as top_keys from sized s
  left join (select category, string_agg(k, ',' order by c desc, k) as top_keys from (select *, row_number() over (partition by category order by c desc, k) as r from (select category, k, count(*) as c from (select category, unnest(case when id % 97 = 5 then [] else json_keys(attributes) end) as k from (select id, category, case when id % 97 = 5 then '{}' else attributes end as attributes from items)) group by 1, 2)) where r <= 3 group by 1) t on t.category = s.category group by s.category""", SIZED)
def i4_profiles(spark, d):
    return ge.category_profiles(v.items(spark, d), at.parse_folded(F.col("attributes")), 3)


TASKS = f"""{SIZED}, bk as (select category, id from (select *, row_number() over (partition by category order by md5(concat('bank:', id)), id) - 1 as turn from sized where n between 3 and 40) where turn < 8),
cs as (select category, count(*) as n, row_number() over (order by category) - 1 as c, count(*) over () as k from bk group by category), pl as (select *, greatest(0, (100 - 1 - c) // k + 1) as turns from cs),
rd as (select b.category, b.id, p.n, p.c, p.k, p.turns, unnest(range(0, cast(ceil(turns / n::double) as bigint))) as pass from bk b join pl p using (category))"""


@query("i5_round_robin_tasks", "select turn * k + c as task, -1 - (turn * k + c) as synthetic_id, category, id from (select *, pass * n + row_number() over (partition by category, pass order by md5(concat('5:', pass, ':', id)), id) - 1 as turn from rd) where turn < turns", TASKS)
def i5(spark, d):
    exemplars = ge.exemplar_bank(v.items(spark, d), at.parse_folded(F.col("attributes")), 8, "bank").select("category", "id")
    return ge.round_robin_tasks(exemplars, 100, "5")


@query("i7_rule_schedule")
def i7(spark, d):
    """Rules and quotas from the pairs; the planner runs on the driver, over a list of rules."""
    p = v.predictions(spark, d)
    known = sorted(r.category for r in p.select("category").distinct().collect())  # a few categories
    rules = [{"rule_id": f"r{i}", "concept": f"c{i % 7}", "label": i % 2, "categories": {c for j, c in enumerate(known) if (i + j) % 3}} for i in range(30)]
    tasks = ge.rule_schedule(rules, {1: 20, 2: 15, 3: 10}, {c: 5 + j for j, c in enumerate(known)}, 4)
    return spark.createDataFrame([(t["task"], t["category"], ",".join(t["rules"]), t["label"]) for t in tasks] or [(0, "", "", 0)], "task int, category string, rules string, label int")


# checks of generated items and pairs


def generated(spark, d):
    """Every item as a copy of its neighbour's card with some faults, beside that neighbour as its anchor."""
    k = F.col("id")
    items = v.items(spark, d).select("id", "name", "category", at.parse_folded(F.col("attributes")).alias("bag"))
    anchors = items.select((k + 1).alias("id"), F.col("name").alias("anchor_name"), F.col("category").alias("anchor_category"), F.col("bag").alias("anchor_bag"))
    both = items.join(anchors, "id")
    bag = F.when(k % 4 == 0, F.col("anchor_bag")).when(k % 9 == 1, F.map_concat("bag", F.create_map(F.lit("extra"), F.lit("x")))).otherwise(F.map_from_entries(F.transform(F.map_entries("anchor_bag"), lambda e: F.struct(e["key"], F.when((e["key"] == "size") & (k % 7 == 2), "").otherwise(F.concat(e["value"], F.lit("!")))))))
    return both.withColumn("bag", bag).withColumn("name", F.when(k % 13 == 5, "abc").otherwise(F.col("name"))).withColumn("category", F.when(k % 6 == 1, F.col("category")).otherwise(F.col("anchor_category")))


GENERATED = f"""cards as (select id, name, category, case when id % 97 = 5 or id % 11 = 3 then [] else list_filter(list_transform(['brand', 'type', 'size', 'price', 'color'], lambda k: {{'k': k, 'v': lower(json_extract_string(case when id % 97 = 5 then '{{}}' else attributes end, concat('$.', k)))}}), lambda x: x.v is not null) end as kv from items),
gen as (select i.id, case when i.id % 13 = 5 then 'abc' else i.name end as name, case when i.id % 6 = 1 then i.category else a.category end as category, a.category as anchor_category, a.name as anchor_name, a.kv as akv,
  case when i.id % 4 = 0 then a.kv when i.id % 9 = 1 then list_append(i.kv, {{'k': 'extra', 'v': 'x'}}) else list_transform(a.kv, lambda e: {{'k': e.k, 'v': case when e.k = 'size' and i.id % 7 = 2 then '' else concat(e.v, '!') end}}) end as kv from cards i join cards a on a.id = i.id - 1),
judge as (select *, list_transform(akv, lambda e: e.k) as aks, list_transform(kv, lambda e: e.k) as ks, list_transform(list_filter(akv, lambda e: coalesce(list_filter(kv, lambda x: x.k = e.k)[1].v, '') <> e.v), lambda e: e.k) as changed from gen)"""


@query("i8_candidate_reasons", """select id, concat_ws(',', case when category <> anchor_category then 'category_mismatch' end, case when list_sort(ks) <> list_sort(aks) then 'attribute_schema_mismatch' end, case when len(list_filter(aks, lambda k: coalesce(list_filter(kv, lambda x: x.k = k)[1].v, '') = '')) > 0 then 'empty_attribute_value' end,
  case when length(name) < 5 then 'name_length_out_of_bounds' end, case when len(changed) / greatest(1, len(aks))::double < 0.35 then 'too_few_values_changed' end, case when list_contains(aks, 'brand') and not list_contains(changed, 'brand') then 'identity_fields_unchanged' end, case when name <> 'abc' then 'exact_name_copy' end) as reasons from judge""", GENERATED)
def i8(spark, d):
    """Names of the catalogue are copies; similarities are left to i8_candidate_similarity."""
    g = generated(spark, d).withColumn("known_name", F.col("name") != "abc").withColumn("similarity", F.lit(0.0)).withColumn("subtype", F.lit("a")).withColumn("anchor_subtype", F.lit("__title__:a"))
    return g.select("id", F.array_join(ge.candidate_reasons(), ",").alias("reasons"))


@query("i8_candidate_similarity")
def i8_similarity(spark, d):
    """The same with the names' greatest token-set similarity to the anchor."""
    g = sim.with_ratios(generated(spark, d), "name", "anchor_name", {"similarity": "token_set"}, scale=0.01)
    g = g.withColumn("known_name", F.lit(False)).withColumn("subtype", F.lit("a")).withColumn("anchor_subtype", F.lit("a"))
    return g.select("id", F.round("similarity", 6).alias("similarity"), F.array_join(ge.candidate_reasons(most_similar=0.9), ",").alias("reasons"))


@query("i9_dataset_checks", """select count(*) as n_rows, count(*) filter (where id % 97 = 5) as invalid_attributes, count(*) filter (where id % 50 = 7) as empty_name, 0 as empty_category, count(*) filter (where id % 97 <> 5 and id % 11 = 3) as empty_attributes, (select coalesce(sum(n), 0)::bigint from (select count(*) as n from gx group by id having count(*) > 1)) as repeated_ids,
  (select coalesce(sum(n), 0)::bigint from (select count(*) as n from gx group by lower(trim(name)) having count(*) > 1)) as repeated_names, (select coalesce(sum(n), 0)::bigint from (select count(*) as n from gx group by category, lower(trim(name)), case when id % 97 = 5 then '{}' else attributes end having count(*) > 1)) as repeated_cards,
  (select count(*) from gx where lower(trim(name)) in (select lower(name) from items where id % 8 = 0)) as reference_names, (select count(*) from (select unnest(json_keys(case when id % 97 = 5 then '{}' else attributes end)) as k from gx except select unnest(json_keys(case when id % 97 = 5 then '{}' else attributes end)) from items where id % 7 <> 0)) as new_keys, false as valid from gx""",
  "gx as (select id, case when id % 50 = 7 then '  ' else name end as name, attributes, category from items union all select id, case when id % 50 = 7 then '  ' else name end, attributes, category from items where id % 30 = 4)")
def i9(spark, d):
    """Items with blank names and repeats, against an eighth of the catalogue (keys: of items that have no color)."""
    items = v.items(spark, d)
    own = items.withColumn("name", F.when(F.col("id") % 50 == 7, "  ").otherwise(F.col("name")))
    own = own.unionAll(own.filter("id % 30 = 4"))
    bag = at.parse(F.col("attributes"))
    reference = items.select(F.when(F.col("id") % 8 == 0, F.col("name")).otherwise("?").alias("name"), F.when(F.col("id") % 7 != 0, bag).alias("bag"))
    return ge.dataset_checks(own, reference, bag).withColumn("empty_category", F.col("empty_category").cast("int"))


RAW = """made as (select id1, id2, target from matches union all select id2, id1, 1 - target from matches where id1 % 8 = 3 union all select id1, id1, 0 from matches where id1 % 20 = 1 union all select id1, id2 + 1000000, 1 from matches where id1 % 25 = 2),
cr as (select id, category, lower(name) as name, regexp_extract_all(lower(name), '[0-9a-z]+') as toks, case when id % 97 = 5 or id % 11 = 3 then [] else list_filter(list_transform(['brand', 'type', 'size', 'price', 'color'], lambda k: concat(k, '=', lower(json_extract_string(case when id % 97 = 5 then '{}' else attributes end, concat('$.', k))))), lambda x: not ends_with(x, '=')) end as kv from items)"""


@query("i10_pair_checks", """select m.id1, m.id2, concat_ws(',', case when a.id is null or b.id is null then 'unknown_item' end, case when m.id1 = m.id2 then 'self_pair' end, case when t.n > 1 then 'repeated_pair' end, case when t.l > 1 then 'conflicting_labels' end, case when a.category <> b.category then 'category_mismatch' end,
  case when m.target = 0 and a.name = b.name and list_sort(a.kv) = list_sort(b.kv) then 'equal_cards_labelled_different' end, case when m.target = 1 and a.id is not null and b.id is not null and len(list_intersect(a.kv, b.kv)) = 0 and len(list_intersect(a.toks, b.toks)) = 0 then 'nothing_shared_labelled_same' end) as reasons
  from made m left join cr a on a.id = m.id1 left join cr b on b.id = m.id2 join (select least(id1, id2) as lo, greatest(id1, id2) as hi, count(*) as n, count(distinct target) as l from made group by 1, 2) t on t.lo = least(m.id1, m.id2) and t.hi = greatest(m.id1, m.id2)""", RAW)
def i10(spark, d):
    m = v.matches(spark, d)
    made = m.unionAll(m.filter("id1 % 8 = 3").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), (1 - F.col("target")).alias("target"))).unionAll(m.filter("id1 % 20 = 1").select("id1", F.col("id1").alias("id2"), F.lit(0).alias("target"))).unionAll(m.filter("id1 % 25 = 2").select("id1", (F.col("id2") + 1000000).alias("id2"), F.lit(1).alias("target")))
    items = v.items(spark, d).select("id", "category", "name", at.parse_folded(F.col("attributes")).alias("bag"))
    return ge.pair_checks(made, items).select("id1", "id2", F.array_join("reasons", ",").alias("reasons"))


MUTATED = [
    # anchor bag, bag, key, declared, old, new, allowed, anchor name, name, reasons
    ({"Type": "Lamp", "color": "red"}, {"Type": "Lamp", "color": "blue"}, "color", "color", "red", "blue", ["red>blue"], "Lamp red", "Lamp blue", ""),
    ({"Type": "Lamp", "color": "red"}, {"Type": "Lamp", "color": "blue"}, "color", "color", "red", "blue", ["red>green"], "Lamp red", "Lamp red", "disallowed_value_transition,title_not_updated"),
    ({"Type": "Lamp", "color": "red"}, {"Type": "Desk", "color": "blue"}, "color", "Type", "red", "blue", [], "Lamp", "Lamp", "wrong_rule_attribute_key,undeclared_change"),
    ({"Type": "Lamp", "color": "red"}, {"Type": "Lamp"}, "color", "color", "red", "Red ", [], "Lamp", "Lamp", "attribute_schema_mismatch,value_not_changed,declared_value_not_applied"),
    ({"Type": "Lamp", "color": "red"}, {"Type": "Lamp", "color": "blue"}, "color", "color", "white", "blue", [], "Lamp", "Lamp", "original_differs_from_anchor"),
]


@query("i11_mutation_reasons", "select * from (values " + ", ".join(f"({i}, '{r[-1]}')" for i, r in enumerate(MUTATED)) + ") as t(i, reasons)")
def i11(spark, d):
    rows = [(i, *r[:-1]) for i, r in enumerate(MUTATED)]
    df = spark.createDataFrame(rows, "i int, anchor_bag map<string,string>, bag map<string,string>, key string, declared_key string, old string, new string, allowed array<string>, anchor_name string, name string")
    df = df.withColumn("category", F.lit("c")).withColumn("anchor_category", F.lit("c")).withColumn("similarity", F.lit(0.9))
    return df.select("i", F.array_join(ge.mutation_reasons(), ",").alias("reasons"))


@query("i11_anchor_reasons", """select id, concat_ws(',', case when id % 6 = 0 then 'anchor_category_mismatch' end, case when len(kv) not between 3 and 4 then 'anchor_attribute_count_out_of_bounds' end, case when len(list_filter(kv, lambda e: e.k = 'price')) > 0 then 'anchor_forbidden_identifier' end, case when len(kv) = 0 then 'anchor_missing_product_type' end,
  case when len(kv) > 0 and id % 4 = 1 then 'anchor_product_type_mismatch' end, case when len(kv) > 0 and id % 4 <> 1 and not starts_with(lower(name), lower(category)) then 'anchor_name_does_not_start_with_product_type' end) as reasons from cards""", GENERATED)
def i11_anchors(spark, d):
    k = F.col("id")
    items = v.items(spark, d).select("id", "name", "category", at.parse_folded(F.col("attributes")).alias("bag"))
    tasks = items.withColumn("task_category", F.when(k % 6 == 0, "other").otherwise(F.col("category"))).withColumn("product_type", F.when(k % 4 == 1, "other").otherwise(F.col("category")))
    return tasks.select("id", F.array_join(ge.anchor_reasons("type", "price", 3, 4), ",").alias("reasons"))


_WORDS = "name"
for _unit, _word in (("mm", "millimetres"), ("cm", "centimetres"), ("kg", "kilograms"), ("ml", "millilitres"), ("gb", "GB")):
    _WORDS = f"regexp_replace({_WORDS}, '(?i)([0-9]) ?{_unit}\\b', '\\1 {_word}', 'g')"
_SURFACE = {
    "upper_case": "upper(name)", "unit_words": _WORDS, "no_unit_space": "regexp_replace(name, '(?i)([0-9]) (mm|cm|kg|ml|gb|g|w|v)\\b', '\\1\\2', 'g')", "decimal_comma": "regexp_replace(name, '([0-9])\\.([0-9])', '\\1,\\2', 'g')",
    "no_hash": "replace(name, '#', '# ')", "hyphen_space": "regexp_replace(name, '(\\w)-(\\w)', '\\1 \\2', 'g')",
}


@query("i13_surface_positives", "select id, transform, name as original, changed from (select *, row_number() over (partition by id order by md5(concat('s:', id, ':', transform)), transform) as r from (" + " union all ".join(f"select id, name, '{t}' as transform, {e} as changed from items" for t, e in _SURFACE.items()) + ") where changed <> name) where r <= 2")
def i13(spark, d):
    return ge.surface_positives(v.items(spark, d), "s", 2)


@query("i16_fact_overlap", "select id1, id2, (select count(*) from matches o where o.id1 % 5 = 0 and m.id1 in (o.id1, o.id2)) > 0 or (select count(*) from matches o where o.id1 % 5 = 0 and m.id2 in (o.id1, o.id2)) > 0 as overlap from matches m")
def i16(spark, d):
    """Whether either card of a pair is in the frozen fifth."""
    m = v.matches(spark, d)
    frozen = pr.endpoints(m.filter("id1 % 5 = 0")).select(F.col("id").alias("fact"))
    return ge.mark_overlap(m, frozen, ["id1", "id2"], "overlap").select("id1", "id2", "overlap")


@query("i17_signature_caps", "select id1, id2 from (select *, row_number() over (partition by category, target, cast(round(score * 5) as bigint) order by md5(concat(id1, ':', id2)), id1, id2) as r from predictions) where r <= 3")
def i17(spark, d):
    from ..operators import audit as au

    p = v.predictions(spark, d).withColumn("level", F.round(F.col("score") * 5).cast("long"))
    return au.capped(p, ["category", "target", "level"], 3, [F.md5(F.concat_ws(":", "id1", "id2").cast("binary")), "id1", "id2"]).select("id1", "id2")


AUDITED = f"{FACTS}, ap as (select distinct pair_id, id1, id2, label as target, category from facts), sg as (select pair_id, string_agg(distinct concept, '+' order by concept) as s, count(*) as k from facts group by 1), sn as (select a.category, g.s, count(*) as n from sg g join ap a using (pair_id) group by 1, 2), us as (select concept, count(*) as n from facts group by 1), en as (select id, count(*) as n from (select unnest([id1, id2]) as id from ap) group by 1)"


@query("i18_pair_audit", " union all ".join(f"select '{m}' as measure, round(({e})::double, 6) as value" for m, e in {
    "pairs": "select count(*) from ap", "positives": "select sum(target) from ap", "self_pairs": "0", "most_rules": "select max(k) from sg", "mean_rules": "select avg(k) from sg", "rules": "select count(*) from us", "least_use": "select min(n) from us", "most_use": "select max(n) from us",
    "signatures": "select count(*) from sn", "repeated_signatures": "select count(*) from sn where n > 1", "missing_items": "0", "reused_items": "select count(*) from en where n > 1", "repeated_pairs": "0", "pairs_without_rules": "0",
}.items()), AUDITED)
def i18(spark, d):
    rows = facts(spark, d)
    pairs = rows.select("pair_id", "id1", "id2", F.col("label").alias("target"), "category").distinct()
    return ge.pair_audit(pairs, rows.select("pair_id", F.col("concept").alias("rule_id")), v.items(spark, d))


@query("i19_sanitised_facts", """select pair_id, concept, source, confidence, case when concept = 'storage' then 'unknown_concept' when id1 % 7 = 0 then 'unknown_relation' when id1 % 9 = 1 then 'confidence_out_of_range' when row_number() over (partition by pair_id, concept, concept <> 'storage' and id1 % 7 <> 0 and id1 % 9 <> 1 order by case source when 'attribute' then 0 else 1 end, confidence desc, va, vb) > 1 then 'duplicate_concept' end as drop_reason from raw""",
       f"{FACTS}, raw as (select *, 'attribute' as source, case when id1 % 9 = 1 then 1.5 else 0.5 end::double as confidence from facts union all select *, 'title', case when id1 % 9 = 1 then 1.5 else 0.9 end from facts)")
def i19(spark, d):
    rows = facts(spark, d).withColumn("relation", F.when(F.col("id1") % 7 == 0, "odd").otherwise(F.col("relation")))
    both = [rows.withColumn("source", F.lit(s)).withColumn("confidence", F.when(F.col("id1") % 9 == 1, 1.5).otherwise(c)) for s, c in (("attribute", 0.5), ("title", 0.9))]
    out = ge.sanitised_facts(both[0].unionByName(both[1]), ["brand", "size", "model"], ["different_value", "same"])
    return out.select("pair_id", "concept", "source", "confidence", "drop_reason")


# digests and shrinkage


@query("k4_a37_key_digest", "select count(*) as n, sha256(concat_ws(':', count(*), sum(h1), sum(h2))) as digest from (select ('0x' || substr(md5(concat(id1, '|', id2)), 1, 15))::hugeint as h1, ('0x' || substr(md5(concat(id1, '|', id2)), 17, 15))::hugeint as h2 from matches)")
def k4(spark, d):
    return fi.key_digest(v.matches(spark, d), ["id1", "id2"])


@query("m23_shrunk_effects", """select category, round(effect, 9) as effect, round(c + tau / (tau + var) * (effect - c), 9) as shrunk from eff, (select swx / sw as c, greatest(0, coalesce((swx2 - swx * swx / sw - (k - 1)) / nullif(sw - sw2 / sw, 0), 0)) as tau from (select sum(1 / var) as sw, sum(1 / var / var) as sw2, sum(effect / var) as swx, sum(effect * effect / var) as swx2, count(*) as k from eff))""", "eff as (select category, avg(target) as effect, var_samp(target) / count(*) as var from predictions group by category)")
def m23(spark, d):
    e = v.predictions(spark, d).groupBy("category").agg(F.avg("target").alias("effect"), (F.var_samp("target") / F.count(F.lit(1))).alias("var"))
    return ru.shrunk_effects(e, "effect", "var", "category").select("category", F.round("effect", 9).alias("effect"), F.round("shrunk", 9).alias("shrunk"))
