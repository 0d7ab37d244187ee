"""Queries of metric bundles, slices, prevalence, agreement, rule statistics and resampling."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import features as fe, graph as gr, metrics as me, ranking as rk, replicates as rp, rules as ru
from ..sources import views as v
from . import evaluation as ev, features as fp
from .base import query
from .policies import Z

LOSS = "-({y} * ln(least(greatest({s}, 1e-7), 1 - 1e-7)) + (1 - {y}) * ln(1 - least(greatest({s}, 1e-7), 1 - 1e-7)))"


def curve_sql(name: str, source: str, keys: str, score: str = "score", weight: str = "1.0::double") -> str:
    return f"""{name}_p as (select {keys}, {score} as pt, sum({weight})::double as w, sum({weight} * target)::double as p from {source} group by {keys}, {score}),
{name} as (select *, sum(w) over (partition by {keys} order by pt desc) as cw, sum(p) over (partition by {keys} order by pt desc) as cp, sum(w) over (partition by {keys}) as tw, sum(p) over (partition by {keys}) as tp from {name}_p)"""


AP, AUC = "sum(p * cp / cw) / nullif(max(tp), 0)", "sum((w - p) * (cp - p / 2)) / nullif(max(tp * (tw - tp)), 0)"


@query("m5_recall_at_precision", "select category, round(coalesce(max(cp / tp) filter (where cp / cw >= 0.6), 0), 6) as recall, arg_max(pt, (cp / tp, -pt)) filter (where cp / cw >= 0.6) as threshold from curve group by category", ev.CURVE)
def m5(spark, d):
    """The greatest recall and the lowest threshold that reaches it."""
    out = me.recall_at_precision(v.predictions(spark, d), ["category"], 0.6)
    return out.select("category", F.round("recall", 6).alias("recall"), "threshold")


@query("m6_m8_quality_bundle", f"""select p.category, round(avg((score - target) * (score - target)), 6) as brier, round(avg(((score >= 0.5)::int = target)::int), 6) as accuracy, round(2 * sum((score >= 0.5 and target = 1)::int) / (sum((score >= 0.5)::int) + sum(target))::double, 6) as f1,
  round(avg({LOSS.format(y='target', s='score')}), 6) as log_loss, max(auc) as auc, max(recall) as recall from predictions p join (select category, round({AUC}, 6) as auc, round(coalesce(max(cp / tp) filter (where cp / cw >= 0.6), 0), 6) as recall from curve group by category) c on c.category = p.category group by p.category""", ev.CURVE)
def m6_m8(spark, d):
    p = v.predictions(spark, d)
    s, y = F.col("score"), F.col("target")
    hit = (s >= 0.5) & (y == 1)
    sums = p.groupBy("category").agg(F.avg((s - y) * (s - y)).alias("brier"), F.avg(((s >= 0.5).cast("int") == y).cast("int")).alias("accuracy"), (2 * F.count_if(hit) / (F.count_if(s >= 0.5) + F.sum(y))).alias("f1"), F.avg(nm.log_loss(y, s)).alias("log_loss"))
    out = sums.join(me.roc_auc(p, ["category"]), "category").join(me.recall_at_precision(p, ["category"], 0.6), "category")
    return out.select("category", *(F.round(c, 6).alias(c) for c in ("brier", "accuracy", "f1", "log_loss", "auc", "recall")))


ELIGIBLE = f"el as (select p.*, p.category as c from predictions p where p.target = 0 or p.category <> 'PROMO'), {curve_sql('ec', 'el', 'category')}, {curve_sql('eo', '(select *, 1 as one from el)', 'one')}"


@query("m9_eligible_macro_metrics", f"""select * from (select count(ap) as eligible_categories, round(avg(ap), 6) as macro_ap, round(avg(auc), 6) as macro_auc from (select {AP} as ap, {AUC} as auc from ec group by category having max(tp) > 0 and max(tw - tp) > 0)),
  (select round({AP}, 6) as overall_ap, round({AUC}, 6) as overall_auc from eo), (select round(avg((score < 0.5)::int) filter (where target = 1), 6) as fnr, round(avg((score >= 0.5)::int) filter (where target = 0), 6) as fpr, round(avg(score) filter (where target = 1), 6) as positive_mean, round(avg(score) filter (where target = 0), 6) as negative_mean from el)""", ELIGIBLE)
def m9(spark, d):
    """One category is left without positives, and so isn't eligible."""
    p = v.predictions(spark, d).filter("target = 0 or category <> 'PROMO'")
    out = me.eligible_metrics(p)
    return out.select("eligible_categories", *(F.round(c, 6).alias(c) for c in out.columns if c != "eligible_categories"))


# slices: name, condition-free expression in Spark over predictions joined with typed features, and the same in SQL


def _bin(column: str, edges: list[float], labels: list[str]):
    """A left-closed binning of a column, in both languages."""
    def spark():
        steps = reduce(lambda c, x: c.when(F.col(column) < x[0], x[1]), list(zip(edges[1:], labels[1:])), F.when(F.col(column) < edges[0], labels[0]))
        return steps.otherwise(labels[-1])

    return spark, "case " + " ".join(f"when {{{column}}} < {e} then '{n}'" for e, n in zip(edges, labels)) + f" else '{labels[-1]}' end"


def _state(prefix: str):
    s = lambda k: F.col(f"{prefix}_{k}") > 0.5
    sql = lambda k: f"{{{prefix}_{k}}} > 0.5"
    return lambda: F.when(s("match"), "match").when(s("conflict"), "conflict").when(s("one_missing"), "one_missing").otherwise("no_evidence"), f"case when {sql('match')} then 'match' when {sql('conflict')} then 'conflict' when {sql('one_missing')} then 'one_missing' else 'no_evidence' end"


def _count(kind: str):
    parts = [f"num_{f}_{kind}" for f in fe.NUMERIC_TYPES]

    def spark():
        total = reduce(lambda a, b: a + b, ((F.col(c) > 0.5).cast("int") for c in parts))
        return F.when(total == 0, "none").when(total == 1, "one").otherwise("multiple")

    sql = "(" + " + ".join(f"({{{c}}} > 0.5)::int" for c in parts) + ")"
    return spark, f"case when {sql} = 0 then 'none' when {sql} = 1 then 'one' else 'multiple' end"


SLICES = {
    "category": (lambda: F.col("category"), "{category}"), "label": (lambda: F.col("target").cast("string"), "{target}::varchar"),
    "score_bin": _bin("score", [0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.95], ["<.05", ".05-.10", ".10-.20", ".20-.40", ".40-.60", ".60-.80", ".80-.90", ".90-.95", ".95-1"]),
    "uncertainty": _bin("far", [0.05, 0.1, 0.2, 0.3, 0.4], ["very_uncertain", "uncertain", "mid", "confident", "very_confident", "extreme"]),
    "disagreement": _bin("gap", [0.1, 0.3, 0.5], ["agree", "near", "apart", "opposed"]),
    "title_similarity": _bin("title_token_jaccard", [0.2, 0.4, 0.6, 0.8, 1.0], ["very_low", "low", "medium", "high", "near_exact", "exact"]),
    "title_exact": (lambda: F.when(F.col("title_exact") > 0.5, "exact").otherwise("not_exact"), "case when {title_exact} > 0.5 then 'exact' else 'not_exact' end"),
    **{name: _state(prefix) for name, prefix in (("brand_state", "brand"), ("model_attribute_state", "model_code"), ("title_code_state", "title_code"), ("color_state", "color"), ("material_state", "material"))},
    **{f"numeric_{f}_state": _state(f"num_{f}") for f in fe.NUMERIC_TYPES},
    **{f"numeric_{k}_count": _count(k) for k in ("conflict", "match", "one_missing")},
    "numeric_primary_conflict": (lambda: F.col("primary_conflict_type"), "{primary_conflict_type}"), "matching_regime": (lambda: F.col("matching_regime"), "{matching_regime}"),
    "attribute_key_overlap": _bin("attribute_key_jaccard", [0.01, 0.1, 0.25, 0.5, 0.75], ["none", "tiny", "low", "medium", "high", "very_high"]),
    "attribute_agreement": (lambda: F.when(F.col("attribute_common_keys") <= 0, "no_common_keys").when(F.col("attribute_exact_ratio") >= 0.8, "mostly_exact").when(F.col("attribute_conflict_ratio") >= 0.8, "mostly_conflict").otherwise("mixed"), "case when {attribute_common_keys} <= 0 then 'no_common_keys' when {attribute_exact_ratio} >= 0.8 then 'mostly_exact' when {attribute_conflict_ratio} >= 0.8 then 'mostly_conflict' else 'mixed' end"),
    "attribute_count": _bin("most_keys", [1, 3, 5], ["zero", "1-2", "3-4", "5+"]), "missing_keys": _bin("missing_keys", [1, 2, 3], ["none", "one", "two", "more"]),
    "title_length": _bin("title_length_delta", [1, 5, 15], ["same", "close", "apart", "far"]), "numbers": _bin("title_number_overlap", [1, 2], ["none", "one", "more"]),
}
_COLUMNS = {c.rsplit(" as ", 1)[1]: c.rsplit(" as ", 1)[0] for c in fp.TYPED_SQL}
SLICE_CTES = f"""{fp.RICH}, {fp.TYPED}, judged as (select m.*, abs(m.score - 0.5) as far, abs(m.score - m.score_b) as gap, {', '.join(f'{b} as {n}' for n, b in _COLUMNS.items())} from predictions m join typed a on a.id = m.id1 join typed b on b.id = m.id2),
wide as (select *, greatest(attribute_count_a, attribute_count_b) as most_keys, attribute_missing_a + attribute_missing_b as missing_keys from judged),
sliced as (select * exclude (kinds, vals), unnest(kinds) as slice_type, unnest(vals) as slice_value from (select id1, id2, category, target, score, score_b, [{', '.join(f"'{n}'" for n in SLICES)}] as kinds,
  [{', '.join('(' + reduce(lambda t, c: t.replace('{' + c + '}', c), [*_COLUMNS, 'category', 'target', 'score', 'far', 'gap', 'most_keys', 'missing_keys'], sql) + ')::varchar' for _, sql in SLICES.values())}] as vals from wide)),
{curve_sql('sa', 'sliced', 'slice_type, slice_value, category')}, {curve_sql('sb', 'sliced', 'slice_type, slice_value, category', 'score_b')}"""
SLICE_SQL = f"""select s.slice_type, s.slice_value, s.n, s.corrected, s.regressed, round((s.corrected - s.regressed) / s.n::double, 9) as net_rate, round(s.logloss_gain, 9) as logloss_gain, round(s.mae_gain, 9) as mae_gain, round(y.ap - x.ap, 9) as macro_ap_delta from (
  select slice_type, slice_value, count(*) as n, sum(((score >= 0.5)::int <> target and (score_b >= 0.5)::int = target)::int)::bigint as corrected, sum(((score >= 0.5)::int = target and (score_b >= 0.5)::int <> target)::int)::bigint as regressed,
    avg({LOSS.format(y='target', s='score')} - {LOSS.format(y='target', s='score_b')}) as logloss_gain, avg(abs(score - target) - abs(score_b - target)) as mae_gain from sliced group by 1, 2 having count(*) >= 5) s
  left join (select slice_type, slice_value, avg(ap) as ap from (select slice_type, slice_value, {AP} as ap from sa group by slice_type, slice_value, category) group by 1, 2) x using (slice_type, slice_value)
  left join (select slice_type, slice_value, avg(ap) as ap from (select slice_type, slice_value, {AP} as ap from sb group by slice_type, slice_value, category) group by 1, 2) y using (slice_type, slice_value)"""


def _sliced(spark, d) -> DataFrame:
    """Pairs unpivoted to the slices that they are in. The slices are found once and written; the metrics read them several
    times."""
    pairs = v.predictions(spark, d)
    typed = fe.typed_native(pairs, fp.rich_items(spark, d), fp.RULES, fp.REGIMES)
    wide = typed.withColumn("far", F.abs(F.col("score") - 0.5)).withColumn("gap", F.abs(F.col("score") - F.col("score_b")))
    wide = wide.withColumn("most_keys", F.greatest("attribute_count_a", "attribute_count_b")).withColumn("missing_keys", F.col("attribute_missing_a") + F.col("attribute_missing_b"))
    found = gr.cut(wide.select(*pairs.columns, F.array(*(e().cast("string") for e, _ in SLICES.values())).alias("__values")))
    names = F.array(*map(F.lit, SLICES))
    kinds = F.transform("__values", lambda value, i: F.struct(F.get(names, i).alias("slice_type"), value.alias("slice_value")))
    return found.select(*pairs.columns, F.explode(kinds).alias("s")).select(*pairs.columns, "s.*")


@query("p7_m10_slice_metrics", SLICE_SQL, SLICE_CTES)
def m10(spark, d):
    out = me.slice_metrics(_sliced(spark, d), ["slice_type", "slice_value"], "score", "score_b", 5)
    return out.select("slice_type", "slice_value", "n", "corrected", "regressed", *(F.round(c, 9).alias(c) for c in ("net_rate", "logloss_gain", "mae_gain", "macro_ap_delta")))


_GAIN = "select slice_type, slice_value, id1 % 3 as split, count(*) as n, avg(abs(score - target) - abs(score_b - target)) as mae, avg({l}) as ll, (sum(((score >= 0.5)::int <> target and (score_b >= 0.5)::int = target)::int) - sum(((score >= 0.5)::int = target and (score_b >= 0.5)::int <> target)::int)) / count(*)::double as net from sliced group by 1, 2, 3".format(l=LOSS.format(y="target", s="score") + " - " + LOSS.format(y="target", s="score_b"))
STABLE = f"{SLICE_CTES}, {curve_sql('ta', '(select *, id1 % 3 as split from sliced)', 'slice_type, slice_value, split, category')}, {curve_sql('tb', '(select *, id1 % 3 as split from sliced)', 'slice_type, slice_value, split, category', 'score_b')}, aps as (select slice_type, slice_value, split, avg(b) - avg(a) as delta from (select slice_type, slice_value, split, category, {AP} as a from ta group by 1, 2, 3, 4) join (select slice_type, slice_value, split, category, {AP} as b from tb group by 1, 2, 3, 4) using (slice_type, slice_value, split, category) group by 1, 2, 3), parts as (select g.*, coalesce(n >= 5 and ll > 0 and mae > 0 and net >= 0 and (delta is null or delta > 0), false) as better from ({_GAIN}) g left join aps using (slice_type, slice_value, split))"


@query("m11_stable_slices", "select slice_type, slice_value, coalesce(bool_or(better) filter (where split = 0), false) as iid_better, coalesce(bool_or(better) filter (where split = 1), false) as hard_better, coalesce(bool_or(better) filter (where split = 2), false) as ood_better, coalesce(bool_or(better) filter (where split = 0), false) and coalesce(bool_or(better) filter (where split = 1), false) and slice_type <> 'category' as production_candidate, round(least(max(ll) filter (where split = 0), max(ll) filter (where split = 1)), 6) as least_gain from parts group by 1, 2", STABLE)
def m11(spark, d):
    """Slices where the second model is better on each of three splits (present in any of them)."""
    rows = _sliced(spark, d).withColumn("split", F.col("id1") % 3)
    s = me.slice_metrics(rows, ["slice_type", "slice_value", "split"], "score", "score_b", 1)
    out = me.stable_slices(s, ["slice_type", "slice_value"], {"iid": 0, "hard": 1, "ood": 2}, 5)
    return out.select("slice_type", "slice_value", "iid_better", "hard_better", "ood_better", (F.col("stable") & (F.col("slice_type") != "category")).alias("production_candidate"), F.round("least_gain", 6).alias("least_gain"))


PREVALENCE = f"tot as (select sum(target)::double as p, sum(1 - target)::double as n from predictions), wp as (select pr, predictions.*, case when target = 1 then 1.0::double else p * (1 - pr) / (pr * n) end as wt from predictions, tot, (select unnest([0.05, 0.1, 0.2, 0.5])::double as pr)), {curve_sql('pc', 'wp', 'pr, category', weight='wt')}"


@query("m12_prevalence_sweep", f"select pr as prevalence, round(avg(ap), 6) as macro_ap, round(avg(auc), 6) as macro_auc from (select pr, category, {AP} as ap, {AUC} as auc from pc group by 1, 2) group by 1", PREVALENCE)
def m12(spark, d):
    out = me.prevalence_sweep(v.predictions(spark, d), [0.05, 0.1, 0.2, 0.5])
    return out.select("prevalence", F.round("macro_ap", 6).alias("macro_ap"), F.round("macro_auc", 6).alias("macro_auc"))


PRIORS = f"pri as (select category, avg(score_b) as prior, avg(target) as own from predictions group by category), wq as (select p.*, case when target = 1 then 1.0::double else own * (1 - prior) / (prior * (1 - own)) end as wt from predictions p join pri using (category)), {curve_sql('qc', 'wq', 'category', weight='wt')}"


@query("m15_category_priors", f"select q.category, round(max(own), 6) as own_prevalence, round(max(prior), 6) as prior, round(max(own * (1 - prior) / (prior * (1 - own))), 6) as negative_weight, round({AP}, 6) as weighted_ap, round({AUC}, 6) as weighted_auc from qc q join pri on pri.category = q.category group by q.category", PRIORS)
def m15(spark, d):
    """The second model's mean score is each category's prior."""
    p = v.predictions(spark, d)
    priors = p.groupBy("category").agg(F.avg("score_b").alias("prior"))
    return me.with_priors(p, priors).select("category", *(F.round(c, 6).alias(c) for c in ("own_prevalence", "prior", "negative_weight", "weighted_ap", "weighted_auc")))


MODELS = ("score", "score_b", "score_c")
_PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]]


@query("a27_model_agreement", " union all ".join(f"select '{a}' as model_a, '{b}' as model_b, sum((({a} >= 0.5)::int = target and ({b} >= 0.5)::int = target)::int)::bigint as both_right, sum((({a} >= 0.5)::int <> target and ({b} >= 0.5)::int <> target)::int)::bigint as both_wrong, sum((({a} >= 0.5) <> ({b} >= 0.5))::int)::bigint as disagree, round(avg((({a} >= 0.5)::int = target or ({b} >= 0.5)::int = target)::int), 6) as oracle_accuracy from predictions" for a, b in _PAIRS))
def a27(spark, d):
    return me.agreement(v.predictions(spark, d), list(MODELS)).withColumn("oracle_accuracy", F.round("oracle_accuracy", 6))


_RANK = "(rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0::double)"


@query("m28_score_diagnostics", f"select round(corr(score, score_b), 6) as pearson, round(corr(ra, rb), 6) as spearman, round(avg(abs(score - score_b)), 6) as mean_gap, round(max(abs(score - score_b)), 6) as max_gap from (select *, {_RANK.format('score')} as ra, {_RANK.format('score_b')} as rb from predictions)")
def m28(spark, d):
    p = rk.average_rank(rk.average_rank(v.predictions(spark, d), "score", "ra"), "score_b", "rb")
    gap = F.abs(F.col("score") - F.col("score_b"))
    return p.agg(*(F.round(x, 6).alias(n) for n, x in (("pearson", F.corr("score", "score_b")), ("spearman", F.corr("ra", "rb")), ("mean_gap", F.avg(gap)), ("max_gap", F.max(gap)))))


_COMBOS = [c for r in (1, 2, 3) for c in itertools.combinations(MODELS, r)]
_GRID = ", ".join(f"{{'combo': '{'+'.join(c)}', 'agg': '{k}', 's': " + ("(" + " + ".join(c) + f") / {len(c)}" if k == "mean" else f"greatest({', '.join(c)})" if len(c) > 1 else c[0]) + "}" for c in _COMBOS for k in ("mean", "max"))


@query("m27_ensemble_grid", f"select split, combo, agg, round(avg(ap), 6) as macro_ap from (select split, combo, agg, category, {AP} as ap from gc group by 1, 2, 3, 4) group by 1, 2, 3", f"grid as (select category, target, id1 % 3 as split, unnest([{_GRID}]) as g from predictions), {curve_sql('gc', '(select category, target, split, g.combo as combo, g.agg as agg, round(g.s, 9) as s from grid)', 'split, combo, agg, category', 's')}")
def m27(spark, d):
    p = v.predictions(spark, d).withColumn("split", F.col("id1") % 3)
    return me.ensemble_grid(p, list(MODELS), ["split"]).withColumn("macro_ap", F.round("macro_ap", 6))


_W = f"(({{k}} / n::double) + {Z} * {Z} / (2 * n) {{sign}} {Z} * sqrt((({{k}} / n::double) * (1 - {{k}} / n::double) + {Z} * {Z} / (4 * n)) / n)) / (1 + {Z} * {Z} / n)"
RULE_SQL = f"""select rule, n as support, k as positives, round(k / n::double, 6) as rate, round(bk / bn::double, 6) as baseline, round(greatest(0, {_W.format(k='k', sign='-')}), 6) as lower, round(least(1, {_W.format(k='k', sign='+')}), 6) as upper, round(p, 9) as p_value,
  round(least(1, min(p * (select count(*) from tested) / r) over (order by p desc, rule desc rows unbounded preceding)), 9) as q_value from (select *, row_number() over (order by p, rule) as r from tested)"""
_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
TESTED = f"""counted as (select rule, count(*) as n, sum(target)::bigint as k from occ group by rule), base as (select count(*) as bn, sum(target)::bigint as bk from (select distinct id1, id2, target from occ)),
tested as (select rule, max(n) as n, max(k) as k, max(bn) as bn, max(bk) as bk, least(1, sum(exp({_CHOOSE.format('bk', 'x')} + {_CHOOSE.format('(bn - bk)', '(n - x)')} - ({_CHOOSE.format('bn', 'n')})))) as p
  from (select c.*, b.*, unnest(range(k, least(n, bk) + 1)) as x from counted c, base b) where n - x <= bn - bk group by rule)"""


@query("r2_rule_table", RULE_SQL, f"{ev.OCC}, {TESTED}")
def r2(spark, d):
    """Support, rate, Wilson bounds, Fisher's one-sided p against all other pairs, and its q-value."""
    out = ru.rule_table(ev.occurrences(spark, d))
    return out.select("rule", "support", "positives", *(F.round(c, 6).alias(c) for c in ("rate", "baseline", "lower", "upper")), F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"))


@query("m21_fisher_exact", "select rule, n as support, k as positives, round(p, 9) as p_value from tested", f"{ev.OCC}, {TESTED}")
def m21(spark, d):
    out = ru.rule_table(ev.occurrences(spark, d))
    return out.select("rule", "support", "positives", F.round("p_value", 9).alias("p_value"))


# resampling: draws differ from any oracle's; tests hold these against statistics that are known


@query("m14_resampled_negatives")
def m14(spark, d):
    out = rp.resampled_negatives(v.predictions(spark, d), 0.1, 30)
    return out.select(*(F.round(c, 9).alias(c) for c in ("mean", "spread", "weighted")), "repeats")


@query("m16_permutation_test")
def m16(spark, d):
    pairs = gr.pair_components(v.predictions(spark, d))
    return rp.permutation_test(pairs, "score", "score_b", 2000).select(F.round("observed", 9).alias("observed"), "p_value")


@query("m17_component_bootstrap")
def m17(spark, d):
    pairs = gr.pair_components(v.predictions(spark, d))
    return rp.bootstrap(pairs, "score", "score_b", "component_id", ["category"], 2000)


@query("m18_paired_bootstrap")
def m18(spark, d):
    """Pairs drawn within category and label; then the categories' own differences drawn."""
    p = v.predictions(spark, d).withColumn("pair_id", F.xxhash64("id1", "id2"))
    one = rp.bootstrap(p, "score", "score_b", "pair_id", ["category", "target"], 500).select(F.lit("pairs").alias("kind"), "*")
    aps = me.average_precision(p, ["category"], score="score").join(me.average_precision(p, ["category"], score="score_b").withColumnRenamed("ap", "other"), "category")
    deltas = [r.delta for r in aps.select((F.col("ap") - F.col("other")).alias("delta")).filter("delta is not null").collect()]  # one a category
    two = rp.category_bootstrap(deltas, 2000)
    return one.unionByName(spark.createDataFrame([("categories", two["mean"], two["low"], two["median"], two["high"], two["positive_share"], two["replicates"])], one.schema))


@query("m22_effect_posteriors")
def m22(spark, d):
    occ = ev.occurrences(spark, d)
    base = occ.select("id1", "id2", "target").distinct().agg(F.sum("target").alias("bp"), F.sum(1 - F.col("target")).alias("bn"))
    rules = occ.groupBy("rule").agg(F.sum("target").alias("positive"), F.sum(1 - F.col("target")).alias("negative")).join(F.broadcast(base))  # one row
    return rp.beta_effects(rules.select("rule", "positive", "negative", (F.col("bp") - F.col("positive")).alias("baseline_positive"), (F.col("bn") - F.col("negative")).alias("baseline_negative")))
