"""Queries of risk-limited thresholds, routing, rule gates, vetoes and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import features as fe, policies as po, ranking as rk
from ..sources import views as v
from . import features as fp
from .base import query

Z = "1.959963984540054::double"


def ucb(e: str, n: str) -> str:
    """SQL of the upper Wilson bound of ``e`` errors in ``n`` rows."""
    p = f"({e} / ({n})::double)"
    return f"case when {n} > 0 then least(1, ({p} + {Z} * {Z} / (2 * {n}) + {Z} * sqrt(({p} * (1 - {p}) + {Z} * {Z} / (4 * {n})) / {n})) / (1 + {Z} * {Z} / {n})) else 1 end"


def states(name: str, source: str, score: str, error: str, order: str = "asc", keys: str = "") -> str:
    part = f"partition by {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""{name}_points as (select {lead}{score} as boundary, count(*) as n, sum({error}) as e from {source} group by {lead}{score}),
{name} as (select *, {ucb('errors', 'accepted')} as ucb from (select {lead}boundary, sum(n) over ({part}order by boundary {order})::bigint as accepted, sum(e) over ({part}order by boundary {order})::bigint as errors, sum(n) over ({f'partition by {keys}' if keys else ''}) as total from {name}_points))"""


LOW, HIGH = states("low", "predictions", "score", "target"), states("high", "predictions", "score", "1 - target", "desc")
_SIDE = "select '{0}' as side, boundary, nextafter(boundary, {1}::double) as threshold, accepted, errors, round(accepted / total::double, 6) as coverage, round(errors / accepted::double, 6) as risk, round(ucb, 6) as ucb from {0}"


@query("w7_threshold_states", _SIDE.format("low", "'infinity'") + " union all " + _SIDE.format("high", "'-infinity'") + " union all select unnest(['low', 'high']), null, unnest([0.0, 1.0]), 0, 0, 0, 0, 1", f"{LOW}, {HIGH}")
def w7(spark, d):
    """Both sides, each with its empty state; the strict threshold is the next number beyond the boundary."""
    p = v.predictions(spark, d).withColumn("miss", 1 - F.col("target"))
    out = None
    for side, error, edge in (("low", "target", 0.0), ("high", "miss", 1.0)):
        s = po.risk_states(p, "score", error, side)
        step = rk.next_after(F.col("boundary"), up=side == "low")
        s = s.select(F.lit(side).alias("side"), "boundary", step.alias("threshold"), "accepted", "errors", *(F.round(c, 6).alias(c) for c in ("coverage", "risk", "ucb")))
        none = spark.range(1).select(F.lit(side).alias("side"), F.lit(None).cast("double").alias("boundary"), F.lit(edge).alias("threshold"), *(F.lit(0).cast("long").alias(c) for c in ("accepted", "errors")), *(F.lit(x).alias(c) for c, x in (("coverage", 0.0), ("risk", 0.0), ("ucb", 1.0))))
        s = s.unionByName(none)
        out = s if out is None else out.unionByName(s)
    return out


_BEST = "select {l}::double as risk_limit, coalesce(max(accepted) filter (where ucb < {l}), 0)::bigint as accepted, coalesce(arg_max(errors, accepted) filter (where ucb < {l}), 0)::bigint as errors, arg_max(boundary, accepted) filter (where ucb < {l}) as boundary from low"


@query("w8_best_state", " union all ".join(_BEST.format(l=x) for x in (0.0001, 0.05, 0.1, 0.2)), LOW)
def w8(spark, d):
    """The longest tail whose Wilson bound is strictly below the limit, else the empty state (as at 0.0001)."""
    s = po.risk_states(v.predictions(spark, d), "score", "target")
    out = None
    for limit in (0.0001, 0.05, 0.1, 0.2):
        one = po.best_states(s, limit).select(F.lit(limit).alias("risk_limit"), "accepted", "errors", "boundary")
        out = one if out is None else out.unionByName(one)
    return out


@query("w9_longest_tail_per_error_count", "select errors, max(accepted) as accepted from low group by errors", LOW)
def w9(spark, d):
    return po.risk_states(v.predictions(spark, d), "score", "target").groupBy("errors").agg(F.max("accepted").alias("accepted"))


def _joint(first: str, second: str, limit: float, total: str) -> str:
    tail = "select errors, max(accepted) as accepted, arg_max(boundary, accepted) as boundary from (select errors, accepted, boundary from {0} union all select 0, 0, null) where errors <= ceil({1} * {2}) group by errors"
    return f"""select coalesce(max(a), 0)::bigint as accepted, coalesce(arg_max(e, r), 0)::bigint as errors, round(coalesce(arg_max(u, r), 1), 6) as ucb, coalesce(arg_max(fa, r), 0)::bigint as first_accepted, coalesce(arg_max(sa, r), 0)::bigint as second_accepted from (
  select *, (a, -e, -fe) as r from (select f.accepted + s.accepted as a, f.errors + s.errors as e, f.errors as fe, f.accepted as fa, s.accepted as sa, {ucb('(f.errors + s.errors)', '(f.accepted + s.accepted)')} as u
    from ({tail.format(first, limit, total)}) f join ({tail.format(second, limit, total)}) s on f.errors + s.errors <= ceil({limit} * {total})) where a > 0 and a <= {total} and u < {limit})"""


@query("w10_two_tails", _joint("low", "high", 0.05, "(select count(*) from predictions)"), f"{LOW}, {HIGH}")
def w10(spark, d):
    p = v.predictions(spark, d).withColumn("miss", 1 - F.col("target"))
    best = po.best_two_tails(po.risk_states(p, "score", "target"), po.risk_states(p, "score", "miss", "high"), 0.05, p.count())
    return best.select("accepted", "errors", F.round("ucb", 6).alias("ucb"), "first_accepted", "second_accepted")


FOLDED = "folded as (select *, id1 % 3 as fold from predictions)"
HELD = f"""{FOLDED}, rest as (select h.held, f.* from folded f join (select distinct fold as held from folded) h on f.fold <> h.held),
{states('sg', 'rest', 'score', 'target', keys='held')}, {states('sc', 'rest', 'score', 'target', keys='held, category')}"""


@query("r11_cross_fit_routing", """select f.id1, f.id2, coalesce(f.score <= g.b, false) as routed, coalesce(f.score <= c.b, false) as routed_by_category from folded f
  left join (select held, arg_max(boundary, accepted) as b from sg where ucb < 0.1 group by held) g on g.held = f.fold
  left join (select held, category, arg_max(boundary, accepted) as b from sc where ucb < 0.2 group by held, category) c on c.held = f.fold and c.category = f.category""", HELD)
def r11(spark, d):
    p = v.predictions(spark, d).withColumn("fold", F.col("id1") % 3)
    one = po.cross_fit_routing(p, "score", "target", "fold", 0.1)
    two = po.cross_fit_routing(p, "score", "target", "fold", 0.2, ("category",)).select("id1", "id2", F.col("routed").alias("routed_by_category"))
    return one.join(two, ["id1", "id2"]).select("id1", "id2", "routed", "routed_by_category")


CLASSES = "classes as (select *, id1 % 3 as fold, (score >= 0.5)::int as positive, 1 - 2 * abs(score - 0.5) as doubt, ((score >= 0.5)::int <> target)::int as wrong from predictions)"
_TWO = ", ".join(
    f"{states(f'neg{k}', f'(select * from classes where fold <> {k} and positive = 0)', 'doubt', 'wrong')}, {states(f'pos{k}', f'(select * from classes where fold <> {k} and positive = 1)', 'doubt', 'wrong')}"
    for k in range(3)
)
_LIMIT = "least(0.25)"


def _two_classes() -> str:
    rows = []
    for k in range(3):
        best = _joint(f"neg{k}", f"pos{k}", 0.25, f"(select count(*) from classes where fold <> {k})").replace("coalesce(arg_max(fa, r), 0)::bigint as first_accepted, coalesce(arg_max(sa, r), 0)::bigint as second_accepted", "arg_max(fb, r) as fb, arg_max(sb, r) as sb")
        best = best.replace("s.accepted as sa,", "s.accepted as sa, f.boundary as fb, s.boundary as sb,")
        rows.append(f"select {k} as fold, fb, sb from ({best})")
    return f"select c.id1, c.id2, coalesce(doubt <= case when positive = 0 then fb else sb end, false) as routed from classes c join ({' union all '.join(rows)}) b on b.fold = c.fold"


@query("r11_two_class_routing", _two_classes(), f"{CLASSES}, {_TWO}")
def r11_two(spark, d):
    s = F.col("score")
    p = v.predictions(spark, d).withColumn("fold", F.col("id1") % 3).withColumn("positive", (s >= 0.5).cast("int")).withColumn("doubt", 1 - 2 * F.abs(s - 0.5))
    p = p.withColumn("wrong", (F.col("positive") != F.col("target")).cast("int"))
    return po.cross_fit_two_classes(p, "doubt", "wrong", "positive", "fold", 0.25).select("id1", "id2", "routed")


# gates: the oracle finds them from the typed features, the score standing for the titles' token-set similarity

_RULE = [f"case when ({fp._relation(fp._SQL_OF[c])}) = '{r}' then '{c}::{r}' end" for c, r in fp.RULES]
_FLAG = {n: fp._states(a, b, "x")[i].rsplit(" as ", 1)[0] for n, a, b, i in (
    ("brand_match", "a.brand", "b.brand", 1), ("model_match", "a.model", "b.model", 1), ("model_conflict", "a.model", "b.model", 2), ("code_match", "a.codes", "b.codes", 1), ("code_conflict", "a.codes", "b.codes", 2),
    ("color_conflict", "a.color", "b.color", 2), ("size_conflict", "a.t_size", "b.t_size", 2), *((f"{f}_conflict", f"a.t_{f}", f"b.t_{f}", 2) for f in ("ram_storage", "power", "optical", "voltage", "frequency", "capacity")),
)}
GATED = f"""{fp.RICH}, {fp.TYPED}, gated as (
  select m.id1, m.id2, m.score, m.score_b, m.target, a.category, list_filter([{', '.join(_RULE)}], lambda x: x is not null) as rules, a.title = b.title as exact,
    {', '.join(f'({x}) > 0.5 as {n}' for n, x in _FLAG.items())}, case a.category {' '.join(f"when '{c}' then '{r}'" for c, r in fp.REGIMES.items())} else 'unknown_mixed' end as regime
  from predictions m join typed a on a.id = m.id1 join typed b on b.id = m.id2),
kinds as (select *, len(list_filter(rules, lambda r: r = 'model_number::different_value')) as identifiers, len(list_filter(rules, lambda r: r = 'ram_storage::different_value')) as technologies,
    list_filter([case when brand_match then 'same_brand' end, case when model_match then 'same_model' end, case when code_match then 'same_title_code' end, case when score >= 0.85 then 'title_sim_085' end, case when score >= 0.95 then 'title_sim_095' end,
      case when exact then 'exact_title' end, case when code_conflict then 'title_code_confirms_conflict' end], lambda x: x is not null) as anchors from gated),
fired as (select id1, id2, score, target, unnest(list_concat(list_transform(rules, lambda r: concat('global::', r)), list_transform(rules, lambda r: concat('category::', category, '::', r)),
    flatten(list_transform(anchors, lambda a: list_transform(rules, lambda r: concat('anchor::', a, '::', r)))))) as gate from kinds),
judged as (select *, (exact or (score >= 0.95 and (model_match or code_match))) and not (model_conflict or code_conflict or ram_storage_conflict or power_conflict or optical_conflict or voltage_conflict or frequency_conflict or capacity_conflict) as strong,
    regime = 'variant_tolerant' and (size_conflict or color_conflict) and not (model_conflict or code_conflict or ram_storage_conflict or power_conflict or optical_conflict or voltage_conflict or frequency_conflict or capacity_conflict) as weak from gated)"""


def _gated(spark, d):
    pairs = v.predictions(spark, d).select("id1", "id2", "score", "score_b", "target")
    typed = fe.typed_native(pairs, fp.rich_items(spark, d), fp.RULES, fp.REGIMES)
    return po.with_gates(typed, F.col("score"))


@query("r7_candidate_gates", "select gate, count(*) as support, sum(target)::bigint as positives from fired group by gate", GATED)
def r7(spark, d):
    rows = _gated(spark, d).select("target", F.explode("gates").alias("gate"))
    return rows.groupBy("gate").agg(F.count(F.lit(1)).alias("support"), F.sum("target").alias("positives"))


@query("r7_compound_gates", "select * from (values ('compound::category::x::identifier_and_technology', 1), ('compound::category::x::optical_ge2', 2), ('compound::category::x::optical_ge3', 1), ('compound::category::x::pupillary_and_other_optical', 2), ('compound::category::x::technology_ge2', 1), ('compound::global::::identifier_and_technology', 1), ('compound::global::::optical_ge2', 2), ('compound::global::::optical_ge3', 1), ('compound::global::::pupillary_and_other_optical', 2), ('compound::global::::technology_ge2', 1)) as t(gate, n)")
def r7_compound(spark, d):
    """Compounds of concepts that the catalogue lacks, over rules given by hand."""
    d_ = "different_value"
    given = [["pupillary_distance|" + d_, "lens_width|" + d_], ["pupillary_distance|" + d_, "lens_width|" + d_, "frame|" + d_], ["sku|" + d_, "gpu|" + d_, "ssd|" + d_], ["lens_width|missing_one_side", "axis|" + d_]]
    names = ["brand_match", "model_code_match", "title_code_match", "title_exact", "title_code_conflict"]
    rows = spark.createDataFrame([(g, "x") for g in given], "fired_rules array<string>, category_of_items string").select("*", *(F.lit(0.0).alias(n) for n in names))
    gates = po.with_gates(rows, F.lit(0.0)).select(F.explode("gates").alias("gate")).filter(F.col("gate").startswith("compound"))
    return gates.groupBy("gate").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("r8_vetoes", "select id1, id2, coalesce(strong, false) as strong_identity, coalesce(strong or weak, false) as identity_plus_variant_tolerance from judged", GATED)
def r8(spark, d):
    masks = po.vetoes(F.col("score"))
    return _gated(spark, d).select("id1", "id2", *(F.coalesce(masks[n], F.lit(False)).alias(n) for n in ("strong_identity", "identity_plus_variant_tolerance")))


POLICY = [("anchor::same_brand::model_number::missing_one_side", 0.5), ("global::size::different_value", 0.4), ("global::brand::different_value", 0.6)]


@query("r10_applied_policy", "select k.id1, k.id2, case when coalesce(j.strong, false) then null when k.score < 0.2 then 'score_threshold' when list_contains(rules, 'model_number::missing_one_side') and list_contains(anchors, 'same_brand') and k.score < 0.5 then 'anchor::same_brand::model_number::missing_one_side' when list_contains(k.rules, 'size::different_value') and k.score < 0.4 then 'global::size::different_value' when list_contains(k.rules, 'brand::different_value') and k.score < 0.6 then 'global::brand::different_value' end as reason from kinds k join judged j on j.id1 = k.id1 and j.id2 = k.id2".replace("list_contains(rules", "list_contains(k.rules"), GATED)
def r10(spark, d):
    gated = _gated(spark, d)
    return po.apply_policy(gated, 0.2, F.coalesce(po.vetoes(F.col("score"))["strong_identity"], F.lit(False)), POLICY).select("id1", "id2", "reason")


@query("r9_gate_portfolio")
def r9(spark, d):
    """The chosen portfolio, and what it accepts of the rows that it was chosen on."""
    p = _gated(spark, d).withColumn("fold", F.col("id1") % 3)
    masks = po.vetoes(F.col("score"))
    p = p.select("id1", "id2", "score", "target", "fold", "gates", *(F.coalesce(m, F.lit(False)).alias(n) for n, m in masks.items()))
    found = po.select_portfolio(p, list(masks), 0.12, [0.3, 0.5], [0.5], 20, 3, 3)
    row = (found["veto"], found["threshold"], [f"{g} < {c}" for g, c in found["gates"]], found["accepted"], found["errors"], found["ucb"])
    return spark.createDataFrame([row], "veto string, threshold double, gates array<string>, accepted long, errors long, ucb double")


# blends and grids


RANKED = "ranked as (select *, (rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double) / count(*) over () as ra, (rank() over (order by score_b) + (count(*) over (partition by score_b) - 1) / 2.0::double) / count(*) over () as rb from predictions)"


@query("r22_r25_blends", """select r.id1, r.id2, round(0.6 * score + 0.4 * score_b, 6) as linear, round(0.6 * ra + 0.4 * rb, 6) as rank_blend, round(case when abs(score - score_b) > 0.3 then 0.5 * (score + score_b) else score end, 6) as gate_blend, round((score + score_b) / 2, 6) as two_way, round(abs(score - score_b), 6) as order_gap,
  round(1 / (1 + exp(-(0.6 * ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))) + 0.4 * ln(least(greatest(score_b, 1e-6), 1 - 1e-6) / (1 - least(greatest(score_b, 1e-6), 1 - 1e-6)))))), 6) as logit_blend,
  case when length(a.name) >= length(b.name) then r.id1 else r.id2 end as first_id from ranked r join items a on a.id = r.id1 join items b on b.id = r.id2""", RANKED)
def r22(spark, d):
    """Linear, logit, rank and gated blends; the mean and the gap of two orientations; which item goes first, the longer."""
    from ..operators import pairs as pr

    p = pr.hydrate(v.predictions(spark, d), v.items(spark, d), ("name",))
    p = rk.percent_rank_average(rk.percent_rank_average(p, "score", [], "ra"), "score_b", [], "rb")
    a, b = F.col("score"), F.col("score_b")
    out = {
        "linear": 0.6 * a + 0.4 * b, "logit_blend": nm.sigmoid(0.6 * nm.logit(a) + 0.4 * nm.logit(b)), "rank_blend": 0.6 * F.col("ra") + 0.4 * F.col("rb"),
        "gate_blend": F.when(F.abs(a - b) > 0.3, 0.5 * (a + b)).otherwise(a), "two_way": (a + b) / 2, "order_gap": F.abs(a - b),
    }
    return p.select("id1", "id2", *(F.round(x, 6).alias(c) for c, x in out.items()), F.when(F.length("name_1") >= F.length("name_2"), F.col("id1")).otherwise(F.col("id2")).alias("first_id"))
