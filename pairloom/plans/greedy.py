"""Queries of greedy selections. Their oracles walk the rows one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generation as ge, retrieval as rt, routing as ro, selection as sl
from ..sources import views as v
from . import base
from .base import query


def _oracle(name: str, body: str, ctes: str) -> None:
    base.ORACLES[name] = f"with recursive {base.views.SQL}, {ctes} {body}"


@query("j18_greedy_matching")
def j18(spark, d):
    return rt.greedy_matching(v.predictions(spark, d)).select("category", "id1", "id2", "score")


_oracle("j18_greedy_matching", "select o.category, o.id1, o.id2, o.score from walk w join ordered o using (i) where w.took", """ordered as (select *, row_number() over (order by score desc, id1, id2) as i from predictions),
walk(i, took, used) as (select 0::bigint, false, cast([] as bigint[]) union all
  select o.i, not (list_contains(w.used, o.id1) or list_contains(w.used, o.id2)), case when list_contains(w.used, o.id1) or list_contains(w.used, o.id2) then w.used else list_concat(w.used, [o.id1, o.id2]) end from walk w join ordered o on o.i = w.i + 1)""")


@query("w13_exclusive_allocation")
def w13(spark, d):
    return ro.exclusive_allocation(v.predictions(spark, d), 0.05)


_oracle("w13_exclusive_allocation", "select o.id1, o.id2, o.expert from walk w join ordered o using (i) where w.took", """gains as (select id1, id2, 'b' as expert, round(abs(score - target) - abs(score_b - target), 9) as gain from predictions union all select id1, id2, 'c', round(abs(score - target) - abs(score_c - target), 9) from predictions),
quota as (select floor(count(*) * 0.05 + 1e-12)::bigint as q from predictions), ordered as (select *, row_number() over (order by gain desc, expert, id1, id2) as i from gains where gain > 0),
walk(i, took, used, b, c) as (select 0::bigint, false, cast([] as varchar[]), (select q from quota), (select q from quota) union all
  select i, ok, case when ok then list_append(used, key) else used end, b - (ok and expert = 'b')::int, c - (ok and expert = 'c')::int from (
    select o.i, o.expert, w.used, w.b, w.c, concat(o.id1, ':', o.id2) as key, not list_contains(w.used, concat(o.id1, ':', o.id2)) and case o.expert when 'b' then w.b else w.c end > 0 as ok from walk w join ordered o on o.i = w.i + 1))""")


@query("r15_neighbour_suppression")
def r15(spark, d):
    m = v.matches(spark, d)
    near = m.select(F.col("id1").alias("a"), F.col("id2").alias("b")).union(m.select(F.col("id2").alias("a"), F.col("id1").alias("b")))
    rows = v.items(spark, d).select("category", "id", F.length("name").cast("double").alias("score"))
    return sl.suppress_neighbours(rows, near, "category", "id", "score").select("category", "id", "score")


_oracle("r15_neighbour_suppression", "select o.category, o.id, o.score from walk w join ordered o using (i) where w.took", """near as (select a, list(b) as bs from (select id1 as a, id2 as b from matches union select id2, id1 from matches) group by a),
ordered as (select i.category, i.id, length(i.name)::double as score, coalesce(n.bs, []) as bs, row_number() over (order by length(i.name) desc, i.id) as i from items i left join near n on n.a = i.id),
walk(i, took, shut) as (select 0::bigint, false, cast([] as bigint[]) union all select o.i, not list_contains(w.shut, o.id), case when list_contains(w.shut, o.id) then w.shut else list_concat(w.shut, o.bs) end from walk w join ordered o on o.i = w.i + 1)""")


CAPS = {"category": 6, "target": 14, "level": 5}


@query("i14_capped_selection")
def i14(spark, d):
    """Pairs by descending score, at most so many a category, label and score level, and each item once."""
    p = v.predictions(spark, d).withColumn("level", F.round(F.col("score_b") * 5).cast("long"))
    return ge.capped_selection(p, CAPS, ["id1", "id2"], [F.desc("score"), "id1", "id2"]).select("id1", "id2", "category", "target")


_oracle("i14_capped_selection", "select o.id1, o.id2, o.category, o.target from walk w join ordered o using (i) where w.took", """ordered as (select *, cast(round(score_b * 5) as bigint) as level, row_number() over (order by score desc, id1, id2) as i from predictions),
walk(i, took, keys) as (select 0::bigint, false, cast([] as varchar[]) union all select i, ok, case when ok then list_concat(keys, mine) else keys end from (
  select o.i, w.keys, [concat('c', o.category), concat('t', o.target), concat('l', o.level), concat('i', o.id1), concat('i', o.id2)] as mine, len(list_filter(w.keys, lambda k: k = concat('c', o.category))) < 6 and len(list_filter(w.keys, lambda k: k = concat('t', o.target))) < 14 and len(list_filter(w.keys, lambda k: k = concat('l', o.level))) < 5
    and not list_contains(w.keys, concat('i', o.id1)) and not list_contains(w.keys, concat('i', o.id2)) as ok from walk w join ordered o on o.i = w.i + 1))""")


@query("b19_alias_resolution")
def b19(spark, d):
    from ..operators import audit as au

    rows = v.read(spark, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("alias"), F.expr("cast(p_partkey div 2 as string)").alias("name"))
    return au.resolve_aliases(rows).select("alias", "name")


_oracle("b19_alias_resolution", "select alias, arg_max(name, depth) as name from follow group by alias", """step as (select p_partkey::varchar as alias, (p_partkey // 2)::varchar as name from part where p_partkey % 3 <> 0),
follow(alias, name, depth) as (select alias, name, 1 from step union all select f.alias, s.name, f.depth + 1 from follow f join step s on s.alias = f.name where s.name <> s.alias)""")
