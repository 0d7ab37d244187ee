"""Queries of the feature builders, over a catalogue with more units, codes and shapes of attributes than the plain one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx, units
from ..operators import attributes as at, features as fe, similarity as sim
from ..sources import views as v
from .base import query

UNITS = ("mm", "cm", "kg", "g", "ml", "gb", "w", "v")
REGIMES = {"PROMO": "variant_tolerant", "ECONOMY": "configuration_sensitive"}
RULES = [("brand", "different_value"), ("color", "specificity_difference"), ("model_number", "missing_one_side"), ("size", "different_value"), ("ram_storage", "different_value")]


def rich_items(spark, d):
    """Catalogue whose names hold units, slash specifications, codes and chains of sizes, and whose attributes are objects
    (some with a list as value), lists of records, empty, or broken."""
    part = v.read(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (k % 8 + 1).cast("int"))
    more = [F.when(k % 6 == 0, F.concat(F.lit(" "), size, F.lit("/512"))).otherwise(""), F.when(k % 4 == 1, F.concat(F.lit(" ab"), size, F.lit("-x7"))).otherwise(""), F.when(k % 9 == 2, F.lit(" 10x20 cm")).otherwise("")]
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), size, F.lit(" "), unit, *more)
    model = F.when(k % 3 == 0, F.concat(F.lit(', "Model": "mx-'), size, F.lit('"'))).otherwise("")
    storage = F.when(k % 5 < 2, F.concat(F.lit(', "storage": "'), size, F.lit(' gb"'))).otherwise("")
    color = F.when(k % 7 == 0, F.lit('["red", "Blue"]')).otherwise(F.concat(F.lit('"'), F.substring_index("p_name", " ", 1), F.lit('"')))
    bag = F.concat(F.lit('{"brand": "'), "p_brand", F.lit('", "size": "'), size, F.lit('"'), model, storage, F.lit(', "color": '), color, F.lit("}"))
    listed = F.concat(F.lit('[{"key": "brand", "value": "'), "p_brand", F.lit('"}, {"name": "Size", "value": ["'), size, F.lit('"]}, {"name": "none"}]'))
    text = F.when(k % 97 == 5, "not json").when(k % 11 == 3, "{}").when(k % 13 == 4, listed).otherwise(bag)
    return part.select(k.alias("id"), name.alias("name"), text.alias("attributes"), F.col("p_type").alias("category"))


# The oracle knows what the catalogue holds from the columns that it is made of, and so doesn't parse attributes.
RICH = f"""rich as (
  select p_partkey as id, p_type as category, lower(concat(p_name, ' ', p_brand, ' ', p_size, ' ', list_extract([{", ".join(f"'{u}'" for u in UNITS)}], cast(p_partkey % 8 + 1 as int)),
    case when p_partkey % 6 = 0 then concat(' ', p_size, '/512') else '' end, case when p_partkey % 4 = 1 then concat(' ab', p_size, '-x7') else '' end, case when p_partkey % 9 = 2 then ' 10x20 cm' else '' end)) as title,
    case when p_partkey % 97 = 5 or p_partkey % 11 = 3 then 0 when p_partkey % 13 = 4 then 1 else 2 end as kind, p_partkey % 3 = 0 as has_model, p_partkey % 5 < 2 as has_storage, p_partkey % 7 = 0 as two_colors,
    lower(p_brand) as brand, p_size::varchar as size, lower(split_part(p_name, ' ', 1)) as word from part),
bags as (
  select id, category, title, kind,
    case when kind > 0 then [brand] else [] end as brand, case when kind > 0 then [size] else [] end as size, case when kind = 2 and has_model then [concat('mx-', size)] else [] end as model,
    case when kind = 2 and has_storage then [concat(size, ' gb')] else [] end as storage, case when kind = 2 then (case when two_colors then ['blue', 'red'] else [word] end) else [] end as color,
    case when kind = 2 then list_concat([brand, size], case when has_model then [concat('mx-', size)] else [] end, case when has_storage then [concat(size, ' gb')] else [] end, [case when two_colors then '["red","blue"]' else word end]) else [] end as flat,
    regexp_extract_all(title, '[0-9a-z]+') as all_tokens, list_distinct(regexp_extract_all(title, '[0-9a-z]+')) as tokens,
    list_distinct(regexp_extract_all(title, '(?:^|[^a-z])([0-9]+(?:[.,][0-9]+)?)', 1)) as numbers,
    list_distinct(list_filter(regexp_extract_all(title, '[0-9a-z]+(?:[._/-][0-9a-z]+)*'), lambda x: length(x) >= 4 and regexp_matches(x, '[0-9]') and regexp_matches(x, '[a-z]'))) as codes from rich)"""

_LEAD = "(?:^|\\W)([0-9]+(?:[.,][0-9]+)?)\\s*(mm|cm|kg|g|ml|gb|w|v)\\b"
_FACTOR = "case u when 'mm' then 1.0 when 'cm' then 10.0 when 'kg' then {kg} when 'g' then {g} when 'gb' then {gb} else 1.0 end"


def _measured(text: str, kg: str, g: str, gb: str) -> str:
    """SQL of the (unit, value) list of a text's measures."""
    names = f"regexp_extract_all({text}, '{_LEAD}', 2)"
    values = f"regexp_extract_all({text}, '{_LEAD}', 1)"
    factor = _FACTOR.format(kg=kg, g=g, gb=gb).replace("case u", f"case {names}[i]")
    return f"list_transform(range(1, len({names}) + 1), lambda i: {{'u': {names}[i], 'v': round({values}[i]::double * ({factor})::double, 6)}})"


FAMILY_OF = {"length_mm": "'mm', 'cm'", "mass_mg": "'kg', 'g'", "volume_ml": "'ml'", "memory_mb": "'gb'", "power_w": "'w'", "voltage_v": "'v'"}


def inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def union(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


def both(a: str, b: str) -> str:
    return f"(len({a}) > 0 and len({b}) > 0)"


def disjoint(a: str, b: str) -> str:
    return f"({both(a, b)} and {inter(a, b)} = 0)"


def num(x: str) -> str:
    return f"({x})::int::double"


def joined(select: str, source: str, pairs: str = "matches") -> str:
    return f"select {select} from {pairs} m join {source} a on a.id = m.id1 join {source} b on b.id = m.id2"


# measures and attributes


@query("n1_measures", f"select id, f as family, v as value from (select distinct id, unnest(list_transform(ms, lambda x: case {' '.join(f'when x.u in ({us}) then {chr(39)}{f}{chr(39)}' for f, us in FAMILY_OF.items())} end)) as f, unnest(list_transform(ms, lambda x: x.v)) as v from measured)",
       f"{RICH}, measured as (select id, {_measured('title', '1e6', '1e3', '1024.0')} as ms from rich)")
def n1(spark, d):
    return rich_items(spark, d).select("id", F.explode(units.measures(F.col("name"))).alias("m")).select("id", "m.family", "m.value")


@query("t3_unit_aliases", "select id, concat(id::varchar, '.5 kg ', size, ' gb ', id::varchar, ' ml 3 cm') as text from rich", RICH)
def t3(spark, d):
    k = F.col("id").cast("string")
    raw = F.concat(k, F.lit(",5 Килограмма  "), F.regexp_extract("name", r"#[0-9]+ ([0-9]+)", 1), F.lit("ГБ "), k, F.lit(" миллилитров 3СМ"))
    return rich_items(spark, d).select("id", units.one_spelling(tx.fold(raw)).alias("text"))


@query("b2_b3_multi_valued_attributes", "select id, key, array_to_string(vs, '|') as vals from (select id, unnest(['brand', 'size', 'model', 'storage', 'color']) as key, unnest([brand, size, model, storage, color]) as vs from bags) where len(vs) > 0", RICH)
def b2_b3(spark, d):
    rows = rich_items(spark, d).select("id", F.explode(at.multi_entries(F.col("attributes"))).alias("e"))
    return rows.select("id", "e.key", F.array_join("e.values", "|").alias("vals"))


CONCEPT_KEYS = ["brand", "frame width", "country", "country count", "diagram", "lens power", "model name", "объем памяти", "вес", "sku", "page count", "power", "shoe size", "colour", "color", "price"]
CONCEPT_WANT = ["brand", "optical", None, "pack_count", "ram_storage", "optical", "model_number", "ram_storage", "weight", "model_number", "pack_count", "power", "size", None, "color", "money"]


@query("b10_key_concepts", "select * from (values " + ", ".join(f"('{k}', {'null' if c is None else chr(39) + c + chr(39)})" for k, c in zip(CONCEPT_KEYS, CONCEPT_WANT)) + ") as t(key, concept)")
def b10(spark, d):
    keys = spark.createDataFrame([(k,) for k in CONCEPT_KEYS], "key string")
    return keys.select("key", fe.concept_of(F.col("key"), {"price": "money"}).alias("concept"))


TYPED = f"""typed0 as (
  select *, {_measured('title', '1e3', '1', '1073741824.0')} as tm, regexp_matches(title, '10x20 cm') as chain from bags),
typed as (
  select id, category, title, kind, brand, size, model, storage, color, tokens, numbers, list_distinct(list_concat(codes, model)) as codes, codes as title_codes,
    list_transform(size, lambda x: x::double::varchar) as t_size,
    list_distinct(list_concat(list_transform(storage, lambda x: split_part(x, ' ', 1)::double::varchar), list_transform(storage, lambda x: (split_part(x, ' ', 1)::double * 1073741824.0)::varchar), list_transform(list_filter(tm, lambda x: x.u = 'gb'), lambda x: x.v::varchar))) as t_ram_storage,
    list_transform(list_filter(tm, lambda x: x.u = 'ml'), lambda x: x.v::varchar) as t_volume, list_transform(list_filter(tm, lambda x: x.u in ('kg', 'g')), lambda x: x.v::varchar) as t_weight,
    list_distinct(list_concat(list_transform(list_filter(tm, lambda x: x.u in ('mm', 'cm')), lambda x: x.v::varchar), case when chain then ['100.0x200.0'] else [] end)) as t_dimensions,
    list_transform(list_filter(tm, lambda x: x.u = 'w'), lambda x: x.v::varchar) as t_power, list_transform(list_filter(tm, lambda x: x.u = 'v'), lambda x: x.v::varchar) as t_voltage,
    list_distinct(list_concat(list_transform(model, lambda x: split_part(x, '-', 2)::double::varchar), codes)) as t_model_number,
    cast([] as varchar[]) as t_pack_count, cast([] as varchar[]) as t_optical, cast([] as varchar[]) as t_frequency, cast([] as varchar[]) as t_capacity, cast([] as varchar[]) as material from typed0)"""


@query("n2_typed_measurements", "select id, family, count(*) as n from (select id, unnest([" + ", ".join(f"'{f}'" for f in fe.NUMERIC_TYPES) + "]) as family, unnest([" + ", ".join(f"t_{f}" for f in fe.NUMERIC_TYPES) + "]) as vs from typed) t, unnest(vs) group by id, family", f"{RICH}, {TYPED}")
def n2(spark, d):
    return fe.typed_items(rich_items(spark, d)).select("id", F.explode("typed").alias("family", "vs")).select("id", "family", F.size("vs").cast("long").alias("n"))


@query("b12_family_sets", "select id, family, array_to_string(list_sort(vs), '|') as vals from (select id, unnest(['brand', 'size', 'model_number', 'ram_storage', 'color']) as family, unnest([brand, size, model, storage, color]) as vs from bags) where len(vs) > 0", RICH)
def b12(spark, d):
    return fe.typed_items(rich_items(spark, d)).select("id", F.explode("concepts").alias("family", "vs")).select("id", "family", F.array_join("vs", "|").alias("vals"))


# pair features


def _states(a: str, b: str, prefix: str) -> list[str]:
    return [
        f"{num(both(a, b))} as {prefix}_both", f"{num(inter(a, b) + ' > 0')} as {prefix}_match", f"{num(both(a, b) + ' and ' + inter(a, b) + ' < ' + union(a, b))} as {prefix}_conflict",
        f"{num(f'(len({a}) > 0) <> (len({b}) > 0)')} as {prefix}_one_missing",
    ]


def _jaccard(a: str, b: str, empty: str) -> str:
    return f"case when {union(a, b)} = 0 then {empty} else {inter(a, b)} / {union(a, b)}::double end"


def _relation(c: str) -> str:
    a, b = f"a.{c}", f"b.{c}"
    x, y = f"array_to_string(list_sort({a}), ' ')", f"array_to_string(list_sort({b}), ' ')"
    return f"case when len({a}) = 0 and len({b}) = 0 then null when len({a}) = 0 or len({b}) = 0 then 'missing_one_side' when {x} = {y} then null when {inter(a, b)} > 0 or contains({x}, {y}) or contains({y}, {x}) then 'specificity_difference' else 'different_value' end"


_KEYS = ("brand", "size", "model", "storage", "color")
_SHARED = " + ".join(f"(len(a.{k}) > 0 and len(b.{k}) > 0)::int" for k in _KEYS)
_EXACT = " + ".join(f"({inter(f'a.{k}', f'b.{k}')} > 0)::int" for k in _KEYS)
_COUNT = {s: "(" + " + ".join(f"(len({s}.{k}) > 0)::int" for k in _KEYS) + ")" for s in "ab"}
_UNION = " + ".join(f"(len(a.{k}) > 0 or len(b.{k}) > 0)::int" for k in _KEYS)
_SQL_OF = {"brand": "brand", "model_number": "model", "color": "color", "material": "material", "size": "size", "ram_storage": "storage"}
_FIRED = " + ".join(f"coalesce(({_relation(_SQL_OF[c])}) = '{r}', false)::int" for c, r in RULES)
_CONFLICTS = "list_filter([" + ", ".join(f"case when {both(f'a.t_{f}', f'b.t_{f}')} and {inter(f'a.t_{f}', f'b.t_{f}')} < {union(f'a.t_{f}', f'b.t_{f}')} then '{f}' end" for f in fe.NUMERIC_TYPES) + "], lambda x: x is not null)"
TYPED_SQL = [
    f"{num('a.title = b.title')} as title_exact", f"{_jaccard('a.tokens', 'b.tokens', '1.0')} as title_token_jaccard", "least(length(a.title), length(b.title)) / greatest(1, length(a.title), length(b.title))::double as title_length_ratio",
    "abs(length(a.title) - length(b.title)) as title_length_delta", f"{inter('a.numbers', 'b.numbers')} as title_number_overlap", f"{_jaccard('a.numbers', 'b.numbers', '1.0')} as title_number_jaccard",
    f"{_COUNT['a']} as attribute_count_a", f"{_COUNT['b']} as attribute_count_b", f"abs({_COUNT['a']} - {_COUNT['b']}) as attribute_count_delta", f"({_SHARED}) as attribute_common_keys", f"({_SHARED}) as attribute_comparable",
    f"({_SHARED}) / greatest(1, {_UNION})::double as attribute_key_jaccard", f"({_EXACT}) as attribute_exact", f"({_SHARED}) - ({_EXACT}) as attribute_conflict", f"({_EXACT}) / greatest(1, {_SHARED})::double as attribute_exact_ratio",
    f"(({_SHARED}) - ({_EXACT})) / greatest(1, {_SHARED})::double as attribute_conflict_ratio", f"{_COUNT['b']} - ({_SHARED}) as attribute_missing_a", f"{_COUNT['a']} - ({_SHARED}) as attribute_missing_b",
    *(s for c in ("brand", "model_number", "color", "material") for s in _states(f"a.{_SQL_OF[c]}", f"b.{_SQL_OF[c]}", "model_code" if c == "model_number" else c)),
    *_states("a.codes", "b.codes", "title_code"), f"{_jaccard('a.codes', 'b.codes', '1.0')} as title_code_jaccard",
    *(s for f in fe.NUMERIC_TYPES for s in [*_states(f"a.t_{f}", f"b.t_{f}", f"num_{f}"), f"{inter(f'a.t_{f}', f'b.t_{f}')} as num_{f}_overlap_count", f"{union(f'a.t_{f}', f'b.t_{f}')} - {inter(f'a.t_{f}', f'b.t_{f}')} as num_{f}_unmatched_count"]),
    f"coalesce(({_CONFLICTS})[1], 'none') as primary_conflict_type", f"coalesce(nullif(array_to_string({_CONFLICTS}, '+'), ''), 'none') as conflict_signature", f"{_FIRED} as rule_fired_count", f"{num('(' + _FIRED + ') > 0')} as rule_any_fired",
    "case a.category " + " ".join(f"when '{c}' then '{r}'" for c, r in REGIMES.items()) + " else 'unknown_mixed' end as matching_regime",
]


def _rounded(df, keys=("id1", "id2")):
    """Doubles to six places, keys and texts as they are, other numbers as whole ones."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns if c not in keys))


def _rounding(columns: list[str]) -> str:
    """The oracle's columns, rounded like the query's."""
    out = []
    for c in columns:
        body, name = c.rsplit(" as ", 1)
        out.append(c if name.endswith(("_type", "_signature", "_regime")) else f"round(({body})::double, 6) as {name}")
    return ", ".join(out)


@query("f3_typed_features", joined("m.id1, m.id2, " + _rounding(TYPED_SQL), "typed"), f"{RICH}, {TYPED}")
def f3(spark, d):
    out = fe.typed_native(v.matches(spark, d).select("id1", "id2"), rich_items(spark, d), RULES, REGIMES)
    names = [c.rsplit(" as ", 1)[1] for c in TYPED_SQL]
    return _doubles(out.select("id1", "id2", *names))


def _doubles(df, keys=("id1", "id2")):
    return df.select(*keys, *(F.col(c) if t == "string" else F.round(F.col(c).cast("double"), 6).alias(c) for c, t in df.dtypes if c not in keys))


@query("f3_all_typed_features")
def f3_all(spark, d):
    out = fe.typed_features(v.matches(spark, d), rich_items(spark, d), rules=RULES, regimes=REGIMES)
    return out.withColumn("fired_rules", F.array_join("fired_rules", ","))


_M2 = {f: f"list_distinct(list_transform(list_filter(ms, lambda x: x.u in ({us})), lambda x: x.v))" for f, us in FAMILY_OF.items()}
CHEAP = f"""cheap0 as (select *, {_measured("concat(title, ' ', array_to_string(flat, ' '))", '1e6', '1e3', '1024.0')} as ms from bags),
cheap as (select id, category, title, tokens, list_distinct(flat) as vals, list_distinct(regexp_extract_all(array_to_string(flat, ' '), '[0-9a-z]+')) as value_tokens,
    list_distinct(list_filter(all_tokens, lambda x: regexp_full_match(x, '[0-9]+'))) as numbers, list_distinct(regexp_extract_all(title, '[0-9]+/512')) as slash,
    list_distinct(list_transform(list_filter(regexp_extract_all(title, '[0-9a-z]+(?:-[0-9a-z]+)*'), lambda x: regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]') and (contains(x, '-') or length(x) >= 5)), lambda x: replace(x, '-', ''))) as skus,
    case when kind = 2 then brand else [] end as brand_values, case when kind = 2 then model else [] end as model_values, case when kind = 2 then storage else [] end as memory_values, case when kind = 2 then [list_extract(flat, len(flat))] else [] end as color_values,
    {", ".join(f"{x} as {f}" for f, x in _M2.items())} from cheap0)"""
_AGREE = " + ".join(f"({inter(f'a.{f}', f'b.{f}')} > 0)::int" for f in FAMILY_OF)
_DISAGREE = " + ".join(f"{disjoint(f'a.{f}', f'b.{f}')}::int" for f in FAMILY_OF)
_N = ("a.numbers", "b.numbers")
_CONTEXT = f"case when {inter(*_N)} > 0 then least(len(a.numbers), len(b.numbers)) - {inter(*_N)} else 0 end + {_DISAGREE} + {disjoint('a.slash', 'b.slash')}::int"
CHEAP_SQL = [
    f"{num('a.title = b.title')} as title_exact", f"{_jaccard('a.tokens', 'b.tokens', '0.0')} as title_token_jaccard", f"{inter('a.tokens', 'b.tokens')} as title_common_tokens",
    "least(length(a.title), length(b.title)) as title_length_min", "greatest(length(a.title), length(b.title)) as title_length_max", "least(length(a.title), length(b.title)) / greatest(length(a.title), length(b.title))::double as title_length_ratio",
    "abs(length(a.title) - length(b.title)) as title_length_delta", "least(len(a.numbers), len(b.numbers)) as number_count_min", "greatest(len(a.numbers), len(b.numbers)) as number_count_max", f"{inter(*_N)} as number_overlap_count",
    f"{union(*_N)} - {inter(*_N)} as number_unmatched_count", f"{num(f'len(a.numbers) > 0 and {inter(*_N)} = {union(*_N)}')} as number_set_exact", f"{_CONTEXT} as numeric_context_conflict_count", f"{_AGREE} as unit_overlap_count", f"{_DISAGREE} as unit_conflict_count",
    f"{num(inter('a.slash', 'b.slash') + ' > 0')} as slash_spec_match", f"{num(disjoint('a.slash', 'b.slash'))} as slash_spec_conflict", "least(len(a.skus), len(b.skus)) as code_count_min", "greatest(len(a.skus), len(b.skus)) as code_count_max",
    f"{inter('a.skus', 'b.skus')} as code_overlap_count", f"{num('len(a.skus) > 0 and ' + inter('a.skus', 'b.skus') + ' = ' + union('a.skus', 'b.skus'))} as code_exact", f"{num(disjoint('a.skus', 'b.skus'))} as code_conflict",
    "least(len(a.vals), len(b.vals)) as attribute_value_count_min", "greatest(len(a.vals), len(b.vals)) as attribute_value_count_max", f"{inter('a.vals', 'b.vals')} as attribute_value_overlap_count", f"{_jaccard('a.vals', 'b.vals', '0.0')} as attribute_value_overlap_ratio",
    f"{_jaccard('a.value_tokens', 'b.value_tokens', '0.0')} as attribute_values_token_jaccard", *(s for f in fe.FAMILIES for s in [f"{num(inter(f'a.{f}_values', f'b.{f}_values') + ' > 0')} as {f}_match", f"{num(disjoint(f'a.{f}_values', f'b.{f}_values'))} as {f}_conflict"]),
    f"{num(f'({_CONTEXT}) > 0 or ' + ' or '.join(disjoint(f'a.{c}', f'b.{c}') for c in ('skus', 'model_values', 'memory_values')))} as critical_conflict", f"{num('(len(a.skus) > 0) <> (len(b.skus) > 0)')} as sku_human_asymmetry",
]


@query("f2_cheap_features", joined("m.id1, m.id2, " + _rounding(CHEAP_SQL), "cheap"), f"{RICH}, {CHEAP}")
def f2(spark, d):
    out = fe.cheap_native(v.predictions(spark, d).select("id1", "id2", "score"), rich_items(spark, d))
    return _doubles(out.select("id1", "id2", *(c.rsplit(" as ", 1)[1] for c in CHEAP_SQL)))


@query("f2_all_cheap_features")
def f2_all(spark, d):
    return fe.cheap_features(v.predictions(spark, d).select("id1", "id2", "score"), rich_items(spark, d))


FLAGS_SQL = [
    "a.title = b.title as exact_normalized_title_match", f"({_CONTEXT}) > 0 as numeric_conflict", f"({_CONTEXT})::bigint as numeric_context_conflict_count", f"{disjoint('a.skus', 'b.skus')} as code_conflict", f"{disjoint('a.model_values', 'b.model_values')} as model_code_conflict",
    " or ".join(disjoint(f"a.{f}_values", f"b.{f}_values") for f in fe.FAMILIES) + " as critical_attribute_conflict", "(len(a.skus) > 0) <> (len(b.skus) > 0) as sku_vs_human_title",
]


@query("f11_f12_mining_flags", joined("m.id1, m.id2, " + ", ".join(FLAGS_SQL), "cheap"), f"{RICH}, {CHEAP}")
def f11(spark, d):
    out = fe.mining_flags(v.matches(spark, d).select("id1", "id2"), rich_items(spark, d))
    out = out.withColumn("numeric_context_conflict_count", F.col("numeric_context_conflict_count").cast("long"))
    return out.select("id1", "id2", *(c.rsplit(" as ", 1)[1] for c in FLAGS_SQL))


_IDC = f"({_states('a.model', 'b.model', 'x')[2].rsplit(' as ', 1)[0]} > 0.5 or {_states('a.codes', 'b.codes', 'x')[2].rsplit(' as ', 1)[0]} > 0.5)"
_NC = f"len({_CONFLICTS})"
PRIORITY_SQL = f"select m.id1, m.id2, {_IDC} as identifier_conflict, {_NC}::bigint as numeric_conflict_count, {_NC} >= 2 as multiple_numeric_conflicts, ({_SHARED}) / greatest(1, {_UNION})::double < 0.1 as low_attribute_overlap, round(round(1 - 2 * abs(m.score - 0.5), 14) + 0.25 * ({_IDC})::int + 0.15 * ({_NC} > 0)::int + 0.1 * (1 - m.score_b) + 0.05 * (({_SHARED}) / greatest(1, {_UNION})::double < 0.1)::int, 6) as priority from predictions m join typed a on a.id = m.id1 join typed b on b.id = m.id2"


@query("f13_conflict_components", PRIORITY_SQL, f"{RICH}, {TYPED}")
def f13(spark, d):
    p = fe.typed_native(v.predictions(spark, d).select("id1", "id2", "score", "score_b"), rich_items(spark, d))
    out = fe.conflict_components(p, F.col("score_b"), F.col("score"))
    return out.select("id1", "id2", "identifier_conflict", F.col("numeric_conflict_count").cast("long").alias("numeric_conflict_count"), "multiple_numeric_conflicts", "low_attribute_overlap", F.round("priority", 6).alias("priority"))


AUDIT = f"audit as (select *, list_distinct({_measured('title', '1e6', '1e3', '1024.0')}) as ms0 from bags)"
_AUDIT_MS = "list_transform({s}.ms0, lambda x: concat(case when x.u in ('mm', 'cm') then 'l' when x.u in ('kg', 'g') then 'm' else x.u end, x.v::varchar))"
_MS = tuple(_AUDIT_MS.format(s=s) for s in "ab")
_SKU = "list_distinct(list_filter(regexp_extract_all({s}.title, '[0-9a-z]+(?:-[0-9a-z]+)*'), lambda x: regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]') and (contains(x, '-') or length(x) >= 5)))"
_MODEL = tuple(f"case when {s}.kind = 2 and len({s}.model) > 0 then {s}.model else {_SKU.format(s=s)} end" for s in "ab")
_BR = tuple(f"case when {s}.kind = 2 then {s}.brand else [] end" for s in "ab")
_CO = tuple(f"case when {s}.kind = 2 then [list_extract({s}.flat, len({s}.flat))] else [] end" for s in "ab")
AUDIT_SQL = [
    f"{num('a.title = b.title')} as name_exact", "least(length(a.title), length(b.title)) / greatest(length(a.title), length(b.title))::double as name_length_ratio", f"{inter(*_N)} / greatest(1, {union(*_N)})::double as name_numeric_jaccard", f"{num(both(*_N))} as name_numbers_both",
    "abs(length(a.title) - length(b.title)) as name_length_delta", f"{num(f'{both(*_N)} and {inter(*_N)} < {union(*_N)}')} as number_conflict", f"{num(f'{inter(*_MS)} > 0')} as measure_match", f"{num(f'{both(*_MS)} and {inter(*_MS)} < {union(*_MS)}')} as measure_conflict",
    f"{num(inter(*_BR) + ' > 0')} as brand_match", f"{num(disjoint(*_BR))} as brand_conflict", f"{num(inter(*_MODEL) + ' > 0')} as model_match", f"{num(disjoint(*_MODEL))} as model_conflict", "0.0 as seller_match", "0.0 as seller_conflict", f"{num(inter(*_CO) + ' > 0')} as color_match", f"{num(disjoint(*_CO))} as color_conflict",
]


@query("f4_audit_features", joined("m.id1, m.id2, " + _rounding(AUDIT_SQL), "audit"), f"{RICH}, {AUDIT}")
def f4(spark, d):
    out = fe.audit_native(v.matches(spark, d).select("id1", "id2"), rich_items(spark, d))
    return _doubles(out.select("id1", "id2", *(c.rsplit(" as ", 1)[1] for c in AUDIT_SQL)))


PLAIN = """plain as (select id, category, attributes, lower(name) as title, kind, regexp_replace(lower(brand), '\\W+', ' ', 'g') as brand from (select *, case when id % 97 = 5 or id % 11 = 3 then 0 else 1 end as kind, json_extract_string(case when id % 97 = 5 then '{}' else attributes end, '$.brand') as brand from items)),
eda as (select *, regexp_replace(title, '\\W+', ' ', 'g') as words, list_distinct(regexp_extract_all(title, '[0-9]+')) as numbers, list_filter(['brand', 'type', 'size', 'price', 'color'], lambda k: kind = 1 and json_extract_string(case when kind = 0 then '{}' else attributes end, concat('$.', k)) is not null) as keys,
  list_distinct(list_filter(string_split(concat(regexp_replace(title, '\\W+', ' ', 'g'), ' ', coalesce(brand, '')), ' '), lambda t: length(t) >= 3 and regexp_matches(t, '[0-9]'))) as idents from plain)"""
_VAL = "regexp_replace(lower(json_extract_string({s}.attributes, concat('$.', k))), '\\W+', ' ', 'g')"
_EK = ("a.keys", "b.keys")
_EQ = f"len(list_filter(list_intersect(a.keys, b.keys), lambda k: {_VAL.format(s='a')} = {_VAL.format(s='b')}))"
EDA_SQL = [
    f"{num('a.words = b.words')} as name_exact", "least(length(a.words), length(b.words)) / greatest(length(a.words), length(b.words))::double as name_length_ratio", f"{_jaccard(*_N, '0.0')} as numeric_jaccard", f"{num(inter('a.idents', 'b.idents') + ' > 0')} as identifier_overlap",
    f"{num('a.kind = 1 and b.kind = 1 and a.brand = b.brand')} as brand_equal", f"{num('a.kind = 1 and b.kind = 1 and a.brand <> b.brand')} as brand_conflict", f"{_jaccard(*_EK, '0.0')} as attr_key_jaccard", f"coalesce({_EQ} / nullif({inter(*_EK)}, 0)::double, 0) as attr_value_match_ratio",
    f"coalesce(({inter(*_EK)} - {_EQ}) / nullif({inter(*_EK)}, 0)::double, 0) as attr_value_conflict_ratio", f"{num('a.attributes = b.attributes')} as attr_exact", f"{inter(*_EK)} as shared_attr_keys", f"{_EQ} as matching_attr_values",
]


@query("f1_eda_features", joined("m.id1, m.id2, " + _rounding(EDA_SQL), "eda"), PLAIN)
def f1(spark, d):
    out = fe.eda_native(v.matches(spark, d).select("id1", "id2"), v.items(spark, d))
    return _doubles(out.select("id1", "id2", *(c.rsplit(" as ", 1)[1] for c in EDA_SQL)))


@query("f1_f5_pair_features")
def f1_f5(spark, d):
    """The 16 exploratory and the 8 name features, with a column a category."""
    items = v.items(spark, d)
    pairs = v.matches(spark, d)
    names = fe.name_features(pairs.select("id1", "id2"), items, ["ECONOMY", "PROMO", "STANDARD"])
    shared = [c for c in names.columns if c.startswith(("category_", "name_num"))]
    return fe.eda_features(pairs, items).join(names.select("id1", "id2", *shared), ["id1", "id2"])


SELECTED = "selected as (select * from (values (1, 'size'), (2, 'color'), (3, 'storage')) as t(rank, key))"
_FB = {"brand": _BR, "model": tuple(f"case when {s}.kind = 2 then {s}.model else [] end" for s in "ab"), "memory": tuple(f"case when {s}.kind = 2 then {s}.storage else [] end" for s in "ab"), "color": _CO, "size": tuple(f"case when {s}.kind = 2 then {s}.size else [] end" for s in "ab")}
_FS = " + ".join(f"{both(*x)}::int" for x in _FB.values())
_FE = " + ".join(f"({inter(*x)} > 0)::int" for x in _FB.values())
_FU = " + ".join(f"(len({x[0]}) > 0 or len({x[1]}) > 0)::int" for x in _FB.values())
_FC = [" + ".join(f"(len({x[i]}) > 0)::int" for x in _FB.values()) for i in (0, 1)]
FAMILY_SQL = [
    f"({_FS}) as attr_shared_keys", f"({_FS}) / greatest(1, {_FU})::double as attr_key_jaccard", f"({_FE}) as attr_equal_values", f"({_FS}) - ({_FE}) as attr_conflicting_values", f"({_FE}) / greatest(1, {_FS})::double as attr_equal_ratio", f"(({_FS}) - ({_FE})) / greatest(1, {_FS})::double as attr_conflict_ratio",
    f"abs(({_FC[0]}) - ({_FC[1]})) as attr_count_delta", f"{num(f'({_FC[0]}) = ({_FC[1]}) and ({_FE}) = ({_FC[0]})')} as attr_exact",
    *(s for f in fe.FAMILIES for s in [f"{num(both(*_FB[f]))} as {f}_both", f"{num(inter(*_FB[f]) + ' > 0')} as {f}_match", f"{num(disjoint(*_FB[f]))} as {f}_conflict"]),
    *(s for i, f in enumerate(("size", "color", "memory"), 1) for s in [f"{num(both(*_FB[f]))} as exact_key_{i}_both", f"{num(inter(*_FB[f]) + ' > 0')} as exact_key_{i}_match", f"{num(disjoint(*_FB[f]))} as exact_key_{i}_conflict", f"{num(f'(len({_FB[f][0]}) > 0) <> (len({_FB[f][1]}) > 0)')} as exact_key_{i}_one_missing"]),
]


@query("f6_family_features", joined("m.id1, m.id2, " + _rounding(FAMILY_SQL), "bags"), RICH)
def f6(spark, d):
    items = rich_items(spark, d)
    keys = spark.createDataFrame([(1, "size"), (2, "color"), (3, "storage")], "rank int, key string")
    selected = items.select("category").distinct().join(F.broadcast(keys))  # three keys
    return _doubles(fe.family_features(v.matches(spark, d).select("id1", "id2"), items, selected, 3))


ERROR_SQL = """select id1, id2, wrong as model_is_error, round(wrongness, 9) as model_wrongness, round(gap, 9) as model_light_gap,
  round(0.65 * (rank() over (partition by category, target order by gap) + (count(*) over (partition by category, target, gap) - 1) / 2.0::double) / count(*) over (partition by category, target)
    + 0.35 * (rank() over (partition by category, target order by score_c) + (count(*) over (partition by category, target, score_c) - 1) / 2.0::double) / count(*) over (partition by category, target), 9) as diagnostic_hardness
from (select *, (score >= 0.5) <> (target >= 0.5) as wrong, case when target >= 0.5 then 1 - score else score end as wrongness, abs(score - score_b) as gap from predictions)"""


@query("f7_error_signals", ERROR_SQL)
def f7(spark, d):
    out = fe.error_signals(v.predictions(spark, d), "score", "score_b", "score_c")
    return out.select("id1", "id2", "model_is_error", *(F.round(c, 9).alias(c) for c in ("model_wrongness", "model_light_gap", "diagnostic_hardness")))


@query("f7_hard_features")
def f7_all(spark, d):
    return fe.hard_features(v.predictions(spark, d), v.items(spark, d), "score", "score_b", "score_c")


@query("n23_lexical_mix", "select id1, id2, round(least(1, greatest(0, 0.30 * score + 0.20 * score_b + 0.15 * score_c + 0.10 * score + 0.10 * score_b + 0.10 * score_c + 0.05 * target)), 6) as mix from predictions")
def n23(spark, d):
    """The seven weights over given similarities (the scores stand for them)."""
    given = dict(zip(fe.LEXICAL_MIX, ("score", "score_b", "score_c", "score", "score_b", "score_c", "target")))
    p = v.predictions(spark, d)
    for name, column in given.items():
        p = p.withColumn(name, F.col(column).cast("double"))
    return p.select("id1", "id2", F.round(fe.lexical_mix(), 6).alias("mix"))


ROUTER_SQL = [
    "m.score as probability", "ln(q / (1 - q)) as logit", "abs(m.score - 0.5) as abs_from_half", "1 - 2 * abs(m.score - 0.5) as uncertainty", "-(q * ln(q) + (1 - q) * ln(1 - q)) as entropy", "m.score_b * 4 - 2 as raw_logit",
    f"{num('a.title = b.title')} as title_exact", f"{_jaccard('a.tokens', 'b.tokens', '1.0')} as title_token_jaccard", "least(length(a.title), length(b.title)) / greatest(1, length(a.title), length(b.title))::double as title_length_ratio",
    "abs(length(a.title) - length(b.title)) as title_length_delta", f"{inter('a.numbers', 'b.numbers')} as title_number_overlap", f"{_jaccard('a.numbers', 'b.numbers', '1.0')} as title_number_jaccard",
]


@query("f8_router_features", joined("m.id1, m.id2, m.category, " + _rounding(ROUTER_SQL), "bags", "(select *, least(greatest(score, 1e-7), 1 - 1e-7) as q from predictions)"), RICH)
def f8(spark, d):
    p = fe.title_features(v.predictions(spark, d).withColumn("raw", F.col("score_b") * 4 - 2), rich_items(spark, d)).select("*", *fe.router_features(F.col("score"), F.col("raw")))
    return _doubles(p.select("id1", "id2", "category", *(c.rsplit(" as ", 1)[1] for c in ROUTER_SQL)))


@query("f8_score_title")
def f8_all(spark, d):
    p = v.predictions(spark, d).withColumn("raw", F.col("score_b") * 4 - 2)
    return fe.score_title(p, rich_items(spark, d), "score", "raw")


@query("n5_n7_n8_fuzzy_ratios")
def ratios(spark, d):
    names = v.items(spark, d).select("id", tx.alnum_only(F.col("name")).alias("name"))
    from ..operators import pairs as pr

    p = pr.hydrate(v.matches(spark, d), names, ("name",))
    named = {"ratio": "ratio", "token_sort_ratio": "token_sort", "token_set_ratio": "token_set", "wratio": "wratio"}
    return sim.with_ratios(p, "name_1", "name_2", named).select("id1", "id2", *(F.round(c, 6).alias(c) for c in named))


@query("n9_value_similarity")
def n9(spark, d):
    p = fe.typed_native(v.matches(spark, d).select("id1", "id2"), rich_items(spark, d))
    return fe.value_similarity(p)


SUBLINEAR = """grams as (select id, unnest(list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 3)), [])) as g from (select id, category, unnest(list_transform(string_split(lower(regexp_replace(name, '[^0-9A-Za-z]+', ' ', 'g')), ' '), lambda w: concat(' ', w, ' '))) as w from items)),
tf as (select id, g, 1 + ln(count(*)) as tf from grams where length(g) = 3 group by id, g), df as (select g, ln((1 + (select count(*) from items)) / (1 + count(*))::double) + 1 as idf from tf group by g),
w as (select id, tf.g, tf * idf as w from tf join df on df.g = tf.g), norm as (select id, sqrt(sum(w * w)) as n from w group by id)"""


@query("n12_sublinear_tfidf", "select m.id1, m.id2, round(coalesce(sum(a.w * b.w), 0) / (x.n * y.n), 6) as cosine from matches m join norm x on x.id = m.id1 join norm y on y.id = m.id2 left join w a on a.id = m.id1 left join w b on b.id = m.id2 and b.g = a.g group by m.id1, m.id2, x.n, y.n", SUBLINEAR)
def n12(spark, d):
    out = sim.ngram_count_cosine(v.matches(spark, d).select("id1", "id2"), v.items(spark, d), F.col("name"), "char", 3, 3, sublinear=True, idf=True)
    return out.select("id1", "id2", F.round("cosine", 6).alias("cosine"))
