"""Operators of the pair-matching engine on small frames, and every registered query against its SQL oracle."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pairloom import registry
from pairloom.functions import numeric as nm, text as tx, units
from pairloom.operators import attributes as at, features as fe, graph as gr, metrics as me, pairs as pr, policies as po, replicates as rp, routing as ro, rules as ru, similarity as sim
from pairloom.streaming import latest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0  # no negative zero
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in found.fetchall())
    assert sorted(repr(tuple(plain(x) for x in row)) for row in df.select(*columns).collect()) == want


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Phone X 16/512", '{"brand": "A", "size": " 5 cm "}', "p"), (2, "phone x", '{"brand": "A", "size": ""}', "p"), (3, "Ёлка", "[1]", "q"), (4, None, "broken", "q")]
    return spark.createDataFrame(rows, "id long, name string, attributes string, category string")


def test_hydration_reports_missing_items(spark, items):
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "id1 long, id2 long")
    got = {(r.id1, r.id2): r for r in pr.hydrate(pairs, items).collect()}
    assert got[1, 2].name_2 == "phone x" and got[1, 9].name_2 is None
    with pytest.raises(Exception, match="missing item id"):
        pr.hydrate(pairs, items, strict=True).collect()
    with pytest.raises(ValueError, match="missing required columns"):
        pr.require_columns(items.drop("name"), pr.ITEM_COLUMNS, "items")


def test_text_functions(items):
    got = items.select("id", tx.words_only(F.col("name")).alias("a"), tx.numbers(F.col("name")).alias("n"), tx.slash_specs(F.col("name")).alias("s"), tx.fold(F.col("name")).alias("f")).orderBy("id").collect()
    assert [r.a for r in got] == ["phone x 16 512", "phone x", "елка", ""]
    assert got[0].n == ["16", "512"] and got[0].s == ["16/512"] and got[2].f == "елка"


def test_ngrams_are_runs(spark):
    row = spark.range(1).select(tx.char_ngrams(F.lit("ab cd"), 2, 3).alias("c"), tx.word_ngrams(F.array(F.lit("x"), F.lit("y"), F.lit("z")), 1, 2).alias("w"), tx.padded_char_ngrams(F.lit("ab c"), 3, 4).alias("p")).first()
    assert row.c == ["ab", "bc", "cd", "abc", "bcd"] and row.w == ["x", "y", "z", "x y", "y z"] and row.p == [" ab", "ab ", " ab ", " c "]


def test_attribute_parsing(items):
    bags = {r.id: r.b for r in items.select("id", at.parse(F.col("attributes")).alias("b")).collect()}
    assert bags == {1: {"brand": "A", "size": "5 cm"}, 2: {"brand": "A"}, 3: None, 4: None}


def test_measures(spark):
    got = spark.range(1).select(units.measures(F.lit("1,5 кг, 20 мм и 2 TB")).alias("m")).first().m
    assert {(m.family, m.value) for m in got} == {("mass_mg", 1.5e6), ("length_mm", 20.0), ("memory_mb", 2097152.0)}


def test_set_semantics(spark):
    none, a, b = F.array().cast("array<string>"), F.array(F.lit("1"), F.lit("2")), F.array(F.lit("2"))
    row = spark.range(1).select(nm.jaccard(none, none).alias("z"), nm.jaccard(none, none, 1.0).alias("o"), nm.jaccard(none, none, None).alias("n"), nm.conflict(a, b).alias("d"), nm.conflict(a, b, "unequal").alias("u"), nm.conflict(a, none).alias("e")).first()
    assert tuple(row) == (0.0, 1.0, None, False, True, False)


def test_fuzzy_ratios_by_definition():
    def subsequence(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [r for r in _next(row, x, b)]
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out[1:]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert sim.common_length(a, b) == subsequence(a, b)
    assert sim.indel_ratio("", "") == 100 and sim.token_sort("b a", "a b") == 100 and sim.token_set("a b", "a b c") == 100 and sim.token_set("", "a") == 0


def test_fuzzy_ratios_of_many_pairs_are_those_of_each():
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("abc dé") for _ in range(rng.choice([0, 5, 30, 63, 64, 65, 90]))) for _ in "ab") for _ in range(400)]
    for kind, one in (("ratio", sim.indel_ratio), ("token_sort", sim.token_sort), ("token_set", sim.token_set)):
        assert sim.RATIOS[kind](pairs) == pytest.approx([one(a, b) for a, b in pairs])


def test_weighted_ratio_of_texts_of_unlike_length():
    assert sim.weighted_ratio("new york mets", "new york mets vs atlanta braves") == pytest.approx(90.0)
    assert sim.weighted_ratio("abc", "abc") == 100 and sim.weighted_ratio("", "a") == 0
    assert sim.partial_ratio("abcd", "xxabcdxx") == 100 and sim.partial_ratio("abcd", "xxabxcdxx") == 75


def test_threshold_states_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.1, 0), (0.8, 1), (0.9, 1)], "score double, target int")
    got = [(r.accepted, r.errors) for r in po.risk_states(df, "score", "target").orderBy("accepted").collect()]
    assert got == [(2, 0), (3, 1), (4, 2)]
    empty = po.best_states(po.risk_states(df, "score", "target"), 0.01).first()
    assert (empty.accepted, empty.errors, empty.ucb, empty.boundary) == (0, 0, 1.0, None)


def test_typed_conflicts_and_chains(spark):
    rows = [(1, "T", '{"Размер": "42", "Объём памяти": "8 ГБ"}', "c"), (2, "T", '{"Размер": "44", "Объём памяти": ["8 ГБ", "8 гб"]}', "c"), (3, "T 10x20 см", '[{"name": "Размер", "value": "42"}]', "c")]
    items = spark.createDataFrame(rows, "id long, name string, attributes string, category string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id1 long, id2 long")
    got = {r.id2: r for r in fe.typed_native(pairs, items, regimes={"c": "variant_tolerant"}).collect()}
    assert got[2].num_size_conflict == 1 and got[2].num_ram_storage_conflict == 0 and got[2].matching_regime == "variant_tolerant" and got[2].conflict_signature == "size"
    assert got[3].num_size_match == 1 and got[3].num_dimensions_one_missing == 1
    typed = {r.id: r.typed for r in fe.typed_items(items).collect()}
    assert "100.0x200.0" in typed[3]["dimensions"]


def test_slash_conflict_and_one_sided_codes(spark):
    rows = [(1, "Phone 16/512", "{}", "c"), (2, "Phone 8/512", "{}", "c"), (3, "Phone AB-123", "{}", "c")]
    items = spark.createDataFrame(rows, "id long, name string, attributes string, category string")
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5)], "id1 long, id2 long, score double")
    got = {r.id2: r for r in fe.cheap_features(pairs, items).collect()}
    assert got[2].slash_spec_conflict == 1 and got[3].code_conflict == 0 and got[3].sku_human_asymmetry == 1 and got[2].numeric_context_conflict_count >= 1


def test_portfolio_takes_the_clean_rule(spark):
    rows = [(i, 0.5, int(i >= 45), i % 3, ["clean_rule"] if i < 40 else [], False) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, score double, target int, fold int, gates array<string>, none boolean")
    got = po.select_portfolio(df, ["none"], 0.2, [0.8], [1.0], 10, 3, 2)
    assert (got["accepted"], got["errors"], got["gates"], got["threshold"]) == (40, 0, [("clean_rule", 0.8)], None)
    applied = po.apply_policy(df, 0.0, F.col("none"), got["gates"]).filter("reason is not null")
    assert applied.count() == 40 and {r.reason for r in applied.collect()} == {"clean_rule"}


def test_permutations_and_bootstraps(spark):
    rng = random.Random(9)
    rows = [(c, int(rng.random() < 0.4), i, rng.randrange(40) / 40) for c in "ab" for i in range(150)]
    df = spark.createDataFrame([(c, y, i + 1000 * ord(c), s, s, min(1.0, 0.5 * s + 0.5 * y)) for c, y, i, s in rows], "category string, target int, component_id long, x double, same double, better double")
    assert rp.permutation_test(df, "x", "same", 60).first().p_value == 1.0
    assert rp.permutation_test(df, "better", "x", 200).first().p_value == pytest.approx(1 / 201)
    seen = {m: me.macro(me.average_precision(df, ["category"], score=m), "ap").first().macro_ap for m in ("x", "better")}
    assert rp.permutation_test(df, "better", "x", 10).first().observed == pytest.approx(seen["better"] - seen["x"])
    one = rp.bootstrap(df, "better", "x", "component_id", ["category"], 150).first()
    assert one.replicates == 150 and one.low < seen["better"] - seen["x"] < one.high and one.positive_share == 1.0
    assert tuple(one) == tuple(rp.bootstrap(df.repartition(7), "better", "x", "component_id", ["category"], 150).first())
    few = spark.createDataFrame([("a", 1, 1, 0.5, 0.6)] + [("a", 0, i, 0.1, 0.2) for i in range(2, 9)], "category string, target int, component_id long, x double, y double")
    assert rp.bootstrap(few, "x", "y", "component_id", ["category"], 50).first().replicates == 50


def test_posteriors_know_the_sign(spark):
    rules = spark.createDataFrame([("up", 90, 10, 500, 500), ("none", 50, 50, 500, 500)], "rule string, positive long, negative long, baseline_positive long, baseline_negative long")
    got = {r.rule: r for r in rp.beta_effects(rules).collect()}
    assert got["up"].above > 0.999 and got["up"].low > 1 and 0.2 < got["none"].above < 0.8
    assert got["up"].median == pytest.approx(math.log(9), abs=0.15)


def brute_ap(rows):
    total, found, seen, ap = sum(y for _, y in rows), 0, 0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        ys = [y for t, y in rows if t == s]
        seen, found = seen + len(ys), found + sum(ys)
        ap += sum(ys) / total * found / seen
    return ap


def test_metrics_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(c, round(rng.random(), 1), int(rng.random() < 0.4)) for c in "ab" for _ in range(80)] + [("c", 0.5, 0)]
    df = spark.createDataFrame(rows, "category string, score double, target int")
    ap = {r.category: r.ap for r in me.average_precision(df, ["category"]).collect()}
    auc = {r.category: r.auc for r in me.roc_auc(df, ["category"]).collect()}
    assert ap["c"] is None and auc["c"] is None
    for c in "ab":
        own = [(s, y) for k, s, y in rows if k == c]
        assert ap[c] == pytest.approx(brute_ap(own))
        wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, x in own if x for b, y in own if not y]
        assert auc[c] == pytest.approx(sum(wins) / len(wins))


@pytest.mark.parametrize("alone", [0, 200_000])
def test_components_take_the_least_id(spark, monkeypatch, alone):
    monkeypatch.setattr(gr, "ONE_TASK_EDGES", alone)
    pairs = spark.createDataFrame([(9, 2), (2, 5), (100, 101), (7, 7)] + [(i, i + 1) for i in range(200, 260)], "id1 long, id2 long")
    got = {r.id: r.component_id for r in gr.components(pairs).collect()}
    assert got == {9: 2, 2: 2, 5: 2, 100: 100, 101: 100, 7: 7} | {i: 200 for i in range(200, 261)}


def test_quotas_add_up(spark):
    sizes = spark.createDataFrame([("a", 7), ("b", 3), ("c", 3)], "g string, n long")
    got = {r.g: r.quota for r in gr.largest_remainder(sizes, 6, ["g"]).collect()}
    assert got == {"a": 3, "b": 2, "c": 1}


def test_holm_and_bh(spark):
    tests = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double")
    assert {r.name: round(r.adjusted, 9) for r in ru.holm(tests, "p", "name").collect()} == {"x": 0.03, "y": 0.06, "z": 0.06}
    assert {r.name: round(r.q, 9) for r in ru.benjamini_hochberg(tests, "p", "name").collect()} == {"x": 0.03, "y": 0.04, "z": 0.04}


def test_hypergeometric_tail_sums_to_one():
    exact = sum(math.comb(8, i) * math.comb(12, 6 - i) for i in range(3, 7)) / math.comb(20, 6)
    assert ru.hypergeometric_tail(3, 6, 8, 20) == pytest.approx(exact) and ru.hypergeometric_tail(0, 6, 8, 20) == pytest.approx(1)


def test_leave_one_out_ignores_own_label(spark):
    occ = spark.createDataFrame([(1, 2, 1, "r"), (3, 4, 0, "r"), (5, 6, 1, "alone")], "id1 long, id2 long, target int, rule string")
    got = {r.id1: r.encoded for r in ru.target_encoding(occ, None).collect()}
    assert got == {1: pytest.approx(math.log(1 / 2)), 3: pytest.approx(math.log(2 / 1))}


def test_exclusive_allocation_keeps_quotas(spark):
    rows = [(i, i + 100, i % 2, 0.5, 0.5 + (i % 7 - 3) / 20, 0.5 + (i % 5 - 2) / 20) for i in range(100)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, target int, score double, score_b double, score_c double")
    got = ro.exclusive_allocation(df, 0.1).collect()
    assert len({(r.id1, r.id2) for r in got}) == len(got) and all(sum(r.expert == e for r in got) <= 10 for e in "bc")


def test_latest_state_as_batch_and_stream(spark, tmp_path):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 1, "b")]
    log = spark.createDataFrame(rows, "key int, at int, payload string")
    want = {(1, 2, "b"), (2, 1, "c")}
    assert {tuple(r) for r in latest.latest_per_key(log, ["key"], ["at", "payload"]).collect()} == want
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    latest.keep_latest(stream, ["key"], ["at", "payload"], str(tmp_path / "out"), str(tmp_path / "ck"), buckets=4).awaitTermination()
    state = lambda: {tuple(r) for r in latest.current(spark, str(tmp_path / "out"), log.schema).select("key", "at", "payload").collect()}
    assert state() == want
    for at, payload in ((3, "z"), (4, "y"), (5, "x")):
        spark.createDataFrame([(1, at, payload)], log.schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
        latest.keep_latest(stream, ["key"], ["at", "payload"], str(tmp_path / "out"), str(tmp_path / "ck"), buckets=4).awaitTermination()
    assert state() == {(1, 5, "x"), (2, 1, "c")}
    assert all(len(list(p.glob("batch=*"))) <= 2 for p in (tmp_path / "out").glob("bucket=*"))


def test_resampled_negatives_repeat_as_often_as_the_reference(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["m14_resampled_negatives"](spark, sf_dir).first().repeats == 30


def test_items_of_millions_of_rows_are_not_broadcast(spark):
    ids = spark.range(1_000_000)
    items = ids.select("id", F.concat(F.lit("item "), "id").alias("name"))
    pairs = ids.select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    plan = pr.hydrate(pairs, items, ("name",))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
    few = pr.hydrate(pairs, items.limit(9), ("name",))._jdf.queryExecution().executedPlan().toString()
    assert few.count("BroadcastHashJoin") >= 2


def test_gram_weights_are_not_broadcast(spark):
    ids = spark.range(200_000)
    items = ids.select("id", F.concat(F.lit("item "), "id").alias("name"))
    pairs = ids.select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    made = {"n10": sim.char_tfidf_cosine(pairs, items, 3, 5), "n12": sim.ngram_count_cosine(pairs, items, F.col("name"), "char", 3, 5, sublinear=True, idf=True)}
    for name, df in made.items():
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_large_items_are_parsed_by_all_tasks_in_one_shuffle(spark, sf_dir, monkeypatch):
    """Items beyond the bound are spread before they are parsed, once for both sides of a pair, without shuffles of their attributes."""
    from pairloom.plans import features as fp
    from pairloom.sources import views

    monkeypatch.setattr(pr, "BROADCAST_BYTES", 0)
    items, pairs = fp.rich_items(spark, sf_dir), views.predictions(spark, sf_dir).select("id1", "id2", "score")
    plan = fe.typed_items(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    for native in (fe.typed_native, fe.cheap_native, fe.eda_native):
        out = native(pairs, items)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in plan and "Broadcast" not in plan


def test_predictions_know_their_category_without_a_join(spark, sf_dir):
    from pairloom.sources import views

    assert "Join" not in views.predictions(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_plan_of_exploded_gates_stays_small(spark, sf_dir):
    """A filter that is pushed down from the explosion writes out the gates once; it made two megabytes of plan."""
    plan = registry.queries()["r7_candidate_gates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 150_000


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_pairs_meet_across_parts(spark):
    """Blocks of many parts, other lengths, nulls, a zero vector (NaN, the greatest number) and an embedded null."""
    from pairloom.operators import retrieval as rt

    draw = random.Random(5)
    rows = [(i, "ab"[i % 2], [draw.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(60, "a", [1.0, 2.0]), (61, "a", [2.0, 4.1]), (62, None, [1.0, 0.0, 0.0]), (63, "a", None), (64, "b", [1.0, None, 0.0]), (65, "b", [0.0, 0.0, 0.0])]
    found = rt.similar_pairs(spark.createDataFrame(rows, "vec_id long, block string, e array<double>"), 0.2, part=7)
    got = {(r.a, r.b): r.s for r in found.collect()}
    assert len(got) == found.count()
    want = {}
    sound = [r for r in rows if r[1] and r[2] and None not in r[2]]
    for a, p, x in sound:
        for b, q, y in sound:
            if a < b and p == q and len(x) == len(y):
                n = math.sqrt(sum(k * k for k in x) * sum(k * k for k in y))
                s = sum(k * m for k, m in zip(x, y)) / n if n else math.nan
                if not s < 0.2:
                    want[a, b] = s
    assert got.keys() == want.keys() and sum(math.isnan(s) for s in want.values()) == 30
    assert all(math.isnan(s) or abs(got[k] - s) < 1e-12 for k, s in want.items())


def test_similar_pairs_form_no_join(spark, sf_dir):
    """Pairs of a block are matrix products of tiles rather than joined rows."""
    plan = _plan(registry.queries()["j17_blocked_similarity_join"](spark, sf_dir))
    assert "FlatMapCoGroupsInPandas" in plan and "vec_id < " not in plan


def test_slices_are_found_once(spark, sf_dir):
    """Metrics read the slices from a table; items aren't parsed again for each of them."""
    from pairloom.plans import statistics as st

    for name in ("p7_m10_slice_metrics", "m11_stable_slices"):
        assert "from_json" not in _plan(registry.queries()[name](spark, sf_dir))
    kinds = st._sliced(spark, sf_dir).groupBy("slice_type").count().collect()
    assert {r.slice_type for r in kinds} == set(st.SLICES) and len({r["count"] for r in kinds}) == 1


def test_both_models_read_one_table(spark, sf_dir, monkeypatch):
    made = []
    cut = gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: made.append(1) or cut(df))
    registry.queries()["r26_out_of_fold_models"](spark, sf_dir)
    assert len(made) == 1


def test_typed_features_are_found_once(spark, sf_dir):
    assert "from_json" not in _plan(registry.queries()["f3_all_typed_features"](spark, sf_dir))


def test_ngram_items_are_dealt_out(spark, sf_dir, monkeypatch):
    """A catalogue in one file is parsed by all tasks."""
    monkeypatch.setattr(pr, "BROADCAST_BYTES", 0)
    assert "xxhash64(id" in _plan(registry.queries()["a29_common_ngram_errors"](spark, sf_dir))


def test_all_shared_ngrams_count(spark, sf_dir):
    """Pairs that share hundreds of n-grams count for each of them; the query's are those of a plain pass over whole names."""
    from pairloom.operators import analysis as an
    from pairloom.sources import views as v

    pairs = spark.createDataFrame([(i % 2, i / 10, [f"g{j:04d}" for j in range(1000)], [f"g{j:04d}" for j in range(i, 1500)]) for i in range(6)], "target int, score double, a array<string>, b array<string>")
    got = {r.pattern: (r.support, r.negatives, r.false_positives, r.positives, r.false_negatives) for r in an.common_gram_errors(pairs, F.col("a"), F.col("b"), 2).collect()}
    assert len(got) == 999 and got["g0001"] == (2, 1, 0, 1, 1) and all(got[f"g{j:04d}"] == (6, 3, 0, 3, 2) for j in range(5, 1000))

    words = {r.id: re.findall("[0-9a-z]+", r["name"].lower()) for r in v.items(spark, sf_dir).collect()}

    def runs(w):
        bare = "".join(w)
        return {("word", " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)} | {("char", bare[i : i + n]) for n in (3, 4, 5) for i in range(len(bare) - n + 1)}

    want = {}
    for r in v.predictions(spark, sf_dir).collect():
        for key in runs(words[r.id1]) & runs(words[r.id2]):
            cell = want.setdefault(key, [0, 0, 0, 0])
            cell[2 * r.target] += 1
            cell[2 * r.target + 1] += (r.score >= 0.5) != r.target
    want = {(*k, *c) for k, c in want.items() if c[0] + c[2] >= 5}
    rows = registry.queries()["a29_common_ngram_errors"](spark, sf_dir)
    assert {tuple(r) for r in rows.select("kind", "pattern", "negatives", "false_positives", "positives", "false_negatives").collect()} == want


def test_hybrid_pools_meet_as_arrays(spark, sf_dir):
    """Queries and documents of a pool form no rows; the k best are those of a plain pass, over parts of a pool, pools that
    fall back to the category, shared names, vectors that are missing or of another length, and ties."""
    from pairloom.operators import retrieval as rt

    plan = _plan(registry.queries()["i2_i3_hybrid_retrieval"](spark, sf_dir))
    assert "FlatMapCoGroupsInPandas" in plan and "array_contains" not in plan

    rng = random.Random(7)
    words = ["red", "blue", "ring", "bolt", "9", "mm"]
    bank = []
    for i in range(150):
        name = " ".join(rng.choices(words, k=2))
        e = [None, [1.0], [0.5, None]][i % 25] if i % 25 < 3 else [rng.randrange(-2, 3) / 3 for _ in range(2)]
        bank.append((i, "ab"[i % 2], ["x", "y", "z"][0 if i % 3 else 1 + (i % 30 == 0)], name, " ".join([name, *rng.choices(words, k=rng.randrange(5))]), e))
    df = spark.createDataFrame(bank, "id long, category string, subtype string, name string, text string, e array<double>")

    def best(q, k):
        pool = [d for d in bank if d[1] == q[1] and (d[2] == q[2] or sum(x[1:3] == q[1:3] for x in bank) < 8)]
        pool = [d for d in pool if d[3] != q[3]]
        bags = {d[0]: d[4].split() for d in pool}
        mean = max(1.0, sum(map(len, bags.values())) / len(pool))
        dense, lexical = {}, {}
        for d in pool:
            whole = q[5] and d[5] and len(q[5]) == len(d[5]) and None not in q[5] + d[5]
            dense[d[0]] = round(sum(x * y for x, y in zip(q[5], d[5])), 9) if whole else -math.inf
            lexical[d[0]] = 0.0
            for t in set(q[4].split()) & set(bags[d[0]]):
                df_, tf = sum(t in b for b in bags.values()), bags[d[0]].count(t)
                lexical[d[0]] += math.log(1 + (len(pool) - df_ + 0.5) / (df_ + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bags[d[0]]) / mean))
        place = [{x: r for r, x in enumerate(sorted(s, key=lambda x: (-round(s[x], 9), x)), 1)} for s in (dense, lexical)]  # noqa: B023
        scored = {x: round(0.55 / (20 + place[0][x]) + 0.45 / (20 + place[1][x]), 12) for x in dense}
        return [(q[0], x, r, scored[x]) for r, x in enumerate(sorted(scored, key=lambda x: (-scored[x], x))[:k], 1)]

    for k in (1, 3):
        want = sorted(row for q in bank if q[0] % 5 == 0 for row in best(q, k))
        got = sorted(map(tuple, rt.hybrid(df, F.col("id") % 5 == 0, k, part=3).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))


def test_anchored_rules_are_found_once(spark, sf_dir):
    assert "from_json" not in _plan(registry.queries()["r17_anchored_rules"](spark, sf_dir))


def test_ngram_cosines_are_plans_of_their_own(spark, sf_dir, monkeypatch):
    """Each cosine is written; an item's grams are counted where its text was dealt to, without a shuffle of grams."""
    made = []
    cut = gr.cut
    monkeypatch.setattr(pr, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(gr, "cut", lambda df: made.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    registry.queries()["f7_hard_features"](spark, sf_dir)
    assert len(made) == 2 and all("hashpartitioning(__h" in p and not re.search(r"hashpartitioning\((__h#\w+, )?id#\w+, g#", p) for p in made)
    registry.queries()["f2_all_cheap_features"](spark, sf_dir)
    assert len(made) == 3 and "hashpartitioning(xxhash64(id" in made[2]
