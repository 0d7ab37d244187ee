"""Readers, writers and audit operators on small inputs."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators import audit as au, generation as ge, greedy as gd, pairs as pr, policies as po, ranking as rk, sampling as sa
from pairloom.sources import files as fi, runs as ru
from pairloom.streaming import ingest as ig

RULE = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("weight", T.IntegerType())])


def test_predictions_of_any_schema(spark, tmp_path):
    spark.createDataFrame([(1, 2, 1, "a", 0.5)], "id1 long, id2 long, target int, category_1 string, predict float").write.parquet(str(tmp_path / "p"))
    got = fi.read_predictions(spark, str(tmp_path / "p"))
    assert got.columns == ["id1", "id2", "target", "category", "score"] and got.first().score == 0.5
    with pytest.raises(ValueError, match="none of"):
        fi.first_of(["x"], fi.SCORES)
    assert fi.split_paths(["a=/x", "b=/y=z"]) == {"a": "/x", "b": "/y=z"}
    with pytest.raises(ValueError, match="NAME=PATH"):
        fi.split_paths(["a=/x", "a=/y"])


def test_logs_and_rules(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"rule_id": "a", "weight": 1}\nbroken\n{"rule_id": "a", "weight": 2}\n')
    good, bad = fi.read_log(spark, str(tmp_path / "log.jsonl"), RULE)
    assert good.count() == 2 and bad.count() == 1
    (tmp_path / "r.csv").write_text("rule_id,weight\na,1\nb,2\n")
    (tmp_path / "r.json").write_text('[{"rule_id": "b", "weight": 7}]')
    rules = fi.read_rules(spark, [str(tmp_path / "r.csv"), str(tmp_path / "r.json")], RULE)
    assert {tuple(r) for r in rules.collect()} == {("a", 1), ("b", 7)}


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(2, 5, 6, 0.25, "x"), (1, 3, 4, 0.5, "y")], "row_id long, id1 long, id2 long, predict double, split string")
    fi.write_predictions(df.coalesce(1), str(tmp_path / "csv"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*.csv")))
    assert [x for x in lines.split("\n") if x and not x.startswith("id1")] == ["3,4,0.5", "5,6,0.25"]
    with pytest.raises(Exception, match="NaN or infinity"):
        fi.write_predictions(df.withColumn("predict", F.lit(float("nan"))), str(tmp_path / "bad"))
    fi.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().count() == 2
    listed = {r.file: r.sha256 for r in fi.manifest(spark, str(tmp_path / "s")).collect()}
    assert listed == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "s").rglob("*.parquet")}
    a, b = fi.key_digest(df, ["id1", "id2"]).first(), fi.key_digest(df.orderBy("id1"), ["id1", "id2"]).first()
    assert a == b and a.digest != fi.key_digest(df.limit(1), ["id1", "id2"]).first().digest


def test_upsert_replaces_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")
    assert {tuple(r) for r in pr.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_guards_and_ladders(spark):
    assert au.leaking_columns(["score", "target_rate", "Fold"], {"score"}) == ["Fold", "target_rate"]
    rows = spark.createDataFrame([(0.2,), (0.3,), (9.0,)], "x double")
    got = rows.select(au.ladder(F.col("x"), [0.2, 0.5], ["a", "b"]).alias("l"), au.ladder(F.col("x"), [0.2, 0.5], ["a", "b"], True).alias("r")).collect()
    assert [tuple(r) for r in got] == [("b", "a"), ("b", "b"), ("b", "b")]
    faults = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 1.5), ("b", 2, 0.1)], "category string, target int, score double")
    assert {r.category: (r.bad_labels, r.bad_scores, r.valid) for r in au.prediction_faults(faults).collect()} == {"a": (0, 1, False), "b": (1, 0, False)}


def test_aliases_and_cycles(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p")], "alias string, name string")
    got = {r.alias: r.name for r in au.resolve_aliases(rows).collect()}
    assert {k: got[k] for k in "abc"} == {"a": "d", "b": "d", "c": "d"} and set(got) == set("abcpq")


def test_folds_keep_components_and_strata(spark):
    rng = random.Random(1)
    rows = [(c, "ab"[c % 2], int(rng.random() < 0.4)) for c in range(60) for _ in range(rng.randrange(1, 6))]
    pairs = spark.createDataFrame(rows, "component_id long, category string, target int")
    folds = sa.stratified_group_folds(pairs, 3)
    got = {r.component_id: r.fold for r in folds.collect()}
    assert set(got) == set(range(60)) and set(got.values()) == {0, 1, 2}
    for c in "ab":
        sizes = collections.Counter(got[k] for k, category, _ in rows if category == c)
        assert max(sizes.values()) < 2 * min(sizes.values())


def test_two_tails_take_the_most(spark):
    rows = [(0.01, 0)] * 4000 + [(0.99, 1)] * 4000 + [(0.5, 0), (0.5, 1)] * 5
    df = spark.createDataFrame(rows, "score double, target int").withColumn("miss", 1 - F.col("target"))
    low, high = po.risk_states(df, "score", "target"), po.risk_states(df, "score", "miss", "high")
    got = po.best_two_tails(low, high, 0.001, len(rows)).first()
    assert (got.accepted, got.errors, got.first_boundary, got.second_boundary) == (8000, 0, 0.01, 0.99)
    none = po.best_two_tails(low, high, 1e-9, len(rows)).first()
    assert (none.accepted, none.errors, none.ucb, none.first_boundary) == (0, 0, 1.0, None)


def test_components_to_an_exact_count(spark):
    sizes = spark.createDataFrame([(1, 3), (2, 2), (3, 2), (4, 1), (5, 1)], "component_id long, n long")
    got = {r.component_id for r in sa.components_to_count(sizes, 6, F.col("component_id")).collect()}
    assert got == {1, 2, 4}


def test_quota_groups_meet_their_quota(spark):
    rng = random.Random(2)
    groups = [(c, i, n, min(n, rng.randrange(0, n + 1))) for c in "xy" for i, n in enumerate([1] * 60 + [2] * 10 + [5] * 4)]
    df = spark.createDataFrame(groups, "category string, group_id long, pairs long, positives long")
    quotas = spark.createDataFrame([("x", 20, 8), ("y", 30, 11)], "category string, pairs long, positives long")
    got = sa.quota_groups(df, quotas, "s").groupBy("category").agg(F.sum("pairs").alias("pairs"), F.sum("positives").alias("positives")).collect()
    assert {(r.category, r.pairs, r.positives) for r in got} == {("x", 20, 8), ("y", 30, 11)}


def test_caps_are_those_of_a_pass(spark):
    rng = random.Random(3)
    members = [(i, i, f"{kind}{rng.randrange(6)}", cap) for i in range(120) for kind, cap in (("a", 3), ("b", 2), ("c", 6))]
    taken, used = set(), collections.Counter()
    for i in range(120):
        mine = [(g, cap) for r, _, g, cap in members if r == i]
        if all(used[g] < cap for g, cap in mine):
            taken.add(i)
            used.update(g for g, _ in mine)
    assert {r.row for r in gd.capped(spark.createDataFrame(members, "row long, place long, grp string, cap int")).collect()} == taken


def test_ranges_number_rows_like_one_window(spark, monkeypatch):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(400)], "x long, i long")
    want = {r.i: (r.n, r.s) for r in rk.running_sum(rk.running_sum(df, None, ["x", "i"], "n"), "i", ["x", "i"], "s").collect()}
    monkeypatch.setattr(rk, "ONE_TASK_BYTES", 0)
    assert {r.i: (r.n, r.s) for r in rk.running_sum(rk.running_sum(df, None, ["x", "i"], "n"), "i", ["x", "i"], "s").collect()} == want


def test_published_tables_and_caches(spark, tmp_path):
    df = spark.range(5)
    found = ru.publish(df, str(tmp_path / "t"))
    assert found["rows"] == 5 and spark.read.parquet(str(tmp_path / "t/data")).count() == 5
    assert all(hashlib.sha256((tmp_path / "t/data" / f["file"]).read_bytes()).hexdigest() == f["sha256"] for f in found["files"])
    with pytest.raises(FileExistsError):
        ru.publish(df, str(tmp_path / "t"))

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        ru.publish(df, str(tmp_path / "u"), check=refuse)
    assert not (tmp_path / "u").exists()
    built = []
    for _ in range(2):
        assert ru.cached(spark, str(tmp_path / "c"), {"a": 1}, lambda: built.append(1) or spark.range(3)).count() == 3
    assert built == [1]


def test_checkpoints_go_on_and_refuse_other_runs(spark, tmp_path):
    work = spark.createDataFrame([(i, 0.5) for i in range(40)], "id long, x double")
    failed = []

    def act(part):
        if not failed:
            failed.append(1)
            raise RuntimeError("once")
        return part.withColumn("y", F.col("x") * 2)

    checkpoint = ru.Checkpoint(spark, str(tmp_path / "k"), {"model": 1}, ["id"])
    checkpoint.append(work.filter("id < 7").withColumn("y", F.lit(-1.0)))
    done = ru.work_through(work, act, checkpoint, parts=4)
    assert {r.id: r.y for r in done.collect()} == {i: -1.0 if i < 7 else 1.0 for i in range(40)}
    assert checkpoint.todo(work).isEmpty()
    with pytest.raises(ValueError, match="another run"):
        ru.Checkpoint(spark, str(tmp_path / "k"), {"model": 2}, ["id"])


def test_scores_are_checked_and_fall_back(spark, tmp_path):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)], "id1 long, id2 long")
    with pytest.raises(Exception, match="not within 0 and 1"):
        ru.score(pairs, lambda p: p.withColumn("predict", F.lit(2.0))).collect()
    checkpoint = ru.Checkpoint(spark, str(tmp_path / "k"), {}, ["id1", "id2"])
    late = ru.score_in_time(pairs, lambda p: p.withColumn("predict", F.lit(0.9)), lambda p: p.withColumn("predict", F.lit(0.1)), checkpoint, seconds=-1.0)
    assert {(r.predict, r.late) for r in late.collect()} == {(0.1, True)}
    early = ru.score_in_time(pairs, lambda p: p.withColumn("predict", F.lit(0.9)), lambda p: p.withColumn("predict", F.lit(0.1)), checkpoint, seconds=600.0, parts=3)
    assert {(r.predict, r.late) for r in early.collect()} == {(0.9, False)} and early.count() == 20


def test_reports_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ('say "x", y', None)], "name string, n int")
    ru.report(df, str(tmp_path / "r"), "Title")
    assert (tmp_path / "r.csv").read_text() == 'name,n\na|b,1\n"say ""x"", y",\n'
    assert "| a\\|b | 1 |" in (tmp_path / "r.md").read_text() and json.loads((tmp_path / "r.json").read_text())["title"] == "Title"
    with pytest.raises(ValueError, match="more than 1"):
        ru.report(df, str(tmp_path / "s"), "t", most=1)
    df.write.parquet(str(tmp_path / "p"))
    assert ru.count_rows(spark, str(tmp_path / "p")) == 2


def test_accepted_rows_as_batch_and_stream(spark, tmp_path):
    rows = [(i, f"k{i % 30}", f"s{i % 30 % 4}") for i in range(90)]
    df = spark.createDataFrame(rows, "i long, key string, signature string")
    want = {tuple(r) for r in ig.accepted(df, "key", "signature", 5, ["i"]).collect()}
    assert len(want) == 20
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ig.accept_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "signature", 5, "i")
    query = stream.writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("accepted").select("i", "key", "signature").collect()} == want
    profile = ig.running_profile(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "signature", "key")
    query = profile.writeStream.format("memory").queryName("profile").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.signature: r.n for r in spark.table("profile").collect()} == {s: sum(x[2] == s for x in rows) for s in {x[2] for x in rows}}


def test_schedules_respect_caps_and_categories():
    rules = [{"rule_id": f"r{i}", "concept": f"c{i % 5}", "label": i % 2, "categories": {"x"} if i % 3 else {"x", "y"}} for i in range(12)]
    tasks = ge.rule_schedule(rules, {1: 6, 2: 4, 3: 2}, {"x": 8, "y": 4}, 3)
    by_id = {r["rule_id"]: r for r in rules}
    used = collections.Counter(r for t in tasks for r in t["rules"])
    assert max(used.values()) <= 3 and len(tasks) >= 10
    for t in tasks:
        own = [by_id[r] for r in t["rules"]]
        assert len({r["concept"] for r in own}) == len(own) and {r["label"] for r in own} == {t["label"]} and all(t["category"] in r["categories"] for r in own)
    assert ge.rule_schedule(rules, {1: 6, 2: 4, 3: 2}, {"x": 8, "y": 4}, 3) == tasks


def test_surface_positives_change_only_the_surface(spark):
    items = spark.createDataFrame([(1, "Lamp A-1 5 mm", ""), (2, "1.5 kg Box#2", "")], "id long, name string, attributes string")
    got = ge.surface_positives(items, "s", 9).collect()
    bare = lambda t: "".join(c for c in t.lower().replace("millimetres", "mm").replace("kilograms", "kg").replace(",", ".") if c.isalnum() or c == ".")
    assert {r.transform for r in got} >= {"upper_case", "unit_words", "no_unit_space", "hyphen_space", "decimal_comma", "no_hash"}
    assert all(r.original != r.changed and bare(r.original) == bare(r.changed) for r in got)
