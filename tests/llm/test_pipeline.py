"""The pipeline's stages on planted cases, and its queries' contracts on the small tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pairloom.llm import queries as llm_queries

pytest.importorskip("public_tokenizers")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfgrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    passage = prose("p", 55)
    rows = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(40)]
    near = rows[0][1].split()
    near[60] = "edited"
    rows += [(40, rows[0][1], "en", "s1"), (41, " ".join(near), "en", "s1"), (42, "!!! 123", "en", "s0"), (43, None, "en", "s0"), (44, "", None, None)]
    rows += [(45 + i, f"{prose(100 + i, 80)} {passage} {prose(200 + i, 80)}", "en", None) for i in range(3)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, planted):
    docs, seen = planted, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "token_ids":
            assert docs.columns == planted.columns
    clean = set(range(40)) | {45, 46, 47}
    assert set(seen["language_id"]) == clean | {40, 41}
    assert set(seen["near_duplicates"]) == clean
    passages = seen["repeated_passages"]
    assert all(len(passages[i].text.split()) == 160 and passages[i].n_chars == len(passages[i].text) for i in (45, 46, 47))
    assert all(passages[i].text == seen["near_duplicates"][i].text for i in range(40))
    assert set(seen["source_mix"]) == clean and set(seen["token_ids"]) == clean
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in seen["token_ids"].values())


def test_stages_take_empty_tables_and_more_columns(spark, planted):
    own = {"slot": 3, "place": 4, "n_removed": 5, "row": 6, "a.b": 7}
    docs = planted.select("*", F.lit("mine").alias("score"), *(F.lit(x).alias(c) for c, x in own.items()))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        if name != "token_ids":
            kept = stage(spark, docs, "")
            assert kept.columns == docs.columns
            assert {(r.score, r.slot, r.place, r.n_removed, r.row, r["a.b"]) for r in kept.collect()} == {("mine", 3, 4, 5, 6, 7)}


def test_contract_columns(spark, sf_dir):
    want = {
        "op1": ["doc_id", "held_out", "lang_pred", "score"], "op2": ["query_id", "rank", "vec_id", "score"], "op3": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op5": ["doc_id", "held_out", "score", "predicted"], "op6": ["vec_id", "n_links", "component_id", "kept"], "op7": ["doc_id", "fingerprint", "component_id"],
        "op8": ["doc_id", "start", "n_tokens", "ids_crc32"], "op10": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    for name, query in llm_queries.queries().items():
        columns = want.get(name.split("_")[0])
        if columns:
            assert query(spark, sf_dir).columns[: len(columns)] == columns


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(3)
    letters = {"aa": "aeiourstlnm", "bb": "äöüchschgkzwe", "cc": "ñóíáqdlpeosa"}
    words = {c: ["".join(rng.choice(x) for _ in range(rng.randrange(2, 8))) for _ in range(150)] for c, x in letters.items()}
    rows = [(i, " ".join(rng.choice(words[c]) for _ in range(rng.randrange(8, 80))), c, "s", 0) for i in range(240) for c in [sorted(words)[i % 3]]]
    junk = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "我们今天去公园散步因为天气很好而且没有工作 " * 3]
    junk.append("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)))
    junk.append(" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 9))) for _ in range(300)))
    rows += [(1000 + i, t, None, "s", 0) for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept == set(range(240))


def test_token_ids_carry_the_place_in_the_mix(spark):
    sizes = {"hot": 900, "s1": 225, "s2": 100}
    rows = [(i, f"word {i} again", "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    got = corpus_pipeline.encode(spark, mixed.repartition(7), "").orderBy("place").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in mixed.collect()]
    weight = {s: n**0.5 for s, n in sizes.items()}
    for n in (160, 320, 480):
        part = [rows[r.doc_id][3] for r in got[:n]]
        assert all(abs(part.count(s) - n * w / sum(weight.values())) < 16 for s, w in weight.items())


def test_texts_of_two_learned_languages_stay(spark):
    rng = random.Random(4)
    words = {c: ["".join(rng.choice(x) for _ in range(rng.randrange(2, 8))) for _ in range(150)] for c, x in {"aa": "aeiourstlnm", "bb": "äöüchschgkzwe", "cc": "ñóíáqdlpeosa"}.items()}
    said = lambda c: " ".join(rng.choice(words[c]) for _ in range(40))
    rows = [(i, said(c), c, "s", 0) for i in range(240) for c in [sorted(words)[i % 3]]]
    rows += [(500 + i, f"{said('aa')} {said('bb')}", None, "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {r[0] for r in rows}
